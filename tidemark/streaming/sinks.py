"""Sinks and micro-batch fan-out.

``foreachBatch`` functions here write each micro-batch to ``<path>/batch_id=<n>``
with overwrite, so a retried batch replaces its own output instead of
duplicating it (the checkpoint records which batches committed).
"""

from __future__ import annotations

import os

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.topn import topn_per_group


def write_stream(df: DataFrame, path: str | None, checkpoint: str, mode: str = "append",
                 fmt: str = "parquet", trigger: dict | None = None, query_name: str | None = None,
                 ) -> StreamingQuery:
    """Start ``df`` into a file sink (or ``memory``/``console`` when ``path`` is None)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    if path is None:
        return w.format(fmt).start()
    return w.format(fmt).option("path", path).start()


def _batch_dir(path: str, batch_id: int) -> str:
    return os.path.join(path, f"batch_id={batch_id}")


def topn_batches(path: str, group_col: str, order_col: str, tie_col: str, n: int):
    """foreachBatch function: rank each micro-batch of closed window counts."""
    def run(batch: DataFrame, batch_id: int) -> None:
        topn_per_group(batch, group_col, order_col, tie_col, n) \
            .write.mode("overwrite").parquet(_batch_dir(path, batch_id))
    return run


def fan_out(paths: dict[str, str], tag_col: str = "tag"):
    """foreachBatch function: one sink per tag value (side outputs), reading the batch once.

    Rows with a tag that has no path are not written."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for tag, path in paths.items():
                batch.where(batch[tag_col] == tag).drop(tag_col) \
                    .write.mode("overwrite").parquet(_batch_dir(path, batch_id))
        finally:
            batch.unpersist()
    return run


def read_fan_out(spark: SparkSession, paths: dict[str, str], tag_col: str = "tag") -> DataFrame:
    """The rows of all sinks of a :func:`fan_out`, with their tags."""
    out = None
    for tag, path in paths.items():
        rows = spark.read.parquet(path).drop("batch_id").withColumn(tag_col, F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- keyed table, last value wins

def _last(df: DataFrame, keys: Sequence[str], order: str, more: Sequence = ()) -> DataFrame:
    """One row a key: the one with the greatest ``order`` (null keys are keys)."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest, order), F.col(order)).alias("_v"), *more) \
        .select(*keys, "_v.*", *[c for c in ("versions",) if more])


def upsert_batches(path: str, keys: Sequence[str], order: str | None = None):
    """foreachBatch function: a keyed table in which a later batch replaces the rows of its keys.

    Each micro-batch is one version, written to its own ``batch_id`` folder with overwrite: a batch that is
    replayed after a failure replaces itself, so it changes nothing.  ``order`` picks the last row of a key
    inside a batch (not needed in ``update`` mode, which has one)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch if order is None else _last(batch, keys, order)
        rows.select(*batch.columns).write.mode("overwrite").parquet(_batch_dir(path, batch_id))
    return run


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The table's rows (at version ``as_of``): the last value of each key, and ``versions``, how often it was written."""
    log = spark.read.parquet(path)
    if as_of is not None:
        log = log.where(F.col("batch_id") <= as_of)
    return _last(log, keys, "batch_id", [F.count(F.lit(1)).alias("versions")]).drop("batch_id")


def compact_upserts(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> int | None:
    """Write the table's last values as one version of ``target`` (its number is the last batch's), so a reader need
    not go through all versions; returns that number."""
    log = spark.read.parquet(path)
    upto = log.agg(F.max("batch_id")).first()[0]
    if upto is not None:
        _last(log, keys, "batch_id").drop("batch_id").write.mode("overwrite").parquet(_batch_dir(target, upto))
    return upto


def start_batches(df: DataFrame, fn, checkpoint: str, mode: str = "append",
                  trigger: dict | None = None) -> StreamingQuery:
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(fn).start())


def start_topn_report(events: DataFrame, key: str, path: str, checkpoint: str, size, slide, n: int,
                      delay="0 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Start a top-n ranking per closed sliding window: counts per (window, key) with
    a watermark, each micro-batch of closed windows ranked and written to ``path``."""
    from .windows import stream_window_count
    counts = stream_window_count(events, "ts", [key], size, slide, delay, top=n)
    return start_batches(counts, topn_batches(path, "window_end", "cnt", key, n), checkpoint,
                         trigger=trigger)


def start_hot_items_topn(user_behavior: DataFrame, path: str, checkpoint: str, size="60 minutes",
                         slide="5 minutes", n: int = 3, behavior: str = "pv",
                         trigger: dict | None = None) -> StreamingQuery:
    """Streaming hot items: top-n viewed items per window (ascending event time)."""
    from pyspark.sql import functions as F
    views = user_behavior.where(F.col("behavior") == behavior)
    return start_topn_report(views, "item_id", path, checkpoint, size, slide, n, "0 seconds", trigger)


def start_hot_urls_topn(access_log: DataFrame, path: str, checkpoint: str, size="10 minutes",
                        slide="5 seconds", n: int = 5, delay="61 seconds",
                        trigger: dict | None = None) -> StreamingQuery:
    """Streaming hot URLs: 1 s out-of-orderness plus 60 s allowed lateness as the
    watermark delay; each window is ranked once, after its lateness has passed."""
    return start_topn_report(access_log, "url", path, checkpoint, size, slide, n, delay, trigger)
