"""Run a streaming query over a table in several micro-batches and read its result back.

Used to check the streaming forms against batch SQL.  A :class:`Feed` cuts tables by event time
into batches and writes them one after the other into a folder; rows are delayed by up to
``disorder`` at random, so they arrive out of order across batches.  After each batch the query runs
with the ``availableNow`` trigger from its checkpoint: state, watermark and output carry on
over batches and restarts.  Everything lies under the session's checkpoint root, which on a
cluster is the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import duration_us, to_micros
from ..session import checkpoint_root
from ..sources.tables import read_table, table_path
from .processors import PROVIDER, ROCKSDB

CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

#: Event-time column of each table that can be fed.
EVENT_TIME = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` as a file stream (the folder, or the one parquet file, of that exact name)."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


class Feed:
    """Tables that arrive in ``batches`` parts, in event-time order but for delays up to ``disorder``, random by
    row (or ``late_us``, a column of delays in microseconds)."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables, batches: int = 3, disorder="1 hour", late_us=None):
        self.spark, self.batches = spark, batches
        self.base = os.path.join(checkpoint_root(spark), "feeds", uuid.uuid4().hex)
        self.rows: dict[str, DataFrame] = {}
        ends = []
        for name in [tables] if isinstance(tables, str) else tables:
            df = read_table(spark, sf_dir, name)
            us = to_micros(df, EVENT_TIME[name])
            late = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, duration_us(disorder)))) if late_us is None else late_us
            self.rows[name] = df.withColumn("_arrival", us + late)
            ends.append(self.rows[name].agg(F.min("_arrival").alias("lo"), F.max("_arrival").alias("hi")).first())
            df.limit(0).write.parquet(self.path(name))
        lo = min((e.lo for e in ends if e.lo is not None), default=0)
        hi = max((e.hi for e in ends if e.hi is not None), default=0)
        self.cuts = [lo + (hi + 1 - lo) * k // batches for k in range(batches + 1)]

    def path(self, name: str) -> str:
        return os.path.join(self.base, f"{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        schema = self.rows[name].drop("_arrival").schema
        return self.spark.readStream.schema(schema).parquet(self.path(name))

    def push(self, k: int) -> None:
        """Deliver batch k of every table."""
        for name, df in self.rows.items():
            part = df.where((F.col("_arrival") >= self.cuts[k]) & (F.col("_arrival") < self.cuts[k + 1]))
            part.drop("_arrival").write.mode("append").parquet(self.path(name))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that the stateful processors need, for queries built and started inside; the
    session's own settings come back afterwards.  A running query keeps the store it started with.
    Commits write the changes only, unless the session says otherwise: files of the whole store take longer than most batches."""
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, CHANGELOG)}
    spark.conf.set(PROVIDER, ROCKSDB)
    if before[CHANGELOG] is None:
        spark.conf.set(CHANGELOG, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_root(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def run_to_table(df: DataFrame, name: str, feed: Feed | None = None, mode: str = "append") -> DataFrame:
    """Run ``df`` to the end of its input (after each batch of ``feed``) and return what it wrote."""
    from .sinks import write_stream
    out, ck = _folders(df.sparkSession, name)
    for k in range(feed.batches if feed else 1):
        if feed:
            feed.push(k)
        write_stream(df, out, ck, mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_batches_to_table(df: DataFrame, make_fn, name: str, feed: Feed | None = None, mode: str = "append") -> DataFrame:
    """Like :func:`run_to_table` for a ``foreachBatch`` sink: ``make_fn(path)`` returns the
    batch function that writes each micro-batch under ``path``."""
    from .sinks import start_batches
    out, ck = _folders(df.sparkSession, name)
    for k in range(feed.batches if feed else 1):
        if feed:
            feed.push(k)
        start_batches(df, make_fn(out), ck, mode).awaitTermination()
    return df.sparkSession.read.parquet(out).drop("batch_id")


def run_upserts_to_table(df: DataFrame, keys: list[str], name: str, feed: Feed | None = None, mode: str = "update",
                         order: str | None = None) -> DataFrame:
    """Run ``df`` into a keyed table (see ``sinks.upsert_batches``) and return its last values with ``versions``."""
    from .sinks import read_upserts, start_batches, upsert_batches
    out, ck = _folders(df.sparkSession, name)
    for k in range(feed.batches if feed else 1):
        if feed:
            feed.push(k)
        start_batches(df, upsert_batches(out, keys, order), ck, mode).awaitTermination()
    return read_upserts(df.sparkSession, out, keys)


def run_side_outputs(df: DataFrame, tags: list[str], name: str, feed: Feed | None = None, tag_col: str = "tag") -> DataFrame:
    """Run ``df`` into one sink for each tag (see ``sinks.fan_out``) and read them all back."""
    from .sinks import fan_out, read_fan_out, start_batches
    out, ck = _folders(df.sparkSession, name)
    paths = {t: os.path.join(out, t) for t in tags}
    for k in range(feed.batches if feed else 1):
        if feed:
            feed.push(k)
        start_batches(df, fan_out(paths, tag_col), ck).awaitTermination()
    return read_fan_out(df.sparkSession, paths, tag_col)
