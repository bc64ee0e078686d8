"""Event-time window aggregation.

Windows are epoch-aligned and half-open ``[start, end)``; only non-empty
(window, key) groups are emitted, as with ``F.window``.

Sliding windows use *panes*: rows are first aggregated per (pane, key), where a
pane is ``gcd(size, slide)`` wide, with Spark's partial (map-side) aggregation
collapsing the raw rows before the first shuffle.  Window ends are grouped into
*window buckets* of ``8 x overlap`` consecutive ends; each pane aggregate goes to
the (at most two) buckets holding its windows and is shuffled once by
(bucket, key).  Every later step is local to that partitioning:

* counts and integral sums are rebuilt by a sweep over window ends (+value at a
  pane's first window, -value after its last; constant segments of the running
  total expand directly into output rows), so the expanded (window, key) rows are
  never shuffled or hash-aggregated;
* min/max and floating sums expand each pane into its windows and merge them with
  an aggregation whose required clustering is already satisfied.

A hot key is split across window buckets and a hot window across keys; nothing
is proportional to the raw row count after the first partial aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import duration_us, ifloor, micros_to_ts, to_micros, ts_type


@dataclass(frozen=True)
class Agg:
    """A decomposable aggregate: partial per pane, merged per window."""

    kind: str            # count | sum | min | max
    column: str | None = None

    def partial(self, name: str) -> Column:
        if self.kind == "count":
            c = F.count(F.lit(1)) if self.column is None else F.count(self.column)
            return c.alias(name)
        fn = {"sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return fn(self.column).alias(name)

    def merge(self, name: str) -> Column:
        if self.kind in ("count", "sum"):
            return F.sum(name).alias(name)
        return {"min": F.min, "max": F.max}[self.kind](name).alias(name)


def _as_list(keys) -> list[str]:
    if keys is None:
        return []
    if isinstance(keys, str):
        return [keys]
    return list(keys)


def window_aggregate(df: DataFrame, ts: str, keys, size, slide=None, aggs: dict | None = None,
                     *, start_col: str = "window_start", end_col: str = "window_end") -> DataFrame:
    """Aggregate ``aggs`` per (window, keys) for tumbling or sliding windows.

    ``aggs`` maps output name -> :class:`Agg`.  Result columns:
    ``window_start, window_end, *keys, *aggs``.
    """
    keys = _as_list(keys)
    aggs = aggs or {"cnt": Agg("count")}
    size_us = duration_us(size)
    slide_us = duration_us(slide) if slide is not None else size_us
    if size_us <= 0 or slide_us <= 0:
        raise ValueError("window size and slide must be positive")
    like = ts_type(df, ts)
    us = to_micros(df, ts)
    wanted = list(aggs)
    if slide_us != size_us and _sweepable(df, aggs):
        # The sweep adds numbers; how many of them there were tells a sum of nothing (null) from zero.
        aggs = {**aggs, **{f"_n_{n}": Agg("count", a.column) for n, a in aggs.items() if a.kind == "sum"}}

    if slide_us == size_us:
        # Tumbling: one window per row, a single aggregation.
        widx = ifloor(us, size_us)
        out = df.groupBy(widx.alias("_w"), *keys).agg(*[a.partial(n) for n, a in aggs.items()])
        end_us = (F.col("_w") + 1) * F.lit(size_us)
    else:
        pane_us = math.gcd(size_us, slide_us)
        k = size_us // pane_us           # panes per window
        s = slide_us // pane_us          # panes per slide
        panes = df.groupBy(ifloor(us, pane_us).alias("_p"), *keys).agg(
            *[a.partial(n) for n, a in aggs.items()])
        # Window e ends at e*slide; it holds pane p iff p/s < e <= (p+k)/s.
        p = F.col("_p")
        first = ifloor(p, s) + 1
        last = ifloor(p + k, s)
        # Windows are grouped into buckets of `per_bucket` consecutive ends.  A pane
        # goes to the (at most two) buckets holding its windows, with its window
        # range clipped to the bucket; pane aggregates are shuffled once by
        # (bucket, keys) and every later step is local to that partitioning.
        per_bucket = max(8 * (-(-k // s)), 64)
        vals = [F.col(n) for n in aggs]
        wb = F.col("_wb")
        panes = panes.select(
            F.explode(F.sequence(ifloor(first, per_bucket), ifloor(last, per_bucket))).alias("_wb"),
            first.alias("_e1"), last.alias("_e2"), *keys, *vals)
        panes = panes.withColumn("_lo", F.greatest(F.col("_e1"), wb * per_bucket)) \
                     .withColumn("_hi", F.least(F.col("_e2"), wb * per_bucket + (per_bucket - 1)))
        panes = panes.repartition("_wb", *keys)
        if _sweepable(df, aggs):
            count_name = next((n for n, a in aggs.items() if a.kind == "count" and a.column is None), None)
            if count_name is None:
                raise AssertionError("sweep needs a row count")
            out = _sweep(panes, keys, list(aggs), count_name)
        else:
            exploded = panes.select("_wb", F.explode(F.sequence("_lo", "_hi")).alias("_w"), *keys, *vals)
            out = exploded.groupBy("_wb", "_w", *keys).agg(*[a.merge(n) for n, a in aggs.items()]) \
                .drop("_wb")
        end_us = F.col("_w") * F.lit(slide_us)

    return out.select(
        micros_to_ts(end_us - F.lit(size_us), like).alias(start_col),
        micros_to_ts(end_us, like).alias(end_col),
        *keys,
        *[F.col(n) for n in wanted],
    )


def _sweepable(df: DataFrame, aggs: dict) -> bool:
    """Counts and integral sums can be rebuilt from +/- deltas exactly (a row
    count must be among them: it tells which windows are non-empty)."""
    integral = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if not any(a.kind == "count" and a.column is None for a in aggs.values()):
        return False
    for a in aggs.values():
        if a.kind == "count":
            continue
        if a.kind == "sum" and a.column in df.columns and isinstance(df.schema[a.column].dataType, integral):
            continue
        return False
    return True


def _sweep(panes: DataFrame, keys: list[str], names: list[str], count_name: str) -> DataFrame:
    """Window aggregates by a sweep over window ends instead of a group-by.

    Each clipped pane adds its value at its first window end and removes it after
    its last; the running total is constant between consecutive change points, so
    every non-empty segment expands directly into its output rows.  Only about two
    delta rows per pane are sorted; the (window, key) rows are never aggregated.
    """
    deltas = panes.select(
        "_wb", *keys,
        F.explode(F.array(  # a pane without numbers adds nothing
            F.struct(F.col("_lo").alias("_e"), *[F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in names]),
            F.struct((F.col("_hi") + 1).alias("_e"), *[F.coalesce((-F.col(n)).cast("long"), F.lit(0)).alias(n) for n in names]),
        )).alias("_d"))
    deltas = deltas.select("_wb", *keys, "_d.*")
    per_point = deltas.groupBy("_wb", *keys, "_e").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy("_wb", *keys).orderBy("_e")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = per_point.select(
        *keys, "_e", F.lead("_e").over(w).alias("_next"),
        *[F.sum(n).over(running).alias(n) for n in names])
    live = levels.where(F.col("_next").isNotNull() & (F.col(count_name) > 0))
    return live.select(F.explode(F.sequence(F.col("_e"), F.col("_next") - 1)).alias("_w"), *keys,
                       *[F.when(F.col(f"_n_{n}") > 0, F.col(n)).alias(n) if f"_n_{n}" in names else F.col(n)
                         for n in names])


def sliding_count(df: DataFrame, ts: str, keys, size, slide, *, count_col: str = "cnt") -> DataFrame:
    return window_aggregate(df, ts, keys, size, slide, {count_col: Agg("count")})


#: Groups of keys that a block of time is split into.
TOP_PARTS = 8
TOP_BLOCK = 3_600_000_000


def sliding_top(df: DataFrame, ts: str, key: str, size, slide, n: int, *, count_col: str = "cnt") -> DataFrame:
    """The rows of :func:`sliding_count` that may be among the ``n`` highest counts of a window (ties to the smaller
    key, a number or string): at most ``n`` for each of ``TOP_PARTS`` groups of keys.

    Panes are shuffled by (block of time, group) and a running count goes through a block's windows, so the
    expanded (window, key) rows are never made; a group holds the panes of a block."""
    size_us, slide_us = duration_us(size), duration_us(slide)
    pane_us = math.gcd(size_us, slide_us)
    like, kind = ts_type(df, ts), df.schema[key].dataType
    number = isinstance(kind, T.IntegralType)
    width = max(-(-size_us // slide_us), -(-TOP_BLOCK // slide_us)) * slide_us
    panes = df.groupBy((ifloor(to_micros(df, ts), pane_us) * F.lit(pane_us)).alias("pane_us"), key).agg(F.count(F.lit(1)).alias("cnt"))
    pane = F.col("pane_us")
    first = ifloor((ifloor(pane - F.lit(size_us), slide_us) + 1) * F.lit(slide_us), width)
    last = ifloor(ifloor(pane, slide_us) * F.lit(slide_us), width)
    panes = panes.where(pane.isNotNull()).select(
        F.explode(F.sequence(first, last)).alias("block"), F.pmod(F.xxhash64(key), F.lit(TOP_PARTS)).alias("part"),
        "pane_us", F.col(key).cast("string").alias("key"), "cnt")
    rows = panes.groupBy("block", "part").applyInPandas(
        _top_of_block(size_us, slide_us, width, n, number), "start_us long, key string, cnt long")
    start = F.col("start_us")
    return rows.select(micros_to_ts(start, like).alias("window_start"), micros_to_ts(start + F.lit(size_us), like).alias("window_end"),
                       F.col("key").cast(kind).alias(key), F.col("cnt").alias(count_col))


def _top_of_block(size_us: int, slide_us: int, width: int, n: int, number: bool):
    from ..functions.sliding import top_of_block

    def run(group, pdf):
        return top_of_block(int(group[0]), pdf, size_us, slide_us, width, n, number)
    run.__module__ = "__main__"                           # by value, as the function it calls
    return run


def tumbling_count(df: DataFrame, ts: str, keys, size, *, count_col: str = "cnt") -> DataFrame:
    return window_aggregate(df, ts, keys, size, None, {count_col: Agg("count")})


def window_average(df: DataFrame, ts: str, value: str, keys, size, slide=None, *,
                   exact: bool = False, out_col: str = "avg_value") -> DataFrame:
    """Per-window average of ``value`` from a (sum, count) accumulator.

    Null values do not count; a window without values has a null average.
    ``exact=False`` reproduces the integer-division accumulator (sum div count,
    then widened to double); ``exact=True`` gives the true mean.
    """
    agg = window_aggregate(df, ts, keys, size, slide,
                           {"_sum": Agg("sum", value), "_n": Agg("count", value), "_rows": Agg("count")})
    if exact:
        avg = F.col("_sum").cast("double") / F.col("_n")
    else:
        # `div` truncates toward zero, as long division on the JVM does.
        avg = F.expr("CAST(CAST(`_sum` AS BIGINT) div `_n` AS DOUBLE)")
    cols = [c for c in agg.columns if c not in ("_sum", "_n", "_rows")]
    return agg.select(*cols, avg.alias(out_col))


def tumbling_agg(df: DataFrame, ts: str, keys, size, columns: list[Column], *,
                 start_col: str = "window_start", end_col: str = "window_end") -> DataFrame:
    """Any aggregate expressions per (tumbling window, keys).

    Use this for aggregates that do not merge across panes (e.g. distinct counts).
    """
    keys = _as_list(keys)
    size_us = duration_us(size)
    like = ts_type(df, ts)
    widx = ifloor(to_micros(df, ts), size_us)
    out = df.groupBy(widx.alias("_w"), *keys).agg(*columns)
    end_us = (F.col("_w") + 1) * F.lit(size_us)
    names = [c for c in out.columns if c != "_w" and c not in keys]
    return out.select(
        micros_to_ts(end_us - F.lit(size_us), like).alias(start_col),
        micros_to_ts(end_us, like).alias(end_col),
        *keys, *names)
