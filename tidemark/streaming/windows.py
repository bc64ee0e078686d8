"""Streaming window counts, unique visitors and top-N.

Event time must be a ``timestamp`` (LTZ) column for ``withWatermark``; parquet
``timestamp_ntz`` is cast first.  Windows close -- and append-mode rows are
emitted -- when the watermark (max event time - delay) passes their end.

Sliding windows are two chained operators with one watermark rule for every shape: rows are
counted per tumbling pane of gcd(size, slide), and the closed panes (one row per pane and key)
are summed per sliding window by ``processors.SlidingProcessor``.  It holds a pane in the one or two
blocks of time whose windows have it, not once for each window, and gives all counts of a closed window or the
highest ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import as_event_time, duration_us, micros_to_ts, to_ntz


def _interval(us: int) -> str:
    return f"{us} microseconds"


def _panes(events: DataFrame, ts: str, keys: list[str], pane_us: int, delay, count_col: str) -> DataFrame:
    ev = as_event_time(events, ts, "_et").withWatermark("_et", _interval(duration_us(delay)))
    return ev.groupBy(F.window("_et", _interval(pane_us)), *keys).agg(F.count(F.lit(1)).alias(count_col))


def window_counts(events: DataFrame, ts: str, keys, size, slide=None, delay="0 seconds",
                  *, count_col: str = "cnt", top: int | None = None) -> DataFrame:
    """(window_start_us, *keys, cnt) of closed windows, start in epoch microseconds; further stateful operators can follow.

    ``top``: of a sliding window only rows that may be among its ``top`` highest counts (ties to the smaller key,
    one number or string)."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    size_us = duration_us(size)
    slide_us = duration_us(slide) if slide is not None else size_us
    panes = _panes(events, ts, keys, math.gcd(size_us, slide_us), delay, count_col)
    panes = panes.withColumn("window_start_us", F.unix_micros("window.start")).drop("window")
    if slide_us != size_us:
        from .processors import sliding_sums
        return sliding_sums(panes, keys, size_us, slide_us, count_col, top)
    return panes.select("window_start_us", *keys, count_col)


def stream_window_count(events: DataFrame, ts: str, keys, size, slide=None, delay="0 seconds",
                        *, count_col: str = "cnt", top: int | None = None) -> DataFrame:
    """Watermarked sliding/tumbling count per (window, keys): window_start, window_end, *keys, cnt (``top``: see
    :func:`window_counts`).  Sliding windows need the RocksDB state store."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    start = F.col("window_start_us")
    return window_counts(events, ts, keys, size, slide, delay, count_col=count_col, top=top).select(
        micros_to_ts(start).alias("window_start"), micros_to_ts(start + F.lit(duration_us(size))).alias("window_end"),
        *keys, count_col)


def stream_window_updates(events: DataFrame, ts: str, keys, size, slide=None, delay="0 seconds",
                          lateness="0 seconds", *, count_col: str = "cnt") -> DataFrame:
    """Counts per (window, keys) for ``update`` mode: a row that comes late, but within ``delay`` + ``lateness``
    of its window's end, emits its window again.  Later rows are dropped.

    A sink that keeps the last row of each key (``sinks.upsert_batches``) then holds every window's
    current result.  Each window counts rows on its own, so a row can be too late for one window
    and in time for the next; that is why rows are expanded into their windows here instead of panes."""
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    size_us = duration_us(size)
    wait = _interval(duration_us(delay) + duration_us(lateness))
    ev = as_event_time(events, ts, "_et").withWatermark("_et", wait)
    window = F.window("_et", _interval(size_us), None if slide is None else _interval(duration_us(slide)))
    agg = ev.groupBy(window, *keys).agg(F.count(F.lit(1)).alias(count_col))
    return agg.select(to_ntz(F.col("window.start")).alias("window_start"), to_ntz(F.col("window.end")).alias("window_end"), *keys, count_col)


def stream_unique_visitors(views: DataFrame, ts: str = "ts", size="1 hour", delay="0 seconds",
                           user: str = "user_id") -> DataFrame:
    """Exact distinct users per tumbling window, as two chained aggregations:
    (window, user) first, then count per window keyed by ``window_time``."""
    size_us = duration_us(size)
    ev = as_event_time(views, ts, "_et").withWatermark("_et", _interval(duration_us(delay)))
    per_user = ev.groupBy(F.window("_et", _interval(size_us)), user).agg(F.count(F.lit(1)).alias("_n"))
    per_window = per_user.groupBy(F.window(F.window_time("window"), _interval(size_us)).alias("w")) \
        .agg(F.count(F.lit(1)).alias("uv"))
    return per_window.select(to_ntz(F.col("w.start")).alias("window_start"),
                             to_ntz(F.col("w.end")).alias("window_end"), "uv")


def stream_uv_approx(views: DataFrame, ts: str = "ts", size="1 hour", delay="0 seconds",
                     user: str = "user_id", rsd: float = 0.01) -> DataFrame:
    size_us = duration_us(size)
    ev = as_event_time(views, ts, "_et").withWatermark("_et", _interval(duration_us(delay)))
    agg = ev.groupBy(F.window("_et", _interval(size_us))).agg(F.approx_count_distinct(user, rsd).alias("uv"))
    return agg.select(to_ntz(F.col("window.start")).alias("window_start"),
                      to_ntz(F.col("window.end")).alias("window_end"), "uv")


def stream_uv_running(views: DataFrame, ts: str = "ts", size="1 hour", delay="0 seconds",
                      user: str = "user_id") -> DataFrame:
    """Running bitmap UV per window, re-emitted as it grows (``update`` output mode).

    The first view of each slot per window is kept by a watermarked
    ``dropDuplicates`` (state per (window, slot), evicted with the window); the
    count of first views per window is a streaming aggregation, so a busy window
    is counted with partial aggregation, not in one task.  Per micro-batch rather
    than per element: each batch emits the current count of every window it changed.
    """
    from ..operators.distinct import user_slot
    size_us = duration_us(size)
    ev = as_event_time(views, ts, "_et").withWatermark("_et", _interval(duration_us(delay)))
    ev = ev.select(F.window("_et", _interval(size_us)).alias("w"), user_slot(ev, user).alias("slot"), "_et")
    firsts = ev.dropDuplicates(["w", "slot"])
    agg = firsts.groupBy("w").agg(F.count(F.lit(1)).alias("uv"))
    return agg.select(to_ntz(F.col("w.start")).alias("window_start"),
                      to_ntz(F.col("w.end")).alias("window_end"), "uv")
