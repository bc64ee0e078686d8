"""Unique visitors per window: exact, one-hash bitmap, running, approximate.

All forms are distributed aggregations.  ``count(DISTINCT x)`` is planned by
Spark as two aggregations (first by (window, x), then by window), so a single
busy hour is spread over the user ids instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_BITS, DEFAULT_SEED, slot_hash_long, slot_hash_string
from ..functions.time import duration_us, ifloor, micros_to_ts, to_micros, ts_type
from ..session import ensure_checkpoint_dir
from .windows import tumbling_agg

PAGE_VIEW = "pv"
UV_WINDOW = "1 hour"


def _views(user_behavior: DataFrame, behavior: str) -> DataFrame:
    return user_behavior.where(F.col("behavior") == behavior)


def unique_visitors_hourly(user_behavior: DataFrame, size=UV_WINDOW, behavior: str = PAGE_VIEW) -> DataFrame:
    """Exact distinct users per tumbling window: window_start, window_end, uv."""
    return tumbling_agg(_views(user_behavior, behavior), "ts", [], size,
                        [F.countDistinct("user_id").alias("uv")])


def user_slot(df: DataFrame, col: str = "user_id", seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS):
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return slot_hash_long(F.col(col), seed, bits)
    return slot_hash_string(F.col(col).cast("string"), seed, bits)


def uv_bitmap_hourly(user_behavior: DataFrame, size=UV_WINDOW, behavior: str = PAGE_VIEW,
                     seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS) -> DataFrame:
    """Users counted as set bits of a one-hash bitmap per window.

    With one hash function the number of set bits equals the number of
    distinct slots, so this is ``count(DISTINCT slot)``; two users whose ids
    collide in a slot count once, as in the bitmap.
    """
    views = _views(user_behavior, behavior)
    views = views.withColumn("slot", user_slot(views, "user_id", seed, bits))
    return tumbling_agg(views, "ts", [], size, [F.countDistinct("slot").alias("uv")])


def uv_approx_hourly(user_behavior: DataFrame, size=UV_WINDOW, behavior: str = PAGE_VIEW,
                     rsd: float = 0.01) -> DataFrame:
    """HyperLogLog++ estimate per window (bounded memory per group)."""
    return tumbling_agg(_views(user_behavior, behavior), "ts", [], size,
                        [F.approx_count_distinct("user_id", rsd).alias("uv")])


def _pane_of(df: DataFrame, size, slide) -> tuple[Column, int, int, int, int]:
    """Pane number of each row, and window size, slide (us), panes a window and panes a slide."""
    size_us, slide_us = duration_us(size), duration_us(slide)
    pane_us = math.gcd(size_us, slide_us)
    return ifloor(to_micros(df, "ts"), pane_us), size_us, slide_us, size_us // pane_us, slide_us // pane_us


def _windows_of(panes: DataFrame, k: int, s: int) -> DataFrame:
    """Each pane (``_p``) once for every window that holds it (``_w``: the window's end in slides)."""
    p = F.col("_p")
    return panes.withColumn("_w", F.explode(F.sequence(ifloor(p, s) + 1, ifloor(p + k, s))))


def _window_rows(per_window: DataFrame, like, size_us: int, slide_us: int) -> DataFrame:
    end = F.col("_w") * F.lit(slide_us)
    return per_window.select(micros_to_ts(end - F.lit(size_us), like).alias("window_start"),
                             micros_to_ts(end, like).alias("window_end"), *[c for c in per_window.columns if c != "_w"])


def uv_bitmap_sliding(user_behavior: DataFrame, size=UV_WINDOW, slide="15 minutes", behavior: str = PAGE_VIEW,
                      seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS) -> DataFrame:
    """Bitmap UV of sliding windows from bitmaps that merge: window_start, window_end, uv.

    A bitmap is cut into pages of 32,768 slots.  Each (pane, page) is one bitmap, built with map-side
    partial aggregation, so raw rows never move; a window's page is the OR of its panes' pages, and its count the
    sum over pages.  A hot window is spread over its pages, and no state grows with the rows."""
    views = _views(user_behavior, behavior)
    pane, size_us, slide_us, k, s = _pane_of(views, size, slide)
    place = user_slot(views, "user_id", seed, bits) + 1              # pages count from 1
    pages = (views.select(pane.alias("_p"), place.alias("_slot")).where(F.col("_slot").isNotNull())
             .groupBy("_p", F.bitmap_bucket_number("_slot").alias("_page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    merged = _windows_of(pages, k, s).groupBy("_w", "_page").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    per_window = merged.groupBy("_w").agg(F.sum(F.bitmap_count("_bits")).alias("uv"))
    return _window_rows(per_window, ts_type(views, "ts"), size_us, slide_us)


def unique_visitors_sliding(user_behavior: DataFrame, size=UV_WINDOW, slide="15 minutes", behavior: str = PAGE_VIEW) -> DataFrame:
    """Exact distinct users of sliding windows: users are made distinct per pane before the panes are expanded."""
    views = _views(user_behavior, behavior)
    pane, size_us, slide_us, k, s = _pane_of(views, size, slide)
    users = views.select(pane.alias("_p"), "user_id").distinct()
    per_window = _windows_of(users, k, s).groupBy("_w").agg(F.countDistinct("user_id").alias("uv"))
    return _window_rows(per_window, ts_type(views, "ts"), size_us, slide_us)


#: log2 of the registers of a sketch; its relative standard error is about 0.83 / sqrt(2^SKETCH_BITS).
SKETCH_BITS = 14


def uv_sketch_panes(user_behavior: DataFrame, pane, behavior: str = PAGE_VIEW, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """A mergeable sketch of each pane's users: pane_start, sketch.  Store it once, and any windows made of
    panes are unions of sketches, without the events."""
    views = _views(user_behavior, behavior)
    us, like = duration_us(pane), ts_type(views, "ts")
    per = views.groupBy(ifloor(to_micros(views, "ts"), us).alias("_p")).agg(F.hll_sketch_agg("user_id", sketch_bits).alias("sketch"))
    return per.select(micros_to_ts(F.col("_p") * F.lit(us), like).alias("pane_start"), "sketch")


def uv_from_sketches(panes: DataFrame, pane, size, slide) -> DataFrame:
    """Approximate UV of sliding windows from pane sketches: window_start, window_end, uv."""
    us, size_us, slide_us = duration_us(pane), duration_us(size), duration_us(slide)
    if size_us % us or slide_us % us:
        raise ValueError("window size and slide must be multiples of the pane")
    like = ts_type(panes, "pane_start")
    numbered = panes.select(ifloor(to_micros(panes, "pane_start"), us).alias("_p"), "sketch")
    per_window = _windows_of(numbered, size_us // us, slide_us // us).groupBy("_w") \
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("uv"))
    return _window_rows(per_window, like, size_us, slide_us)


def uv_sketch_sliding(user_behavior: DataFrame, size=UV_WINDOW, slide="15 minutes", behavior: str = PAGE_VIEW,
                      sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Approximate UV of sliding windows: one sketch a pane (map-side partial), unions per window."""
    pane = math.gcd(duration_us(size), duration_us(slide)) / 1e6
    return uv_from_sketches(uv_sketch_panes(user_behavior, pane, behavior, sketch_bits), pane, size, slide)


def uv_running(user_behavior: DataFrame, size=UV_WINDOW, behavior: str = PAGE_VIEW,
               seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS,
               partitions: int | None = None) -> DataFrame:
    """One output row per view: the bitmap UV count of its window after that view.

    Rows are ordered by (ts, seq) within a window.  The count after row r is the
    number of slots whose first view in the window is at or before r.  That is a
    prefix sum over the window, computed without putting a window in one task:

    1. first view per (window, slot): a partial aggregation (skew-safe);
    2. all views plus the first-view markers are range-partitioned on
       (window, ts, seq) -- the range bounds split a busy window, even a busy
       second, across tasks -- and written to the checkpoint folder so the
       partition layout is fixed;
    3. marker totals per (window, partition) give each partition's offset
       (a table of at most #partitions + #windows rows);
    4. a running sum inside each (window, partition) plus its offset.

    Result: window_start, window_end, ts, seq, user_id, uv.
    """
    views = _views(user_behavior, behavior).select("user_id", "ts", "seq")
    like = ts_type(views, "ts")
    size_us = duration_us(size)
    views = views.select("user_id", "ts", "seq",
                         ifloor(to_micros(views, "ts"), size_us).alias("_w"),
                         user_slot(views, "user_id", seed, bits).alias("_slot"))
    first = (views.groupBy("_w", "_slot")
             .agg(F.min(F.struct("ts", "seq")).alias("_f"))
             .select("_w", F.col("_f.ts").alias("ts"), F.col("_f.seq").alias("seq"),
                     F.lit(None).cast("long").alias("user_id"), F.lit(1).alias("_mark")))
    rows = views.select("_w", "ts", "seq", "user_id", F.lit(0).alias("_mark"))
    # A marker sorts before the view it marks (same ts, seq), so the view counts itself.
    both = rows.unionByName(first).withColumn("_neg_mark", -F.col("_mark"))
    spark = user_behavior.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (both.repartitionByRange(n, "_w", "ts", "seq", "_neg_mark")
              .withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=False))
    totals = ranged.groupBy("_w", "_part").agg(F.sum("_mark").alias("_tot"))
    offsets = totals.select(
        "_w", "_part",
        F.coalesce(F.sum("_tot").over(
            Window.partitionBy("_w").orderBy("_part")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    run = Window.partitionBy("_w", "_part").orderBy("ts", "seq", "_neg_mark") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (ranged.join(offsets, ["_w", "_part"])
               .withColumn("uv", F.col("_off") + F.sum("_mark").over(run))
               .where(F.col("_mark") == 0))
    end_us = (F.col("_w") + 1) * F.lit(size_us)
    return counted.select(
        micros_to_ts(end_us - F.lit(size_us), like).alias("window_start"),
        micros_to_ts(end_us, like).alias("window_end"),
        "ts", "seq", "user_id", F.col("uv").cast("long").alias("uv"))
