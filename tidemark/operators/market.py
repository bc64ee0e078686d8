"""Marketing and ad-click counts, and the per-user click cap with its blacklist.

The click cap passes the first ``max_count`` clicks of each (user, ad) per reset
period, in event-time order, and emits one warning at click ``max_count + 1``.
It is a ``row_number() <= max_count + 1`` filter over (user, ad, period): Spark
plans it with a partial ``WindowGroupLimit`` in every map task, so even a
(user, ad) pair holding a third of all clicks ships at most ``max_count + 1``
rows per map task to the final ranking.  Both outputs come from that one ranked
frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, ifloor, micros_to_ts, to_micros, ts_type
from .windows import sliding_count

# Fixed values of the marketing and ad reports.
MARKETING_SIZE, MARKETING_SLIDE = "1 hour", "10 seconds"
MARKETING_EXCLUDED = ("UNINSTALL",)
MARKETING_TOTAL_CHANNEL, MARKETING_TOTAL_BEHAVIOR = "app marketing", "total"
AD_SIZE, AD_SLIDE = "1 hour", "5 seconds"
CLICK_CAP = 100
CLICK_RESET = "1 day"
BLACKLIST_MESSAGE = "Click over {n} times"


def _kept(df: DataFrame, exclude) -> DataFrame:
    exclude = list(exclude or [])
    return df.where(~F.col("behavior").isin(exclude)) if exclude else df


def marketing_total(df: DataFrame, size=MARKETING_SIZE, slide=MARKETING_SLIDE,
                    exclude=MARKETING_EXCLUDED) -> DataFrame:
    """All marketing events per sliding window, labelled ('app marketing', 'total')."""
    counts = sliding_count(_kept(df, exclude), "ts", [], size, slide)
    return counts.select("window_start", "window_end",
                         F.lit(MARKETING_TOTAL_CHANNEL).alias("channel"),
                         F.lit(MARKETING_TOTAL_BEHAVIOR).alias("behavior"), "cnt")


def marketing_by_channel(df: DataFrame, size=MARKETING_SIZE, slide=MARKETING_SLIDE,
                         exclude=MARKETING_EXCLUDED) -> DataFrame:
    """Marketing events per (channel, behavior, sliding window)."""
    return sliding_count(_kept(df, exclude), "ts", ["channel", "behavior"], size, slide)


def ad_clicks_by_province(df: DataFrame, size=AD_SIZE, slide=AD_SLIDE) -> DataFrame:
    """Ad clicks per (province, sliding window)."""
    return sliding_count(df, "ts", ["province"], size, slide)


def _period(df: DataFrame, reset):
    """Reset-period index of each click (event-time days by default), or a constant."""
    if reset is None:
        return F.lit(0).cast("long")
    return ifloor(to_micros(df, "ts"), duration_us(reset))


def ranked_clicks(df: DataFrame, max_count: int = CLICK_CAP, reset=CLICK_RESET) -> DataFrame:
    """Clicks numbered per (user, ad, period) in (ts, seq) order, cut at max_count + 1.

    Up to the planner's group-limit threshold, map tasks keep max_count + 1 clicks of a group.  Larger
    caps number the clicks of each hour first and add the clicks of the hours before (one row an
    hour), so no task holds a hot group either way."""
    ranked = df.withColumn("_period", _period(df, reset))
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if max_count + 1 > threshold:
        keys = ["user_id", "ad_id", "_period", "_hour"]
        ranked = ranked.withColumn("_hour", ifloor(to_micros(df, "ts"), duration_us("1 hour")))
        before = Window.partitionBy(*keys[:3]).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
        hours = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hours = hours.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                             F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        open_hours = hours.where(F.col("_before") <= max_count)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq"))
        return (ranked.join(open_hours, same).withColumn("_click_no", F.col("_before") + number)
                .where(F.col("_click_no") <= max_count + 1)
                .drop("_hour", "_before", *[f"_k{i}" for i in range(4)]))
    w = Window.partitionBy("user_id", "ad_id", "_period").orderBy("ts", "seq")
    return ranked.withColumn("_click_no", F.row_number().over(w)) \
                 .where(F.col("_click_no") <= max_count + 1)


def ad_click_capped(df: DataFrame, max_count: int = CLICK_CAP, reset=CLICK_RESET) -> DataFrame:
    """Main output: clicks that are within the cap (same columns as the input)."""
    return ranked_clicks(df, max_count, reset).where(F.col("_click_no") <= max_count) \
        .drop("_click_no", "_period")


def ad_click_blacklist(df: DataFrame, max_count: int = CLICK_CAP, reset=CLICK_RESET) -> DataFrame:
    """Side output: one warning per (user, ad, period), at the first click over the cap.

    Columns: user_id, ad_id, period_start (null without a reset period), ts of the
    blocked click, message.
    """
    over = ranked_clicks(df, max_count, reset).where(F.col("_click_no") == max_count + 1)
    if reset is None:
        period_start = F.lit(None).cast(ts_type(df, "ts"))
    else:
        period_start = micros_to_ts(F.col("_period") * F.lit(duration_us(reset)), ts_type(df, "ts"))
    return over.select("user_id", "ad_id", period_start.alias("period_start"), "ts",
                       F.lit(BLACKLIST_MESSAGE.format(n=max_count)).alias("message"))


def ad_clicks_by_province_capped(df: DataFrame, size=AD_SIZE, slide=AD_SLIDE,
                                 max_count: int = CLICK_CAP, reset=CLICK_RESET) -> DataFrame:
    """Province counts of the clicks that pass the cap."""
    return ad_clicks_by_province(ad_click_capped(df, max_count, reset), size, slide)
