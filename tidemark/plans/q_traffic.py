"""Traffic and unique-visitor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distinct, traffic
from ..functions.time import idiv, to_micros
from ..operators.windows import window_average
from ..sources import views
from . import oracle as O
from .catalog import register

VIEWS_PV = "behavior = 'pv'"


# -- hot items ------------------------------------------------------------------

@register("item_window_counts",
          O.sliding_count_sql("user_behavior", VIEWS_PV, ["item_id"], "60 minutes", "5 minutes"))
def item_window_counts(spark, sf_dir):
    return traffic.item_window_counts(views.user_behavior(spark, sf_dir), "60 minutes", "5 minutes")


@register("hot_items_topn",
          O.topn_sql("user_behavior", VIEWS_PV, "item_id", "60 minutes", "5 minutes", 3))
def hot_items_topn(spark, sf_dir):
    return traffic.hot_items_topn(views.user_behavior(spark, sf_dir), "60 minutes", "5 minutes", 3)


@register("hot_items_topn_daily",
          O.topn_sql("user_behavior", VIEWS_PV, "item_id", "1 day", "6 hours", 3))
def hot_items_topn_daily(spark, sf_dir):
    return traffic.hot_items_topn(views.user_behavior(spark, sf_dir), "1 day", "6 hours", 3)


@register("window_average", O.with_views("user_behavior", extra=[
    O.sliding_windows_cte("w", "(SELECT * FROM user_behavior WHERE behavior = 'pv')",
                          "item_id, ts, epoch_us(ts) // 1000000 AS sec", "60 minutes", "5 minutes")])
    + f"SELECT {O.window_bounds('e', '60 minutes', '5 minutes')}, item_id, "
      "CAST(CAST(sum(sec) AS BIGINT) // count(*) AS DOUBLE) AS avg_value FROM w GROUP BY e, item_id")
def window_average_q(spark, sf_dir):
    ub = views.user_behavior(spark, sf_dir).where(F.col("behavior") == "pv")
    ub = ub.withColumn("sec", idiv(to_micros(ub, "ts"), 1_000_000))
    return window_average(ub, "ts", "sec", ["item_id"], "60 minutes", "5 minutes", exact=False)


# -- hot urls -------------------------------------------------------------------

@register("url_window_counts",
          O.sliding_count_sql("access_log", "", ["url"], "10 minutes", "5 seconds"))
def url_window_counts(spark, sf_dir):
    return traffic.url_window_counts(views.access_log(spark, sf_dir), "10 minutes", "5 seconds")


@register("hot_urls_topn", O.topn_sql("access_log", "", "url", "10 minutes", "5 seconds", 5))
def hot_urls_topn(spark, sf_dir):
    return traffic.hot_urls_topn(views.access_log(spark, sf_dir), "10 minutes", "5 seconds", 5)


@register("hot_urls_topn_hourly", O.topn_sql("access_log", "", "url", "1 day", "1 hour", 5))
def hot_urls_topn_hourly(spark, sf_dir):
    return traffic.hot_urls_topn(views.access_log(spark, sf_dir), "1 day", "1 hour", 5)


# -- page views / unique visitors -----------------------------------------------

HOUR_US = O.us("1 hour")


@register("page_views_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, cnt FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(*) AS cnt FROM user_behavior "
            "WHERE behavior = 'pv' GROUP BY 1) t")
def page_views_hourly(spark, sf_dir):
    return traffic.page_views_hourly(views.user_behavior(spark, sf_dir), "1 hour")


@register("unique_visitors_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, uv FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(DISTINCT user_id) AS uv FROM user_behavior "
            "WHERE behavior = 'pv' GROUP BY 1) t")
def unique_visitors_hourly(spark, sf_dir):
    return distinct.unique_visitors_hourly(views.user_behavior(spark, sf_dir), "1 hour")


@register("uv_bitmap_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, uv FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(DISTINCT {O.slot_sql('user_id')}) AS uv "
            "FROM user_behavior WHERE behavior = 'pv' GROUP BY 1) t")
def uv_bitmap_hourly(spark, sf_dir):
    return distinct.uv_bitmap_hourly(views.user_behavior(spark, sf_dir), "1 hour")


@register("uv_approx_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, uv, true AS within_error FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(DISTINCT user_id) AS uv FROM user_behavior "
            "WHERE behavior = 'pv' GROUP BY 1) t")
def uv_approx_hourly(spark, sf_dir):
    """The estimate beside the exact count: both per hour, and whether they agree within 5 deviations."""
    ub = views.user_behavior(spark, sf_dir)
    estimate = distinct.uv_approx_hourly(ub, "1 hour", rsd=0.01).withColumnRenamed("uv", "estimate")
    exact = distinct.unique_visitors_hourly(ub, "1 hour")
    return exact.join(estimate, ["window_start", "window_end"]).select(
        "window_start", "window_end", "uv", (F.abs(F.col("estimate") - F.col("uv")) <= 0.05 * F.col("uv")).alias("within_error"))


@register("uv_running", O.with_views("user_behavior", extra=[f"""v AS (
  SELECT user_id, ts, seq, epoch_us(ts) // {HOUR_US} AS w, {O.slot_sql('user_id')} AS slot
  FROM user_behavior WHERE behavior = 'pv')""", """f AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY w, slot ORDER BY ts, seq) = 1
                 THEN 1 ELSE 0 END AS first_view
  FROM v)"""])
    + f"SELECT {O.tumbling_bounds('w', '1 hour')}, ts, seq, user_id, "
      "CAST(sum(first_view) OVER (PARTITION BY w ORDER BY ts, seq "
      "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS uv FROM f")
def uv_running(spark, sf_dir):
    return distinct.uv_running(views.user_behavior(spark, sf_dir), "1 hour")


# -- sliding unique visitors from partial results that merge --------------------------

def _sliding_uv_sql(value: str, more: str = "") -> str:
    return (O.with_views("user_behavior", extra=[O.sliding_windows_cte(
        "w", "(SELECT * FROM user_behavior WHERE behavior = 'pv')", "user_id, ts", "1 hour", "15 minutes")])
        + f"SELECT {O.window_bounds('e', '1 hour', '15 minutes')}, count(DISTINCT {value}) AS uv{more} FROM w GROUP BY e")


@register("uv_bitmap_sliding", _sliding_uv_sql(O.slot_sql("user_id")))
def uv_bitmap_sliding(spark, sf_dir):
    return distinct.uv_bitmap_sliding(views.user_behavior(spark, sf_dir), "1 hour", "15 minutes")


@register("unique_visitors_sliding", _sliding_uv_sql("user_id"))
def unique_visitors_sliding(spark, sf_dir):
    return distinct.unique_visitors_sliding(views.user_behavior(spark, sf_dir), "1 hour", "15 minutes")


@register("uv_sketch_sliding", _sliding_uv_sql("user_id", ", true AS within_error"))
def uv_sketch_sliding(spark, sf_dir):
    """Unions of stored pane sketches beside the exact count, and whether they agree within 5 deviations."""
    ub = views.user_behavior(spark, sf_dir)
    estimate = distinct.uv_sketch_sliding(ub, "1 hour", "15 minutes").withColumnRenamed("uv", "estimate")
    exact = distinct.unique_visitors_sliding(ub, "1 hour", "15 minutes")
    error = 5 * 0.83 / 2 ** (distinct.SKETCH_BITS / 2)
    return exact.join(estimate, ["window_start", "window_end"], "full").select(
        "window_start", "window_end", "uv", F.coalesce(F.abs(F.col("estimate") - F.col("uv")) <= F.greatest(F.lit(0.5), error * F.col("uv")),
                                                      F.lit(False)).alias("within_error"))
