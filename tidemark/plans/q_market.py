"""Marketing, ad-click and click-cap queries.

Oracle parameters: 1 h / 5 min windows (the 10 s and 5 s slides of the reports
are exercised by the benchmark); click cap 2, which the test data reaches.
"""

from __future__ import annotations

from ..operators import market
from ..sources import views
from . import oracle as O
from .catalog import register

SIZE, SLIDE = "1 hour", "5 minutes"
CAP = 2
DAY_US = O.us("1 day")


@register("marketing_total",
          "SELECT window_start, window_end, 'app marketing' AS channel, 'total' AS behavior, cnt FROM ("
          + O.sliding_count_sql("marketing", "behavior NOT IN ('UNINSTALL')", [], SIZE, SLIDE) + ") t")
def marketing_total(spark, sf_dir):
    return market.marketing_total(views.marketing(spark, sf_dir), SIZE, SLIDE)


@register("marketing_by_channel",
          O.sliding_count_sql("marketing", "behavior NOT IN ('UNINSTALL')", ["channel", "behavior"],
                              SIZE, SLIDE))
def marketing_by_channel(spark, sf_dir):
    return market.marketing_by_channel(views.marketing(spark, sf_dir), SIZE, SLIDE)


@register("ad_clicks_by_province", O.sliding_count_sql("ad_click", "", ["province"], SIZE, SLIDE))
def ad_clicks_by_province(spark, sf_dir):
    return market.ad_clicks_by_province(views.ad_click(spark, sf_dir), SIZE, SLIDE)


def _ranked_cte(period: bool) -> str:
    part = f"user_id, ad_id, epoch_us(ts) // {DAY_US}" if period else "user_id, ad_id"
    return f"""r AS (
  SELECT *, epoch_us(ts) // {DAY_US} AS day,
         row_number() OVER (PARTITION BY {part} ORDER BY ts, seq) AS rn
  FROM ad_click)"""


@register("ad_click_capped", O.with_views("ad_click", extra=[_ranked_cte(False)])
          + f"SELECT user_id, ad_id, province, city, ts, seq FROM r WHERE rn <= {CAP}")
def ad_click_capped(spark, sf_dir):
    return market.ad_click_capped(views.ad_click(spark, sf_dir), CAP, reset=None)


@register("ad_click_blacklist", O.with_views("ad_click", extra=[_ranked_cte(False)])
          + "SELECT user_id, ad_id, CAST(NULL AS TIMESTAMP) AS period_start, ts, "
            f"'Click over {CAP} times' AS message FROM r WHERE rn = {CAP + 1}")
def ad_click_blacklist(spark, sf_dir):
    return market.ad_click_blacklist(views.ad_click(spark, sf_dir), CAP, reset=None)


@register("ad_click_capped_daily", O.with_views("ad_click", extra=[_ranked_cte(True)])
          + f"SELECT user_id, ad_id, province, city, ts, seq FROM r WHERE rn <= {CAP}")
def ad_click_capped_daily(spark, sf_dir):
    return market.ad_click_capped(views.ad_click(spark, sf_dir), CAP, reset="1 day")


@register("ad_click_blacklist_daily", O.with_views("ad_click", extra=[_ranked_cte(True)])
          + f"SELECT user_id, ad_id, make_timestamp(day * {DAY_US}) AS period_start, ts, "
            f"'Click over {CAP} times' AS message FROM r WHERE rn = {CAP + 1}")
def ad_click_blacklist_daily(spark, sf_dir):
    return market.ad_click_blacklist(views.ad_click(spark, sf_dir), CAP, reset="1 day")


@register("ad_clicks_by_province_capped", O.with_views("ad_click", extra=[
    _ranked_cte(False),
    "capped AS (SELECT * FROM r WHERE rn <= %d)" % CAP,
    O.sliding_windows_cte("w", "capped", "province, ts", SIZE, SLIDE)])
    + f"SELECT {O.window_bounds('e', SIZE, SLIDE)}, province, count(*) AS cnt FROM w GROUP BY e, province")
def ad_clicks_by_province_capped(spark, sf_dir):
    return market.ad_clicks_by_province_capped(views.ad_click(spark, sf_dir), SIZE, SLIDE, CAP, reset=None)


# The window shapes of the reports themselves.

@register("marketing_total_1h_10s",
          "SELECT window_start, window_end, 'app marketing' AS channel, 'total' AS behavior, cnt FROM ("
          + O.sliding_count_sql("marketing", "behavior NOT IN ('UNINSTALL')", [], "1 hour", "10 seconds") + ") t")
def marketing_total_1h_10s(spark, sf_dir):
    return market.marketing_total(views.marketing(spark, sf_dir), "1 hour", "10 seconds")


@register("ad_clicks_by_province_1h_5s", O.sliding_count_sql("ad_click", "", ["province"], "1 hour", "5 seconds"))
def ad_clicks_by_province_1h_5s(spark, sf_dir):
    return market.ad_clicks_by_province(views.ad_click(spark, sf_dir), "1 hour", "5 seconds")
