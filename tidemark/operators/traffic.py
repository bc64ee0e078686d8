"""Traffic counts: hot items, hot URLs, page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topn import topn_per_group
from .windows import sliding_count, sliding_top, tumbling_count

# Window shapes and list sizes of the traffic reports.
HOT_ITEMS_SIZE, HOT_ITEMS_SLIDE, HOT_ITEMS_N = "60 minutes", "5 minutes", 3
HOT_URLS_SIZE, HOT_URLS_SLIDE, HOT_URLS_N = "10 minutes", "5 seconds", 5
PAGE_VIEW = "pv"


def item_window_counts(user_behavior: DataFrame, size=HOT_ITEMS_SIZE, slide=HOT_ITEMS_SLIDE,
                       behavior: str = PAGE_VIEW) -> DataFrame:
    """Views per (item, sliding window): window_start, window_end, item_id, cnt."""
    views = user_behavior.where(F.col("behavior") == behavior)
    return sliding_count(views, "ts", ["item_id"], size, slide)


def hot_items_topn(user_behavior: DataFrame, size=HOT_ITEMS_SIZE, slide=HOT_ITEMS_SLIDE,
                   n: int = HOT_ITEMS_N, behavior: str = PAGE_VIEW) -> DataFrame:
    """Top-n viewed items per window end, ranked by count desc, item id asc."""
    counts = item_window_counts(user_behavior, size, slide, behavior)
    return topn_per_group(counts, "window_end", "cnt", "item_id", n)


def url_window_counts(access_log: DataFrame, size=HOT_URLS_SIZE, slide=HOT_URLS_SLIDE) -> DataFrame:
    """Requests per (url, sliding window)."""
    return sliding_count(access_log, "ts", ["url"], size, slide)


def hot_urls_topn(access_log: DataFrame, size=HOT_URLS_SIZE, slide=HOT_URLS_SLIDE,
                  n: int = HOT_URLS_N) -> DataFrame:
    """Top-n requested URLs per window end, count desc, url asc.

    In batch every row counts (no row is late); the streaming form applies the
    out-of-orderness bound plus allowed lateness as its watermark delay.
    """
    counts = sliding_top(access_log, "ts", "url", size, slide, n)
    return topn_per_group(counts, "window_end", "cnt", "url", n)


def page_views_hourly(user_behavior: DataFrame, size="1 hour", behavior: str = PAGE_VIEW) -> DataFrame:
    """Page views per tumbling window: window_start, window_end, cnt."""
    views = user_behavior.where(F.col("behavior") == behavior)
    return tumbling_count(views, "ts", [], size)
