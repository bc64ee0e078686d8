"""Streaming forms over the driver tables, fed in several out-of-order micro-batches.

Every query runs on a :class:`~tidemark.streaming.runner.Feed`: the tables arrive in three parts,
with rows delayed by up to the feed's disorder, and the query restarts from its checkpoint after each.
A stream emits a window or fires a timer only once the watermark has passed it, and
it does not flush open state at the end of the input.  The oracle SQL is the batch result
restricted by that rule: with the watermark ``wm = max(ts) - delay`` (millisecond precision) a
window is out iff ``window_end <= wm``, and an event counts iff ``ts <= wm``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import views
from ..streaming import joins as SJ
from ..streaming import processors as SP
from ..streaming import sinks
from ..streaming import windows as SW
from ..streaming.runner import (Feed, run_batches_to_table, run_side_outputs, run_to_table, run_upserts_to_table,
                                state_store)
from . import oracle as O
from .catalog import register
from .q_orders import _PATTERN
from .q_sequences import _burst_sql, _pairs_sql

HOUR_US = O.us("1 hour")
#: Rows of ``events`` come up to this late, and the streams wait as long.
DELAY = "1 hour"
DELAY_US = O.us(DELAY)


def _wm(view: str, where: str = "", delay_us: int = DELAY_US) -> str:
    w = f" WHERE {where}" if where else ""
    return f"(SELECT make_timestamp((epoch_us(max(ts)) // 1000) * 1000 - {delay_us}) FROM {view}{w})"


def _events(spark, sf_dir) -> Feed:
    return Feed(spark, sf_dir, "events", disorder=DELAY)


def _views(spark, sf_dir, feed):
    return views.user_behavior(spark, sf_dir, streaming=feed).where(F.col("behavior") == "pv")


@register("stream_page_views_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, cnt FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(*) AS cnt FROM user_behavior "
            f"WHERE behavior = 'pv' GROUP BY 1) t WHERE make_timestamp((w + 1) * {HOUR_US}) <= "
            + _wm("user_behavior", "behavior = 'pv'"))
def stream_page_views_hourly(spark, sf_dir):
    feed = _events(spark, sf_dir)
    return run_to_table(SW.stream_window_count(_views(spark, sf_dir, feed), "ts", [], "1 hour", delay=DELAY),
                        "page_views_hourly", feed)


@register("stream_item_window_counts",
          "SELECT * FROM (" + O.sliding_count_sql("user_behavior", "behavior = 'pv'", ["item_id"],
                                                  "60 minutes", "5 minutes")
          + ") c WHERE window_end <= " + _wm("events", "event_type = 'view'"))
def stream_item_window_counts(spark, sf_dir):
    feed = _events(spark, sf_dir)
    with state_store(spark):
        return run_to_table(SW.stream_window_count(_views(spark, sf_dir, feed), "ts", ["item_id"], "60 minutes",
                                                   "5 minutes", DELAY), "item_window_counts", feed)


@register("stream_hot_items_topn",
          "SELECT * FROM (" + O.topn_sql("user_behavior", "behavior = 'pv'", "item_id", "60 minutes",
                                         "5 minutes", 3)
          + ") t WHERE window_end <= " + _wm("events", "event_type = 'view'"))
def stream_hot_items_topn(spark, sf_dir):
    # Closed windows arrive complete in one micro-batch (append mode), so each batch
    # is ranked in batch mode by foreachBatch.
    feed = _events(spark, sf_dir)
    with state_store(spark):
        counts = SW.stream_window_count(_views(spark, sf_dir, feed), "ts", ["item_id"], "60 minutes", "5 minutes", DELAY, top=3)
        return run_batches_to_table(
            counts, lambda path: sinks.topn_batches(path, "window_end", "cnt", "item_id", 3), "hot_items_topn", feed)


def _hot_urls(spark, sf_dir, size, slide, delay):
    # Out-of-orderness bound 1 s plus 60 s allowed lateness = a 61 s watermark delay;
    # each window is ranked once, after its lateness has passed.
    feed = Feed(spark, sf_dir, "events", disorder=delay)
    access = views.access_log(spark, sf_dir, streaming=feed)
    with state_store(spark):
        counts = SW.stream_window_count(access, "ts", ["url"], size, slide, delay=delay, top=5)
        return run_batches_to_table(
            counts, lambda path: sinks.topn_batches(path, "window_end", "cnt", "url", 5), "hot_urls_topn", feed)


LATE = "61 seconds"
LATE_US = O.us(LATE)


@register("stream_hot_urls_topn_hourly",
          "SELECT * FROM (" + O.topn_sql("access_log", "", "url", "1 day", "1 hour", 5)
          + ") t WHERE window_end <= " + _wm("events", "", LATE_US))
def stream_hot_urls_topn_hourly(spark, sf_dir):
    return _hot_urls(spark, sf_dir, "1 day", "1 hour", LATE)


@register("stream_hot_urls_topn",
          "SELECT * FROM (" + O.topn_sql("access_log", "", "url", "10 minutes", "5 seconds", 5)
          + ") t WHERE window_end <= " + _wm("events", "", LATE_US))
def stream_hot_urls_topn(spark, sf_dir):
    return _hot_urls(spark, sf_dir, "10 minutes", "5 seconds", LATE)


@register("stream_ad_clicks_by_province",
          O.with_views("ad_click") + "SELECT * FROM (" + O.sliding_count_sql("ad_click", "", ["province"], "1 hour", "5 seconds")
          + ") c WHERE window_end <= " + _wm("ad_click"))
def stream_ad_clicks_by_province(spark, sf_dir):
    # 720 windows per row: the rows are counted per 5 s pane first.
    feed = _events(spark, sf_dir)
    clicks = views.ad_click(spark, sf_dir, streaming=feed)
    with state_store(spark):
        return run_to_table(SW.stream_window_count(clicks, "ts", ["province"], "1 hour", "5 seconds", DELAY),
                            "ad_clicks_by_province", feed)


@register("stream_unique_visitors_hourly", O.with_views("user_behavior")
          + f"SELECT {O.tumbling_bounds('w', '1 hour')}, uv FROM ("
            f"SELECT epoch_us(ts) // {HOUR_US} AS w, count(DISTINCT user_id) AS uv FROM user_behavior "
            f"WHERE behavior = 'pv' GROUP BY 1) t WHERE make_timestamp((w + 1) * {HOUR_US}) <= "
            + _wm("user_behavior", "behavior = 'pv'"))
def stream_unique_visitors_hourly(spark, sf_dir):
    feed = _events(spark, sf_dir)
    return run_to_table(SW.stream_unique_visitors(_views(spark, sf_dir, feed), "ts", "1 hour", DELAY),
                        "unique_visitors_hourly", feed)


CAP = 2
_RANKED = """r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, ad_id ORDER BY ts, seq) AS rn FROM ad_click)"""


def _capped_stream(spark, sf_dir):
    feed = _events(spark, sf_dir)
    clicks = views.ad_click(spark, sf_dir, streaming=feed)
    with state_store(spark):
        return run_to_table(SP.stream_click_cap(clicks, CAP, reset=None, delay=DELAY), "click_cap", feed)


@register("stream_ad_click_capped", O.with_views("ad_click", extra=[_RANKED])
          + f"SELECT user_id, ad_id, province, city, ts, seq FROM r WHERE rn <= {CAP} AND ts <= " + _wm("ad_click"))
def stream_ad_click_capped(spark, sf_dir):
    return _capped_stream(spark, sf_dir).where("tag = 'main'") \
        .select("user_id", "ad_id", "province", "city", "ts", "seq")


@register("stream_ad_click_blacklist", O.with_views("ad_click", extra=[_RANKED])
          + f"SELECT user_id, ad_id, ts, 'Click over {CAP} times' AS message FROM r WHERE rn = {CAP + 1} AND ts <= "
          + _wm("ad_click"))
def stream_ad_click_blacklist(spark, sf_dir):
    return _capped_stream(spark, sf_dir).where("tag = 'blacklist'") \
        .select("user_id", "ad_id", "ts", "message")


def _logins(spark, sf_dir, start, name):
    feed = _events(spark, sf_dir)
    with state_store(spark):
        return run_to_table(start(views.login(spark, sf_dir, streaming=feed)), name, feed)


@register("stream_login_fail_consecutive", "SELECT * FROM (" + _pairs_sql("1 day", "login fail in 2 seconds")
          + ") p WHERE last_fail_ts <= " + _wm("events"))
def stream_login_fail_consecutive(spark, sf_dir):
    return _logins(spark, sf_dir, lambda d: SP.stream_login_fail_consecutive(d, "1 day", DELAY), "login_consecutive")


@register("stream_login_fail_pattern", "SELECT * FROM (" + _pairs_sql("2 hours", "login fail!")
          + ") p WHERE last_fail_ts <= " + _wm("events"))
def stream_login_fail_pattern(spark, sf_dir):
    return _logins(spark, sf_dir, lambda d: SP.stream_login_fail_pattern(d, "2 hours", DELAY), "login_pattern")


BURST_US = O.us("1 day")


@register("stream_login_fail_burst", "SELECT * FROM (" + _burst_sql("1 day")
          + f") b WHERE epoch_us(first_fail_ts) + {BURST_US} <= (SELECT (epoch_us(max(ts)) // 1000) * 1000 "
            f"- {DELAY_US} FROM events)")
def stream_login_fail_burst(spark, sf_dir):
    return _logins(spark, sf_dir, lambda d: SP.stream_login_fail_burst(d, "1 day", 2, DELAY), "login_burst")


ORDER_TIMEOUT = "400 days"
ORDER_US = O.us(ORDER_TIMEOUT)
HORIZON = "800 days"
HORIZON_US = O.us(HORIZON)
#: Orders and line items are dated by the day; the half day keeps watermarks off these dates.
ORDER_DISORDER, ORDER_DELAY = "2 days", "60 hours"
ORDER_DELAY_US = O.us(ORDER_DELAY)
_ORDER_WM = f"(SELECT (epoch_us(max(ts)) // 1000) * 1000 - {ORDER_DELAY_US} FROM order_events)"


def _orders(spark, sf_dir, start, name):
    feed = Feed(spark, sf_dir, ("orders", "lineitem"), batches=2, disorder=ORDER_DISORDER)
    with state_store(spark):
        return run_to_table(start(views.order_events(spark, sf_dir, streaming=feed)), name, feed)


@register("stream_order_pattern", O.with_views("order_events", extra=[_PATTERN]) + f"""
SELECT order_id, create_ts, CASE WHEN ok THEN pay_ts END AS pay_ts,
       CASE WHEN ok THEN 'payed success' ELSE 'timeout' END AS result, CASE WHEN ok THEN 'payed' ELSE 'timeout' END AS output
FROM (SELECT *, coalesce(epoch_us(pay_ts) - epoch_us(create_ts) < {ORDER_US}, false) AS ok FROM np) t
WHERE CASE WHEN ok THEN epoch_us(pay_ts) ELSE epoch_us(create_ts) + {ORDER_US} END <= """ + _ORDER_WM)
def stream_order_pattern(spark, sf_dir):
    return _orders(spark, sf_dir, lambda d: SP.stream_order_pattern(d, ORDER_TIMEOUT, ORDER_DELAY), "order_pattern")


@register("stream_order_timeout_status", O.with_views("order_events", extra=[_PATTERN, f"""pb AS (
  SELECT DISTINCT c.order_id, c.seq FROM order_events c JOIN order_events p
    ON p.order_id = c.order_id AND p.event_type = 'pay'
   AND (p.ts < c.ts OR (p.ts = c.ts AND p.seq < c.seq)) AND epoch_us(c.ts) - epoch_us(p.ts) <= {HORIZON_US}
  WHERE c.event_type = 'create')"""]) + f"""
SELECT order_id, create_ts, CASE WHEN ok THEN 'order payed successfully' ELSE 'order timeout' END AS result
FROM (SELECT np.*, coalesce(epoch_us(pay_ts) <= epoch_us(create_ts) + {ORDER_US}, false) AS ok
      FROM np ANTI JOIN pb ON np.order_id = pb.order_id AND np.seq = pb.seq) t
WHERE CASE WHEN ok THEN epoch_us(pay_ts) ELSE epoch_us(create_ts) + {ORDER_US} END <= """ + _ORDER_WM)
def stream_order_timeout_status(spark, sf_dir):
    return _orders(spark, sf_dir, lambda d: SP.stream_order_status(d, ORDER_TIMEOUT, ORDER_DELAY, memory=HORIZON),
                   "order_status")


@register("stream_order_pay_match", O.with_views("order_events", extra=["""po AS (
  SELECT order_id,
         min(CASE WHEN event_type = 'create' THEN epoch_us(ts) END) AS c0,
         min(CASE WHEN event_type = 'pay' THEN epoch_us(ts) END) AS p0
  FROM order_events GROUP BY order_id)""", f"""seen AS (
  SELECT order_id, CASE WHEN p0 IS NULL OR c0 <= p0 + {HORIZON_US} THEN c0 END AS c,
         CASE WHEN c0 IS NULL OR p0 <= c0 + {HORIZON_US} THEN p0 END AS p FROM po)""", f"""res AS (
  SELECT order_id, CASE
      WHEN c IS NOT NULL AND p IS NOT NULL AND p < c + {ORDER_US} THEN 'payed successfully'
      WHEN c IS NOT NULL AND p IS NOT NULL THEN 'payed but already timeout'
      WHEN c IS NOT NULL THEN 'time out'
      ELSE 'already payed but not found create log' END AS result,
    CASE WHEN c IS NOT NULL AND p IS NOT NULL THEN greatest(c, p) ELSE coalesce(c, p) + {HORIZON_US} END AS decided
  FROM seen)"""])
          + "SELECT order_id, result, CASE WHEN result = 'payed successfully' THEN 'payed' "
            "ELSE 'timeout' END AS output FROM res WHERE decided <= " + _ORDER_WM)
def stream_order_pay_match(spark, sf_dir):
    return _orders(spark, sf_dir, lambda d: SP.stream_order_match(d, ORDER_TIMEOUT, HORIZON, ORDER_DELAY), "order_match")


TX_BOUND = "200 days"
TX_US = O.us(TX_BOUND)
#: Receipts come up to 50 days after their line item's date, so their stream is that far out of order.
TX_DELAY = "1260 hours"
TX_DELAY_US = O.us(TX_DELAY)
_TX_WM = ("(SELECT least((SELECT max(epoch_us(ts)) FROM pays), (SELECT max(epoch_us(ts)) FROM receipts)) "
          f"- {TX_DELAY_US})")
_NEAR = f"epoch_us(r.ts) BETWEEN epoch_us(p.ts) - {TX_US} AND epoch_us(p.ts) + {TX_US}"


_TX_RECONCILE_SQL = O.with_views("order_events", "receipts", extra=[
    "pays AS (SELECT * FROM order_events WHERE tx_id <> '')"]) + f"""
SELECT p.tx_id, p.order_id, p.ts AS pay_ts, r.pay_channel, r.ts AS receipt_ts, 'matched' AS tag
FROM pays p JOIN receipts r ON p.tx_id = r.tx_id AND {_NEAR}
UNION ALL
SELECT tx_id, order_id, ts, NULL, NULL, 'unmatched_pay' FROM pays p
WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.tx_id = p.tx_id AND {_NEAR})
  AND epoch_us(ts) + {TX_US} <= {_TX_WM}
UNION ALL
SELECT tx_id, NULL, NULL, pay_channel, ts, 'unmatched_receipt' FROM receipts r
WHERE NOT EXISTS (SELECT 1 FROM pays p WHERE p.tx_id = r.tx_id AND {_NEAR})
  AND epoch_us(ts) + {TX_US} <= {_TX_WM}"""


@register("stream_tx_reconcile", _TX_RECONCILE_SQL)
def stream_tx_reconcile(spark, sf_dir):
    """Reconciliation of two streams (full outer join with a range condition) with all three outputs:
    pairs as soon as both sides are in, unmatched rows once the watermark rules a partner out."""
    pays = Feed(spark, sf_dir, ("orders", "lineitem"), disorder=ORDER_DISORDER)
    with state_store(spark):
        out = SJ.stream_tx_reconcile(views.order_events(spark, sf_dir, streaming=pays),
                                     views.receipts(spark, sf_dir, streaming=pays), TX_BOUND, TX_DELAY)
        return run_to_table(out, "tx_reconcile", pays)


@register("stream_marketing_by_channel",
          O.with_views("marketing") + "SELECT * FROM (" + O.sliding_count_sql("marketing", "behavior NOT IN ('UNINSTALL')",
                                                  ["channel", "behavior"], "1 hour", "5 minutes")
          + ") c WHERE window_end <= " + _wm("marketing", "behavior <> 'UNINSTALL'"))
def stream_marketing_by_channel(spark, sf_dir):
    # Stream-static join with the customer table gives the channel.
    feed = _events(spark, sf_dir)
    mk = views.marketing(spark, sf_dir, streaming=feed).where(F.col("behavior") != "UNINSTALL")
    with state_store(spark):
        return run_to_table(SW.stream_window_count(mk, "ts", ["channel", "behavior"], "1 hour", "5 minutes", DELAY),
                            "marketing_by_channel", feed)


# -- cancelled timers ------------------------------------------------------------

INVOICE_TIMEOUT = "30 days"
#: Payments are up to 60 days ahead of the invoices around them.
INVOICE_DELAY = "1500 hours"
_INVOICE_DELAY_US = O.us(INVOICE_DELAY)
_INVOICE_US = O.us(INVOICE_TIMEOUT)


@register("stream_open_orders", O.with_views("invoice_events", extra=["""o AS (
  SELECT order_id, min(CASE WHEN event_type = 'create' THEN ts END) AS c, min(CASE WHEN event_type = 'pay' THEN ts END) AS p
  FROM invoice_events GROUP BY order_id)""", f"""w AS (
  SELECT (epoch_us(max(ts)) // 1000) * 1000 - {_INVOICE_DELAY_US} AS wm FROM invoice_events)""", f"""x AS (
  SELECT *, coalesce(epoch_us(p) < epoch_us(c) + {_INVOICE_US}, false) AS paid FROM o, w)"""]) + f"""
SELECT order_id, c AS create_ts, p AS pay_ts, 'payed successfully' AS result, 'payed' AS output FROM x WHERE paid
UNION ALL
SELECT order_id, c, NULL, 'time out', 'timeout' FROM x WHERE NOT paid AND epoch_us(c) + {_INVOICE_US} <= wm
UNION ALL
SELECT order_id, NULL, p, 'already payed but not found create log', 'timeout' FROM x WHERE NOT paid AND epoch_us(p) <= wm""")
def stream_open_orders(spark, sf_dir):
    """Invoices and payments meet at once and cancel their timers; what is left is reported when its timer fires."""
    feed = Feed(spark, sf_dir, "orders", batches=2, disorder=ORDER_DISORDER)
    with state_store(spark):
        out = SP.stream_open_orders(views.invoice_events(spark, sf_dir, streaming=feed), INVOICE_TIMEOUT, INVOICE_DELAY)
        return run_to_table(out, "open_orders", feed)


# -- late rows inside the grace ----------------------------------------------------

GRACE_BATCHES, GRACE_MAX_MS = 6, 10_800_001
_LATE_SQL = f"(event_id * 7919 % {GRACE_MAX_MS}) * 1000"
_WAIT_US = O.us("10 minutes") + O.us("1 hour")


@register("stream_url_counts_updated", f"""
WITH a AS (
  SELECT *, epoch_us(ts) + {_LATE_SQL} AS arrival FROM events),
e AS (SELECT min(arrival) AS lo, max(arrival) + 1 AS hi FROM a),
cut AS (SELECT k, lo + (hi - lo) * k // {GRACE_BATCHES} AS start FROM e, range(0, {GRACE_BATCHES}) r(k)),
b AS (SELECT a.*, (SELECT max(k) FROM cut WHERE start <= arrival) AS k FROM a),
m AS (SELECT k, max(epoch_us(ts)) AS top FROM b GROUP BY k),
wm AS (SELECT cut.k, max(top) // 1000 * 1000 - {_WAIT_US} AS wm FROM cut LEFT JOIN m ON m.k < cut.k GROUP BY cut.k),
v AS (SELECT b.k, b.ts, p.url FROM b JOIN pages p
      ON p.page_id = ({O.ITEM.format(a='b.')} * {O.ITEM.format(a='b.')} + b.user_id) % (SELECT count(*) FROM pages)),
x AS (SELECT v.url, v.k, epoch_us(v.ts) // {O.us('15 minutes')} + g.s AS e FROM v, generate_series(1, 4) g(s)),
y AS (SELECT x.* FROM x JOIN wm USING (k) WHERE wm IS NULL OR e * {O.us('15 minutes')} > wm)
SELECT {O.window_bounds('e', '1 hour', '15 minutes')}, url, count(*) AS cnt, count(DISTINCT k) AS versions FROM y GROUP BY e, url""")
def stream_url_counts_updated(spark, sf_dir):
    """URL counts with 10 minutes of disorder and an hour of grace, rows up to three hours late: rows in the grace
    replace their window's count, later ones are dropped."""
    late = F.pmod(F.col("event_id") * 7919, F.lit(GRACE_MAX_MS)) * 1000
    feed = Feed(spark, sf_dir, "events", batches=GRACE_BATCHES, late_us=late)
    counts = SW.stream_window_updates(views.access_log(spark, sf_dir, streaming=feed), "ts", ["url"], "1 hour", "15 minutes",
                                      delay="10 minutes", lateness="1 hour")
    return run_upserts_to_table(counts, ["window_start", "window_end", "url"], "url_counts", feed)


# -- one row per view, and its last value per window --------------------------------

_PER_VIEW = O.with_views("user_behavior", extra=[f"""v AS (
  SELECT user_id, ts, seq, epoch_us(ts) // {HOUR_US} AS w, {O.slot_sql('user_id')} AS slot
  FROM user_behavior WHERE behavior = 'pv')""", """f AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY w, slot ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS first_view FROM v)""",
    f"""r AS (
  SELECT {O.tumbling_bounds('w', '1 hour')}, ts, seq, user_id,
         CAST(sum(first_view) OVER (PARTITION BY w ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS uv
  FROM f)""", "wm AS (SELECT " + _wm("user_behavior", "behavior = 'pv'") + " AS wm)"])


def _uv_per_view(spark, sf_dir, run):
    feed = _events(spark, sf_dir)
    with state_store(spark):
        return run(SP.stream_uv_per_view(_views(spark, sf_dir, feed), "1 hour", DELAY), feed)


@register("stream_uv_per_view", _PER_VIEW + "SELECT r.* FROM r, wm WHERE ts <= wm")
def stream_uv_per_view(spark, sf_dir):
    return _uv_per_view(spark, sf_dir, lambda df, feed: run_to_table(df, "uv_per_view", feed))


@register("stream_uv_latest", _PER_VIEW + """
SELECT window_start, window_end, max(uv) AS uv FROM r, wm WHERE ts <= wm GROUP BY window_start, window_end""")
def stream_uv_latest(spark, sf_dir):
    """The running count written under its window's key, the last value staying."""
    keys = ["window_start", "window_end"]
    return _uv_per_view(spark, sf_dir, lambda df, feed: run_upserts_to_table(
        df.select(*keys, "uv"), keys, "uv_latest", feed, "append", order="uv")).drop("versions")


# -- ranking inside the streaming plan ----------------------------------------------

@register("stream_hot_items_ranked",
          "SELECT * FROM (" + O.topn_sql("user_behavior", "behavior = 'pv'", "item_id", "60 minutes", "5 minutes", 3)
          + ") t WHERE window_end <= " + _wm("events", "event_type = 'view'"))
def stream_hot_items_ranked(spark, sf_dir):
    feed = _events(spark, sf_dir)
    with state_store(spark):
        return run_to_table(SP.stream_topn(_views(spark, sf_dir, feed), "item_id", "60 minutes", "5 minutes", 3, DELAY),
                            "hot_items_ranked", feed)


@register("stream_hot_urls_ranked",
          "SELECT * FROM (" + O.topn_sql("access_log", "", "url", "1 day", "1 hour", 5)
          + ") t WHERE window_end <= " + _wm("events", "", LATE_US))
def stream_hot_urls_ranked(spark, sf_dir):
    feed = Feed(spark, sf_dir, "events", disorder=LATE)
    with state_store(spark):
        return run_to_table(SP.stream_topn(views.access_log(spark, sf_dir, streaming=feed), "url", "1 day", "1 hour", 5, LATE),
                            "hot_urls_ranked", feed)


# -- side outputs into their own sinks ------------------------------------------------

@register("stream_tx_side_outputs", _TX_RECONCILE_SQL)
def stream_tx_side_outputs(spark, sf_dir):
    """Matched pairs and both unmatched sides, each in a sink of its own, with state by (tx id, time bucket)."""
    pays = Feed(spark, sf_dir, ("orders", "lineitem"), disorder=ORDER_DISORDER)
    with state_store(spark):
        out = SJ.stream_tx_reconcile(views.order_events(spark, sf_dir, streaming=pays),
                                     views.receipts(spark, sf_dir, streaming=pays), TX_BOUND, TX_DELAY, bucket="400 days")
        return run_side_outputs(out, ["matched", "unmatched_pay", "unmatched_receipt"], "tx_side_outputs", pays)


@register("stream_ad_click_side_outputs", O.with_views("ad_click", extra=[_RANKED])
          + f"SELECT user_id, ad_id, ts, seq, CASE WHEN rn <= {CAP} THEN 'main' ELSE 'blacklist' END AS tag FROM r "
            f"WHERE rn <= {CAP + 1} AND ts <= " + _wm("ad_click"))
def stream_ad_click_side_outputs(spark, sf_dir):
    """Clicks under the cap and the blacklist warnings, each in a sink of its own."""
    feed = _events(spark, sf_dir)
    with state_store(spark):
        out = SP.stream_click_cap(views.ad_click(spark, sf_dir, streaming=feed), CAP, reset=None, delay=DELAY)
        return run_side_outputs(out.select("user_id", "ad_id", "ts", "seq", "tag"), ["main", "blacklist"], "click_sides", feed)
