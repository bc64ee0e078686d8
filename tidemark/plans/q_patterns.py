"""Pattern-vocabulary queries on the raw per-user event stream.

Steps use the event types of ``events`` (view, click, purchase, signup, error);
the time bound is one day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources import views
from . import oracle as O
from .catalog import register

WITHIN = "1 day"
W = O.us(WITHIN)


def _ev(spark, sf_dir):
    return views.user_events(spark, sf_dir)


def et(x):
    return F.col("event_type") == x


_LEAD = """o AS (
  SELECT *, lead(event_type) OVER w AS nt, lead(ts) OVER w AS nts, lead(seq) OVER w AS nseq
  FROM user_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))"""

_FIRST_PURCHASE_AFTER_VIEW = """nb AS (
  SELECT a.user_id, a.ts, a.seq,
         arg_min(b.ts, (b.ts, b.seq)) AS bts, arg_min(b.seq, (b.ts, b.seq)) AS bseq
  FROM user_events a JOIN user_events b
    ON a.user_id = b.user_id AND b.event_type = 'purchase'
   AND (b.ts > a.ts OR (b.ts = a.ts AND b.seq > a.seq))
  WHERE a.event_type = 'view'
  GROUP BY a.user_id, a.ts, a.seq)"""

PAIR = "user_id, ts AS first_ts, seq AS first_seq, {t} AS second_ts, {s} AS second_seq"


@register("seq_next", O.with_views("user_events", extra=[_LEAD])
          + f"SELECT {PAIR.format(t='nts', s='nseq')} FROM o WHERE event_type = 'view' "
            f"AND nt = 'purchase' AND epoch_us(nts) - epoch_us(ts) < {W}")
def seq_next(spark, sf_dir):
    return S.seq_next(_ev(spark, sf_dir), "user_id", et("view"), et("purchase"), WITHIN)


@register("seq_followed_by", O.with_views("user_events", extra=[_FIRST_PURCHASE_AFTER_VIEW])
          + f"SELECT {PAIR.format(t='bts', s='bseq')} FROM nb WHERE epoch_us(bts) - epoch_us(ts) < {W}")
def seq_followed_by(spark, sf_dir):
    return S.seq_followed_by(_ev(spark, sf_dir), "user_id", et("view"), et("purchase"), WITHIN)


@register("seq_followed_by_any", O.with_views("user_events") + f"""
SELECT a.user_id, a.ts AS first_ts, a.seq AS first_seq, b.ts AS second_ts, b.seq AS second_seq
FROM user_events a JOIN user_events b
  ON a.user_id = b.user_id AND b.event_type = 'purchase'
 AND (b.ts > a.ts OR (b.ts = a.ts AND b.seq > a.seq))
 AND epoch_us(b.ts) - epoch_us(a.ts) < {W}
WHERE a.event_type = 'view'""")
def seq_followed_by_any(spark, sf_dir):
    return S.seq_followed_by_any(_ev(spark, sf_dir), "user_id", et("view"), et("purchase"), WITHIN)


@register("seq_not_next", O.with_views("user_events", extra=[_LEAD])
          + f"SELECT {PAIR.format(t='nts', s='nseq')} FROM o WHERE event_type = 'signup' "
            "AND nt IS NOT NULL AND nt <> 'view'")
def seq_not_next(spark, sf_dir):
    return S.seq_not_next(_ev(spark, sf_dir), "user_id", et("signup"), et("view"))


@register("seq_not_followed_by", O.with_views("user_events", extra=[_FIRST_PURCHASE_AFTER_VIEW])
          + f"SELECT {PAIR.format(t='bts', s='bseq')} FROM nb WHERE epoch_us(bts) - epoch_us(ts) < {W} "
            "AND NOT EXISTS (SELECT 1 FROM user_events x WHERE x.user_id = nb.user_id "
            "AND x.event_type = 'error' AND (x.ts > nb.ts OR (x.ts = nb.ts AND x.seq > nb.seq)) "
            "AND (x.ts < nb.bts OR (x.ts = nb.bts AND x.seq < nb.bseq)))")
def seq_not_followed_by(spark, sf_dir):
    return S.seq_not_followed_by(_ev(spark, sf_dir), "user_id", et("view"), et("error"),
                                 et("purchase"), WITHIN)


@register("seq_times", O.with_views("user_events", extra=["""r AS (
  SELECT *, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM user_events)"""])
          + "SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM r "
            "WHERE event_type = 'click' GROUP BY user_id, run HAVING count(*) >= 2")
def seq_times(spark, sf_dir):
    return S.seq_times(_ev(spark, sf_dir), "user_id", et("click"), 2)


@register("seq_until", O.with_views("user_events", extra=["""r AS (
  SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
  FROM user_events)"""])
          + "SELECT user_id, CAST(segment AS BIGINT) AS segment, min(ts) AS start_ts, max(ts) AS end_ts, "
            "count(*) AS n FROM r WHERE event_type = 'view' GROUP BY user_id, segment")
def seq_until(spark, sf_dir):
    return S.seq_until(_ev(spark, sf_dir), "user_id", et("view"), et("purchase"))


@register("seq_iterative", O.with_views("user_events", extra=["""r AS (
  SELECT *, sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM user_events)""", """p AS (
  SELECT *, CAST(value AS DECIMAL(24, 6)) AS v,
         sum(CAST(value AS DECIMAL(24, 6))) OVER w AS ps, count(*) OVER w AS pc
  FROM r WHERE event_type = 'purchase'
  WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""])
          + "SELECT user_id, ts, seq, value, CASE WHEN pc > 0 THEN CAST(ps AS DOUBLE) END AS prior_sum, "
            "CAST(pc AS BIGINT) AS prior_count FROM p WHERE pc = 0 OR v * pc > ps")
def seq_iterative(spark, sf_dir):
    return S.seq_iterative(_ev(spark, sf_dir), "user_id", et("purchase"), "value")


_OR_AND = """nb AS (
  SELECT a.user_id, a.ts, a.seq,
         arg_min(b.ts, (b.ts, b.seq)) AS bts, arg_min(b.seq, (b.ts, b.seq)) AS bseq
  FROM user_events a JOIN user_events b
    ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.value > 50
   AND (b.ts > a.ts OR (b.ts = a.ts AND b.seq > a.seq))
  WHERE a.event_type = 'view' OR a.event_type = 'click'
  GROUP BY a.user_id, a.ts, a.seq)"""


@register("seq_or_and", O.with_views("user_events", extra=[_OR_AND])
          + f"SELECT {PAIR.format(t='bts', s='bseq')} FROM nb WHERE epoch_us(bts) - epoch_us(ts) < {W}")
def seq_or_and(spark, sf_dir):
    """Steps with or / and conditions: a view or a click, then a purchase of more than 50."""
    return S.seq_followed_by(_ev(spark, sf_dir), "user_id", et("view") | et("click"),
                             et("purchase") & (F.col("value") > 50), WITHIN)


@register("seq_flat_select", O.with_views("user_events", extra=[_FIRST_PURCHASE_AFTER_VIEW])
          + f"SELECT user_id, 'view' AS step, ts, seq FROM nb WHERE epoch_us(bts) - epoch_us(ts) < {W} UNION ALL "
            f"SELECT user_id, 'purchase', bts, bseq FROM nb WHERE epoch_us(bts) - epoch_us(ts) < {W}")
def seq_flat_select(spark, sf_dir):
    """Flat selection: one output row for every step of every match."""
    pairs = S.seq_followed_by(_ev(spark, sf_dir), "user_id", et("view"), et("purchase"), WITHIN)
    steps = F.array(F.struct(F.lit("view").alias("step"), F.col("first_ts").alias("ts"), F.col("first_seq").alias("seq")),
                    F.struct(F.lit("purchase").alias("step"), F.col("second_ts").alias("ts"), F.col("second_seq").alias("seq")))
    return pairs.select("user_id", F.explode(steps).alias("s")).select("user_id", "s.*")


# -- longer patterns and bounded loops ----------------------------------------------

@register("seq_three_steps", O.with_views("user_events", extra=["""v AS (
  SELECT a.user_id, a.ts, a.seq, min((c.ts, c.seq)) AS c FROM user_events a JOIN user_events c
    ON c.user_id = a.user_id AND c.event_type = 'click' AND (c.ts, c.seq) > (a.ts, a.seq)
  WHERE a.event_type = 'view' GROUP BY ALL)""", """p AS (
  SELECT v.user_id, v.ts, v.seq, v.c, min((b.ts, b.seq)) AS p FROM v JOIN user_events b
    ON b.user_id = v.user_id AND b.event_type = 'purchase' AND (b.ts, b.seq) > v.c
  GROUP BY ALL)"""]) + f"""
SELECT user_id, ts AS view_ts, seq AS view_seq, c[1] AS click_ts, c[2] AS click_seq, p[1] AS buy_ts, p[2] AS buy_seq
FROM p WHERE epoch_us(p[1]) - epoch_us(ts) < {W}""")
def seq_three_steps(spark, sf_dir):
    """A view, the first click after it, the first purchase after that, within a day."""
    return S.seq_chain(_ev(spark, sf_dir), "user_id",
                       [S.Step("view", et("view")), S.Step("click", et("click")), S.Step("buy", et("purchase"))], WITHIN)


LOOP_WITHIN = "3 days"
_LOOP_US = O.us(LOOP_WITHIN)


@register("seq_bounded_loop", O.with_views("user_events", extra=["""o AS (
  SELECT user_id, ts, seq, event_type IN ('view', 'click') AS hit,
         [lead(CASE WHEN event_type IN ('view', 'click') THEN (ts, seq) END, 1) OVER w,
          lead(CASE WHEN event_type IN ('view', 'click') THEN (ts, seq) END, 2) OVER w,
          lead(CASE WHEN event_type IN ('view', 'click') THEN (ts, seq) END, 3) OVER w] AS nx
  FROM user_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))""", """l AS (
  SELECT user_id, ts, seq, n, nx[n - 1] AS z FROM o, range(2, 5) r(n)
  WHERE hit AND len(list_filter(nx[1:n - 1], lambda x: x IS NOT NULL)) = n - 1)""", """b AS (
  SELECT l.user_id, l.ts, l.seq, l.n, l.z, min((b.ts, b.seq)) AS p FROM l JOIN user_events b
    ON b.user_id = l.user_id AND b.event_type = 'purchase' AND (b.ts, b.seq) > l.z
  GROUP BY ALL)"""]) + f"""
SELECT user_id, ts AS look_ts, seq AS look_seq, z[1] AS look_last_ts, CAST(n AS INTEGER) AS look_n, p[1] AS buy_ts, p[2] AS buy_seq
FROM b WHERE epoch_us(p[1]) - epoch_us(ts) < {_LOOP_US}
QUALIFY row_number() OVER (PARTITION BY user_id, ts, seq ORDER BY n DESC) = 1""")
def seq_bounded_loop(spark, sf_dir):
    """Two to four views or clicks in a row, then the first purchase, within three days."""
    return S.seq_chain(_ev(spark, sf_dir), "user_id",
                       [S.Step("look", et("view") | et("click"), times=(2, 4)), S.Step("buy", et("purchase"))], LOOP_WITHIN)
