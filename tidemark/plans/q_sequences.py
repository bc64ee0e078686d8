"""Login-failure queries (pattern, consecutive pair, burst).

Parameters: the test events are spread over 30 days, so the 2 s bounds of the
reports are widened to 2 hours / 1 day to produce matches.
"""

from __future__ import annotations

from ..operators import login
from ..sources import views
from . import oracle as O
from .catalog import register

PATTERN_WITHIN = "2 hours"
CONSECUTIVE_WITHIN = "1 day"
BURST_WINDOW = "1 day"

_PAIRS = """o AS (
  SELECT *, lag(event_type) OVER w AS prev_type, lag(ts) OVER w AS prev_ts
  FROM login WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))"""


def _pairs_sql(within, message: str) -> str:
    return (O.with_views("login", extra=[_PAIRS])
            + f"SELECT user_id, prev_ts AS first_fail_ts, ts AS last_fail_ts, '{message}' AS warning "
              f"FROM o WHERE event_type = 'fail' AND prev_type = 'fail' "
              f"AND epoch_us(ts) - epoch_us(prev_ts) < {O.us(within)}")


@register("login_fail_pattern", _pairs_sql(PATTERN_WITHIN, "login fail!"))
def login_fail_pattern(spark, sf_dir):
    return login.login_fail_pattern(views.login(spark, sf_dir), PATTERN_WITHIN)


@register("login_fail_consecutive", _pairs_sql(CONSECUTIVE_WITHIN, "login fail in 2 seconds"))
def login_fail_consecutive(spark, sf_dir):
    return login.login_fail_consecutive(views.login(spark, sf_dir), CONSECUTIVE_WITHIN)


def _burst_sql(window) -> str:
    w = O.us(window)
    secs = w // 1_000_000
    return O.with_views("login", extra=[
        """o AS (
  SELECT *, epoch_us(ts) AS us,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, seq) AS prev_type
  FROM login)""",
        """s AS (
  SELECT *, CASE WHEN event_type = 'fail' AND (prev_type IS NULL OR prev_type <> 'fail')
                 THEN 1 ELSE 0 END AS run_start
  FROM o)""",
        """r AS (
  SELECT *, sum(run_start) OVER (PARTITION BY user_id ORDER BY ts, seq
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no
  FROM s)""",
        "starts AS (SELECT user_id, run_no, us AS t0, ts AS first_ts, seq AS fseq FROM r WHERE run_start = 1)",
        """nxt AS (
  SELECT st.user_id, st.run_no, min(l.us) AS next_ok
  FROM starts st JOIN r l ON l.user_id = st.user_id AND l.event_type = 'success'
       AND (l.us > st.t0 OR (l.us = st.t0 AND l.seq > st.fseq))
  GROUP BY st.user_id, st.run_no)""",
        f"""agg AS (
  SELECT r.user_id, r.run_no, count(*) AS n, max(r.ts) AS last_ts
  FROM r JOIN starts st ON r.user_id = st.user_id AND r.run_no = st.run_no
  WHERE r.event_type = 'fail' AND r.us <= st.t0 + {w}
  GROUP BY r.user_id, r.run_no)"""]) + f"""
SELECT st.user_id, st.first_ts AS first_fail_ts, agg.last_ts AS last_fail_ts,
       'login fail in {secs} seconds ' || CAST(agg.n AS VARCHAR) || ' times' AS warning
FROM starts st JOIN agg ON st.user_id = agg.user_id AND st.run_no = agg.run_no
     LEFT JOIN nxt ON st.user_id = nxt.user_id AND st.run_no = nxt.run_no
WHERE agg.n >= 2 AND (nxt.next_ok IS NULL OR nxt.next_ok > st.t0 + {w})"""


@register("login_fail_burst", _burst_sql(BURST_WINDOW))
def login_fail_burst(spark, sf_dir):
    return login.login_fail_burst(views.login(spark, sf_dir), BURST_WINDOW, 2)
