"""Order timeout queries.  The orders span years, so the 15 min timeout is
widened to 400 days to split the orders between paid and timed out."""

from __future__ import annotations

from ..operators import orders
from ..sources import views
from . import oracle as O
from .catalog import register

TIMEOUT = "400 days"
T = O.us(TIMEOUT)

_PATTERN = """np AS (
  SELECT c.order_id, c.ts AS create_ts, c.seq,
         arg_min(p.ts, (epoch_us(p.ts), p.seq)) AS pay_ts
  FROM order_events c LEFT JOIN order_events p
    ON p.order_id = c.order_id AND p.event_type = 'pay'
   AND (p.ts > c.ts OR (p.ts = c.ts AND p.seq > c.seq))
  WHERE c.event_type = 'create'
  GROUP BY c.order_id, c.ts, c.seq)"""


@register("order_payed_pattern", O.with_views("order_events", extra=[_PATTERN])
          + f"SELECT order_id, create_ts, pay_ts, 'payed success' AS result FROM np "
            f"WHERE pay_ts IS NOT NULL AND epoch_us(pay_ts) - epoch_us(create_ts) < {T}")
def order_payed_pattern(spark, sf_dir):
    return orders.order_payed_pattern(views.order_events(spark, sf_dir), TIMEOUT)


@register("order_timeout_pattern", O.with_views("order_events", extra=[_PATTERN])
          + f"SELECT order_id, create_ts, 'timeout' AS result FROM np "
            f"WHERE pay_ts IS NULL OR epoch_us(pay_ts) - epoch_us(create_ts) >= {T}")
def order_timeout_pattern(spark, sf_dir):
    return orders.order_timeout_pattern(views.order_events(spark, sf_dir), TIMEOUT)


ORACLE_STATUS = (O.with_views("order_events", extra=[_PATTERN, """pb AS (
  SELECT DISTINCT c.order_id, c.seq FROM order_events c JOIN order_events p
    ON p.order_id = c.order_id AND p.event_type = 'pay'
   AND (p.ts < c.ts OR (p.ts = c.ts AND p.seq < c.seq))
  WHERE c.event_type = 'create')"""])
          + "SELECT np.order_id, np.create_ts, CASE WHEN np.pay_ts IS NOT NULL AND "
            f"epoch_us(np.pay_ts) <= epoch_us(np.create_ts) + {T} THEN 'order payed successfully' "
            "ELSE 'order timeout' END AS result FROM np ANTI JOIN pb ON np.order_id = pb.order_id "
            "AND np.seq = pb.seq")


@register("order_timeout_status", ORACLE_STATUS)
def order_timeout_status(spark, sf_dir):
    return orders.order_timeout_status(views.order_events(spark, sf_dir), TIMEOUT)


@register("order_pay_match", O.with_views("order_events", extra=[f"""po AS (
  SELECT order_id,
         min(CASE WHEN event_type = 'create' THEN epoch_us(ts) END) AS c,
         min(CASE WHEN event_type = 'pay' THEN epoch_us(ts) END) AS p
  FROM order_events GROUP BY order_id)""", f"""res AS (
  SELECT order_id, CASE
      WHEN c IS NOT NULL AND p IS NOT NULL AND p < c + {T} THEN 'payed successfully'
      WHEN c IS NOT NULL AND p IS NOT NULL THEN 'payed but already timeout'
      WHEN c IS NOT NULL THEN 'time out'
      ELSE 'already payed but not found create log' END AS result
  FROM po)"""])
          + "SELECT order_id, result, CASE WHEN result = 'payed successfully' THEN 'payed' "
            "ELSE 'timeout' END AS output FROM res")
def order_pay_match(spark, sf_dir):
    return orders.order_pay_match(views.order_events(spark, sf_dir), TIMEOUT)
