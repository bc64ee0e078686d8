"""Payment reconciliation queries (pays x receipts).  Ship dates are days
apart, so the 5 s bound is widened to 200 days."""

from __future__ import annotations

from ..operators import joins
from ..sources import views
from . import oracle as O
from .catalog import register

BOUND = "200 days"
B = O.us(BOUND)
WINDOW = "30 days"
W = O.us(WINDOW)

_PAIRS = f"""pays AS (SELECT * FROM order_events WHERE tx_id <> ''),
pairs AS (
  SELECT p.tx_id, p.order_id, p.ts AS pay_ts, p.seq AS pay_seq, r.pay_channel,
         r.ts AS receipt_ts, r.seq AS receipt_seq
  FROM pays p JOIN receipts r ON p.tx_id = r.tx_id
   AND epoch_us(r.ts) BETWEEN epoch_us(p.ts) - {B} AND epoch_us(p.ts) + {B})"""


def _sql(select: str) -> str:
    return O.with_views("order_events", "receipts", extra=[_PAIRS]) + select


@register("tx_interval_join", _sql("SELECT * FROM pairs"))
def tx_interval_join(spark, sf_dir):
    return joins.tx_pairs(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), BOUND)


@register("tx_matched", _sql("SELECT * FROM pairs"))
def tx_matched(spark, sf_dir):
    return joins.tx_reconcile(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), BOUND) \
        .where("tag = 'matched'").drop("tag")


_NO_RECEIPT = (f"NOT EXISTS (SELECT 1 FROM receipts r WHERE r.tx_id = p.tx_id "
               f"AND epoch_us(r.ts) BETWEEN epoch_us(p.ts) - {B} AND epoch_us(p.ts) + {B})")
_NO_PAY = (f"NOT EXISTS (SELECT 1 FROM pays p WHERE p.tx_id = r.tx_id "
           f"AND epoch_us(r.ts) BETWEEN epoch_us(p.ts) - {B} AND epoch_us(p.ts) + {B})")


@register("tx_unmatched_pays", _sql(f"SELECT tx_id, order_id, ts, seq FROM pays p WHERE {_NO_RECEIPT}"))
def tx_unmatched_pays(spark, sf_dir):
    return joins.tx_unmatched_pays(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), BOUND)


@register("tx_unmatched_receipts", _sql(f"SELECT tx_id, pay_channel, ts, seq FROM receipts r WHERE {_NO_PAY}"))
def tx_unmatched_receipts(spark, sf_dir):
    return joins.tx_unmatched_receipts(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), BOUND)


@register("tx_reconcile", _sql(
    "SELECT *, 'matched' AS tag FROM pairs UNION ALL "
    f"SELECT tx_id, order_id, ts, seq, NULL, NULL, NULL, 'unmatched_pay' FROM pays p WHERE {_NO_RECEIPT} "
    "UNION ALL "
    f"SELECT tx_id, NULL, NULL, NULL, pay_channel, ts, seq, 'unmatched_receipt' FROM receipts r WHERE {_NO_PAY}"))
def tx_reconcile(spark, sf_dir):
    return joins.tx_reconcile(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), BOUND)


@register("tx_window_join", O.with_views("order_events", "receipts") + f"""
SELECT p.tx_id, p.order_id, p.ts AS pay_ts, r.pay_channel, r.ts AS receipt_ts,
       make_timestamp((epoch_us(p.ts) // {W}) * {W}) AS window_start,
       make_timestamp((epoch_us(p.ts) // {W} + 1) * {W}) AS window_end
FROM order_events p JOIN receipts r ON p.tx_id = r.tx_id
 AND epoch_us(p.ts) // {W} = epoch_us(r.ts) // {W}
WHERE p.tx_id <> ''""")
def tx_window_join(spark, sf_dir):
    return joins.tx_window_join(views.order_events(spark, sf_dir), views.receipts(spark, sf_dir), WINDOW)
