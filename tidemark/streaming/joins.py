"""Reconciliation of two streams with watermarks on both inputs.

Pays and receipts are matched in groups that hold their rows in packed state until the watermark (the minimum over both
inputs) has passed ``ts + bound``: see :class:`~tidemark.streaming.processors.Reconciler`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import as_event_time, duration_us, micros_to_ts
from .processors import Reconciler, reconcile


def stream_tx_reconcile(order_events: DataFrame, receipts: DataFrame, bound="5 seconds",
                        delay="0 seconds", bucket=None) -> DataFrame:
    """Full outer interval join of pays and receipts on tx id, |dt| <= bound.

    Columns: tx_id, order_id, pay_ts, pay_channel, receipt_ts, tag
    ('matched' | 'unmatched_pay' | 'unmatched_receipt').

    With a ``bucket`` (at least twice the bound) the state is keyed by time bucket too, so a tx id with very many
    rows is split by time: each row is copied to the at most two buckets that it can match, and the bucket it lies
    in decides on it.  That holds about twice the rows of the plain form.
    """
    b, d = duration_us(bound), duration_us(delay)
    width = None if bucket is None else duration_us(bucket)
    if width is not None and width < 2 * b:
        raise ValueError("the bucket must be at least twice the bound")
    pays = as_event_time(order_events.where(F.col("tx_id") != ""), "ts", "_et") \
        .select("tx_id", "order_id", "_et").where(F.col("_et").isNotNull()).withWatermark("_et", f"{d} microseconds")
    recs = as_event_time(receipts, "ts", "_et") \
        .select("tx_id", "pay_channel", "_et").where(F.col("_et").isNotNull()).withWatermark("_et", f"{d} microseconds")
    j = reconcile(pays, recs, b, width)
    has = lambda c: F.col("nulls").bitwiseAND(1 << Reconciler.NULLS.index(c)) == 0
    pay, receipt = F.col("tag") != Reconciler.LONE_RECEIPT, F.col("tag") != Reconciler.LONE_PAY
    tag = (F.when(pay & receipt, F.lit("matched"))
           .when(pay, F.lit("unmatched_pay"))
           .otherwise(F.lit("unmatched_receipt")))
    return j.select(F.when(has("tx_id"), F.col("tx_id")).alias("tx_id"),
                    F.when(pay & has("order_id"), F.col("order_id")).alias("order_id"),
                    F.when(pay, micros_to_ts(F.col("pay_us"))).alias("pay_ts"),
                    F.when(receipt & has("pay_channel"), F.col("pay_channel")).alias("pay_channel"),
                    F.when(receipt, micros_to_ts(F.col("receipt_us"))).alias("receipt_ts"), tag.alias("tag"))
