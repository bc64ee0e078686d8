"""Two-stream joins: interval join, reconciliation with unmatched sides, window join.

``interval_join`` pairs left row l and right row r with the same key and
``l.ts + lower <= r.ts <= l.ts + upper`` (both ends inclusive).  Instead of
joining on the key alone and filtering every pair of a key, the time axis is cut
into buckets of width ``upper - lower``: a right row sits in one bucket, a left
row is copied to the (at most two) buckets its interval touches, and the join is
an equi-join on (key, bucket) plus the exact range test.  A key with many rows is
thus split by time, and each qualifying pair is produced exactly once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us, ifloor, to_micros

# The reconciliation bound and the receipt-less transaction filter.
RECONCILE_BOUND = "5 seconds"


def _range_buckets(df: DataFrame, us: Column, lo: int, hi: int, width: int) -> DataFrame:
    """Copy each row to the buckets of width ``width`` that [us + lo, us + hi] touches."""
    return df.withColumn("_b", F.explode(F.sequence(ifloor(us + F.lit(lo), width),
                                                    ifloor(us + F.lit(hi), width))))


def interval_join(left: DataFrame, right: DataFrame, key: str, lower, upper, *,
                  left_ts: str = "ts", right_ts: str = "ts", bucket=None,
                  left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Inner interval join.  Output columns are the inputs' columns with prefixes
    (the key once, unprefixed)."""
    lo, hi = duration_us(lower), duration_us(upper)
    if hi < lo:
        raise ValueError("upper bound below lower bound")
    width = duration_us(bucket) if bucket is not None else max(hi - lo, 1)
    lus, rus = to_micros(left, left_ts), to_micros(right, right_ts)
    lcols = [c for c in left.columns if c != key]
    rcols = [c for c in right.columns if c != key]
    l2 = left.select(F.col(key), *[F.col(c).alias(left_prefix + c) for c in lcols],
                     lus.alias("_lus"))
    l2 = _range_buckets(l2, F.col("_lus"), lo, hi, width)
    r2 = right.select(F.col(key), *[F.col(c).alias(right_prefix + c) for c in rcols],
                      rus.alias("_rus"))
    r2 = r2.withColumn("_b", ifloor(F.col("_rus"), width))
    j = l2.join(r2, [key, "_b"]).where(
        (F.col("_rus") >= F.col("_lus") + F.lit(lo)) & (F.col("_rus") <= F.col("_lus") + F.lit(hi)))
    return j.drop("_b", "_lus", "_rus")


def interval_anti_join(left: DataFrame, right: DataFrame, key: str, lower, upper, *,
                       left_ts: str = "ts", right_ts: str = "ts", bucket=None) -> DataFrame:
    """Rows of ``left`` with no ``right`` row of the same key in [l.ts + lower, l.ts + upper].

    Left rows keep a single bucket (so each appears once); right rows are copied
    to the buckets of the left times they can match, [r.ts - upper, r.ts - lower].
    """
    lo, hi = duration_us(lower), duration_us(upper)
    width = duration_us(bucket) if bucket is not None else max(hi - lo, 1)
    l2 = left.withColumn("_lus", to_micros(left, left_ts))
    l2 = l2.withColumn("_b", ifloor(F.col("_lus"), width))
    r2 = right.select(F.col(key).alias("_rk"), to_micros(right, right_ts).alias("_rus"))
    r2 = _range_buckets(r2, F.col("_rus"), -hi, -lo, width).withColumnRenamed("_b", "_rb")
    cond = ((l2[key] == r2["_rk"]) & (l2["_b"] == r2["_rb"])
            & (r2["_rus"] >= l2["_lus"] + F.lit(lo)) & (r2["_rus"] <= l2["_lus"] + F.lit(hi)))
    return l2.join(r2, cond, "left_anti").drop("_b", "_lus")


def _pays(order_events: DataFrame) -> DataFrame:
    # Only pays carry a transaction id; creates are dropped before matching.
    return order_events.where(F.col("tx_id") != "").select(
        "tx_id", "order_id", "event_type", "ts", "seq")


def tx_pairs(order_events: DataFrame, receipts: DataFrame, bound=RECONCILE_BOUND) -> DataFrame:
    """Every (pay, receipt) pair with the same tx id and |receipt.ts - pay.ts| <= bound.

    Columns: tx_id, order_id, pay_ts, pay_seq, pay_channel, receipt_ts, receipt_seq.
    """
    pays = _pays(order_events)
    rec = receipts.select("tx_id", "pay_channel", "ts", "seq")
    b = dt.timedelta(microseconds=duration_us(bound))
    j = interval_join(pays, rec, "tx_id", -b, b)
    return j.select("tx_id", F.col("l_order_id").alias("order_id"), F.col("l_ts").alias("pay_ts"),
                    F.col("l_seq").alias("pay_seq"), F.col("r_pay_channel").alias("pay_channel"),
                    F.col("r_ts").alias("receipt_ts"), F.col("r_seq").alias("receipt_seq"))


def tx_unmatched_pays(order_events: DataFrame, receipts: DataFrame, bound=RECONCILE_BOUND) -> DataFrame:
    """Pays with no receipt inside the bound: tx_id, order_id, ts, seq."""
    b = dt.timedelta(microseconds=duration_us(bound))
    pays = _pays(order_events).select("tx_id", "order_id", "ts", "seq")
    return interval_anti_join(pays, receipts.select("tx_id", "ts"), "tx_id", -b, b)


def tx_unmatched_receipts(order_events: DataFrame, receipts: DataFrame, bound=RECONCILE_BOUND) -> DataFrame:
    """Receipts with no pay inside the bound: tx_id, pay_channel, ts, seq."""
    b = dt.timedelta(microseconds=duration_us(bound))
    rec = receipts.select("tx_id", "pay_channel", "ts", "seq")
    return interval_anti_join(rec, _pays(order_events).select("tx_id", "ts"), "tx_id", -b, b)


def tx_reconcile(order_events: DataFrame, receipts: DataFrame, bound=RECONCILE_BOUND, bucket=None) -> DataFrame:
    """All three outputs in one frame with a ``tag`` column:
    'matched', 'unmatched_pay', 'unmatched_receipt'.  Rows without a time take no part.

    One full outer join on (tx id, time bucket) decides all of them.  Both sides are copied to the buckets within
    the bound, so a row meets every partner in its own bucket, and what a copy finds there does not count.  ``bucket``
    is the width: a wide one makes few copies, a narrow one splits a tx id with many rows finer."""
    reach = duration_us(bound)
    width = duration_us(bucket) if bucket is not None else max(8 * reach, 1)

    def side(df: DataFrame, p: str, cols: list[str]) -> DataFrame:
        us = to_micros(df, "ts")
        return _range_buckets(df, us, -reach, reach, width).select(*[F.col(c).alias(p + c) for c in (*cols, "_b")])

    def us_home(df: DataFrame, p: str) -> tuple[Column, Column]:
        us = to_micros(df, p + "ts")
        return us, F.col(p + "_b") == ifloor(us, width)

    pays = side(_pays(order_events), "p_", ["tx_id", "order_id", "ts", "seq"])
    recs = side(receipts, "r_", ["tx_id", "pay_channel", "ts", "seq"])
    (p_us, p_home), (r_us, r_home) = us_home(pays, "p_"), us_home(recs, "r_")
    near = (F.col("p_tx_id") == F.col("r_tx_id")) & (F.col("p__b") == F.col("r__b")) & (p_home | r_home) \
        & (r_us - p_us >= F.lit(-reach)) & (r_us - p_us <= F.lit(reach))
    # A pair counts in the pay's own bucket, a lone row in its own.
    j = pays.join(recs, near, "fullOuter").where(F.coalesce(p_home, r_home))
    return j.select(
        F.coalesce("p_tx_id", "r_tx_id").alias("tx_id"), F.col("p_order_id").alias("order_id"),
        F.col("p_ts").alias("pay_ts"), F.col("p_seq").alias("pay_seq"), F.col("r_pay_channel").alias("pay_channel"),
        F.col("r_ts").alias("receipt_ts"), F.col("r_seq").alias("receipt_seq"),
        F.when(F.col("p_ts").isNull(), F.lit("unmatched_receipt")).when(F.col("r_ts").isNull(), F.lit("unmatched_pay"))
        .otherwise(F.lit("matched")).alias("tag"))


def tx_window_join(order_events: DataFrame, receipts: DataFrame, size) -> DataFrame:
    """Pairs with the same tx id inside the same tumbling window.

    Columns: tx_id, order_id, pay_ts, pay_channel, receipt_ts, window_start, window_end.
    """
    from ..functions.time import micros_to_ts, ts_type
    w = duration_us(size)
    pays = _pays(order_events)
    pays = pays.select("tx_id", "order_id", F.col("ts").alias("pay_ts"),
                       ifloor(to_micros(pays, "ts"), w).alias("_w"))
    rec = receipts.select("tx_id", "pay_channel", F.col("ts").alias("receipt_ts"),
                          ifloor(to_micros(receipts, "ts"), w).alias("_w"))
    like = ts_type(receipts, "ts")
    return pays.join(rec, ["tx_id", "_w"]).select(
        "tx_id", "order_id", "pay_ts", "pay_channel", "receipt_ts",
        micros_to_ts(F.col("_w") * F.lit(w), like).alias("window_start"),
        micros_to_ts((F.col("_w") + 1) * F.lit(w), like).alias("window_end"))
