"""Order payment timeouts, three ways.

* pattern form (``order_payed_pattern`` / ``order_timeout_pattern``): each create
  is matched with the first later pay of the same order; the match counts when
  the pay is less than ``within`` after the create, otherwise the create times out;
* timer form (``order_timeout_status``): for each create that no pay preceded, the
  order is paid if a pay arrives by create + timeout (inclusive);
* match form (``order_pay_match``): one row per order from its first create and
  first pay, routed to the main ("payed") or the side ("timeout") output.

Ordered scans use the time-bucketed :class:`Timeline`; the match form is a single
partial aggregation per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us, to_micros
from .timeline import Timeline

# Event types, timeout, result texts.
CREATE, PAY = "create", "pay"
TIMEOUT = "15 minutes"
PAYED_SUCCESS = "payed success"
PATTERN_TIMEOUT = "timeout"
STATUS_PAYED = "order payed successfully"
STATUS_TIMEOUT = "order timeout"
MATCH_PAYED = "payed successfully"
MATCH_LATE = "payed but already timeout"
MATCH_NO_PAY = "time out"
MATCH_NO_CREATE = "already payed but not found create log"
ORDER_BUCKET = "1 day"


def _create_with_next_pay(df: DataFrame, within, bucket) -> DataFrame:
    tl = Timeline(df, "order_id", bucket=bucket, halo=within)
    tl.following("_pay", fields=["ts"], pred=F.col("event_type") == PAY)
    return tl.result().where(F.col("event_type") == CREATE)


def order_pattern(df: DataFrame, within=TIMEOUT, bucket=ORDER_BUCKET) -> DataFrame:
    """Both outputs of the create-followedBy-pay pattern with a tag column.

    Columns: order_id, create_ts, pay_ts (null on timeout), result, output.
    """
    limit = duration_us(within)
    c = _create_with_next_pay(df, within, bucket)
    ok = F.col("_pay").isNotNull() & (F.col("_pay.us") - F.col("_us") < F.lit(limit))
    return c.select(
        "order_id", F.col("ts").alias("create_ts"),
        F.when(ok, F.col("_pay.ts")).alias("pay_ts"),
        F.when(ok, F.lit(PAYED_SUCCESS)).otherwise(F.lit(PATTERN_TIMEOUT)).alias("result"),
        F.when(ok, F.lit("payed")).otherwise(F.lit("timeout")).alias("output"))


def order_payed_pattern(df: DataFrame, within=TIMEOUT, bucket=ORDER_BUCKET) -> DataFrame:
    return order_pattern(df, within, bucket).where(F.col("output") == "payed") \
        .select("order_id", "create_ts", "pay_ts", "result")


def order_timeout_pattern(df: DataFrame, within=TIMEOUT, bucket=ORDER_BUCKET) -> DataFrame:
    return order_pattern(df, within, bucket).where(F.col("output") == "timeout") \
        .select("order_id", "create_ts", "result")


def order_timeout_status(df: DataFrame, timeout=TIMEOUT, bucket=ORDER_BUCKET, memory=None) -> DataFrame:
    """(order_id, create_ts, result) for every create not preceded by a pay of the order
    (with ``memory``: by a pay at most that long before)."""
    limit = duration_us(timeout)
    is_pay = F.col("event_type") == PAY
    # Pays after the create matter within the timeout only, pays before it within the memory: bounded scans.
    known = 0 if memory is None else duration_us(memory)
    tl = Timeline(df, "order_id", bucket=bucket, halo=max(limit, known) / 1e6, look="following" if memory is None else "both")
    tl.following("_pay", pred=is_pay)
    if memory is not None:
        tl.prior("_paid_before", pred=is_pay)
        c = tl.result().where(F.col("event_type") == CREATE)
        c = c.where(F.col("_paid_before").isNull() | (F.col("_us") - F.col("_paid_before.us") > F.lit(known)))
    else:
        # Without a bound, a pay came before iff the order's first pay did: a partial aggregation.
        first = df.where(is_pay).groupBy(F.col("order_id").alias("_order")) \
            .agg(F.min(F.struct(to_micros(df, "ts").alias("us"), F.col("seq").alias("seq"))).alias("_first"))
        c = tl.result().where(F.col("event_type") == CREATE).join(first, F.col("order_id").eqNullSafe(F.col("_order")), "left")
        c = c.where(F.col("_first").isNull() | ~(F.col("_first") < F.struct(F.col("_us").alias("us"), F.col("seq").alias("seq"))))
    ok = F.col("_pay").isNotNull() & (F.col("_pay.us") <= F.col("_us") + F.lit(limit))
    return c.select("order_id", F.col("ts").alias("create_ts"),
                    F.when(ok, F.lit(STATUS_PAYED)).otherwise(F.lit(STATUS_TIMEOUT)).alias("result"))


def order_pay_match(df: DataFrame, timeout=TIMEOUT, horizon=None) -> DataFrame:
    """One row per order: (order_id, result, output) with output 'payed' or 'timeout'.

    The first create and the first pay decide if they are at most ``horizon`` apart (no bound if
    None); else the earlier of the two decides alone, as in a stream that waits that long.
    """
    limit = duration_us(timeout)
    us = to_micros(df, "ts")
    per_order = df.groupBy("order_id").agg(
        F.min(F.when(F.col("event_type") == CREATE, us)).alias("_c"),
        F.min(F.when(F.col("event_type") == PAY, us)).alias("_p"))
    if horizon is not None:
        # The event that comes too late is not seen.
        h = F.lit(duration_us(horizon))
        c, p = F.col("_c"), F.col("_p")
        per_order = per_order.select("order_id", F.when(p.isNull() | (c <= p + h), c).alias("_c"),
                                     F.when(c.isNull() | (p <= c + h), p).alias("_p"))
    c, p = F.col("_c"), F.col("_p")
    result = (F.when(c.isNotNull() & p.isNotNull() & (p < c + F.lit(limit)), F.lit(MATCH_PAYED))
              .when(c.isNotNull() & p.isNotNull(), F.lit(MATCH_LATE))
              .when(c.isNotNull(), F.lit(MATCH_NO_PAY))
              .otherwise(F.lit(MATCH_NO_CREATE)))
    return per_order.select("order_id", result.alias("result"),
                            F.when(result == MATCH_PAYED, F.lit("payed"))
                             .otherwise(F.lit("timeout")).alias("output"))
