"""Login-failure detection, three ways.

* ``login_fail_pattern``: a failure strictly followed by another failure (no
  event in between) within the bound -- the two-step pattern with strict
  contiguity.
* ``login_fail_consecutive``: the same pair test in its state-machine form
  (compare with the stored previous failure; a success clears it).
* ``login_fail_burst``: per run of failures (a run ends at a success), start a
  timer at the run's first failure t0 and, unless a success arrives by
  t0 + window, warn with the number of failures up to t0 + window (inclusive).
  One warning per run.

Event order is ``(ts, seq)`` per user.  All scans go through
:class:`~tidemark.operators.timeline.Timeline`, so a very active user is split
across time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us
from .timeline import DEFAULT_BUCKET, Timeline

# Event types and warning texts.
FAIL, SUCCESS = "fail", "success"
PATTERN_MESSAGE = "login fail!"
CONSECUTIVE_MESSAGE = "login fail in 2 seconds"
BURST_MESSAGE = "login fail in {secs} seconds {n} times"
WITHIN = "2 seconds"


def _pairs(df: DataFrame, within, bucket) -> DataFrame:
    tl = Timeline(df, "user_id", bucket=bucket, halo=within, look="prior")
    tl.prior("_prev", fields=["event_type", "ts"])
    d = tl.result()
    limit = duration_us(within)
    return d.where((F.col("event_type") == FAIL)
                   & (F.col("_prev.event_type") == FAIL)
                   & (F.col("_us") - F.col("_prev.us") < F.lit(limit)))


def login_fail_pattern(df: DataFrame, within=WITHIN, bucket=DEFAULT_BUCKET) -> DataFrame:
    """(user_id, first_fail_ts, last_fail_ts, warning) for fail-next-fail within the bound."""
    return _pairs(df, within, bucket).select(
        "user_id", F.col("_prev.ts").alias("first_fail_ts"), F.col("ts").alias("last_fail_ts"),
        F.lit(PATTERN_MESSAGE).alias("warning"))


def login_fail_consecutive(df: DataFrame, within=WITHIN, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Two consecutive failures less than ``within`` apart."""
    return _pairs(df, within, bucket).select(
        "user_id", F.col("_prev.ts").alias("first_fail_ts"), F.col("ts").alias("last_fail_ts"),
        F.lit(CONSECUTIVE_MESSAGE).alias("warning"))


def login_fail_burst(df: DataFrame, window=WITHIN, min_fails: int = 2,
                     bucket=DEFAULT_BUCKET) -> DataFrame:
    """One warning per failure run with >= min_fails failures by t0 + window and no success by then."""
    w_us = duration_us(window)
    is_fail = F.col("event_type") == FAIL
    tl = Timeline(df, "user_id", bucket=bucket)
    # Level 1: previous event and next success; level 2: the run start of each row.
    tl.prior("_prev", fields=["event_type"])
    tl.following("_next_ok", pred=F.col("event_type") == SUCCESS)
    tl.df = tl.df.withColumn(
        "_run_start", is_fail & (F.col("_prev").isNull() | (F.col("_prev.event_type") != FAIL))) \
        .withColumn("_ok_us", F.col("_next_ok.us"))
    tl.prior("_start", fields=["ts", "_ok_us"], pred=F.col("_run_start"), inclusive=True)
    d = tl.result().where(is_fail & (F.col("_us") <= F.col("_start.us") + F.lit(w_us)))
    runs = d.groupBy("user_id", F.col("_start").alias("_start")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("_us", "ts")).alias("_last"))
    alerts = runs.where((F.col("n") >= min_fails)
                        & (F.col("_start._ok_us").isNull()
                           | (F.col("_start._ok_us") > F.col("_start.us") + F.lit(w_us))))
    secs = w_us // 1_000_000 if w_us % 1_000_000 == 0 else w_us / 1_000_000
    head, tail = BURST_MESSAGE.split("{n}")
    return alerts.select(
        "user_id", F.col("_start.ts").alias("first_fail_ts"), F.col("_last.ts").alias("last_fail_ts"),
        F.concat(F.lit(head.format(secs=secs)), F.col("n").cast("string"), F.lit(tail)).alias("warning"))
