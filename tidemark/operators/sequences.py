"""Event-sequence patterns over a keyed, time-ordered stream.

Each function takes a DataFrame with key column(s), ``ts`` and a tie-break
``seq``, plus Boolean Columns for the pattern steps (combine conditions with
``&`` / ``|`` for and / or).  Event order per key is ``(ts, seq)``.  Bounds
(``within``) are strict: ``b.ts - a.ts < within``.

Pair outputs have columns ``*keys, first_ts, first_seq, second_ts, second_seq``.

Everything except ``seq_followed_by_any`` is a set of ordered scans through
:class:`Timeline` (time-bucketed, so a hot key is split) followed by filters or
partial aggregations.  ``seq_followed_by_any`` emits every later match inside
the bound, which is a bounded interval self-join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import duration_us
from .joins import interval_join
from .timeline import DEFAULT_BUCKET, Timeline


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _within(first_us: Column, second_us: Column, within) -> Column:
    if within is None:
        return F.lit(True)
    return second_us - first_us < F.lit(duration_us(within))


def _pair(d: DataFrame, keys, other: str) -> DataFrame:
    return d.select(*keys, F.col("ts").alias("first_ts"), F.col("seq").alias("first_seq"),
                    F.col(f"{other}.ts").alias("second_ts"), F.col(f"{other}.seq").alias("second_seq"))


def seq_next(df: DataFrame, keys, first: Column, second: Column, within=None,
             bucket=DEFAULT_BUCKET) -> DataFrame:
    """Strict contiguity: ``a`` immediately followed by ``b`` (no event between)."""
    keys = _keys(keys)
    tl = Timeline(df.withColumn("_is_b", second), keys, bucket=bucket, halo=within)
    tl.following("_nx", fields=["ts", "_is_b"])
    d = tl.result().where(first & F.col("_nx._is_b") & _within(F.col("_us"), F.col("_nx.us"), within))
    return _pair(d, keys, "_nx")


def seq_followed_by(df: DataFrame, keys, first: Column, second: Column, within=None,
                    bucket=DEFAULT_BUCKET) -> DataFrame:
    """Relaxed contiguity: ``a`` with the first later ``b`` (other events may lie between)."""
    keys = _keys(keys)
    tl = Timeline(df, keys, bucket=bucket, halo=within)
    tl.following("_nb", fields=["ts"], pred=second)
    d = tl.result().where(first & F.col("_nb").isNotNull()
                          & _within(F.col("_us"), F.col("_nb.us"), within))
    return _pair(d, keys, "_nb")


def seq_followed_by_any(df: DataFrame, keys, first: Column, second: Column, within) -> DataFrame:
    """Non-deterministic relaxed contiguity: ``a`` with *every* later ``b`` inside ``within``.

    ``within`` is required: without a bound this is every pair of a key.
    """
    if within is None:
        raise ValueError("seq_followed_by_any needs a time bound")
    keys = _keys(keys)
    if len(keys) != 1:
        df = df.withColumn("_k", F.struct(*keys))
        key = "_k"
    else:
        key = keys[0]
    a = df.where(first).select(key, "ts", "seq")
    b = df.where(second).select(key, "ts", "seq")
    w = duration_us(within)
    j = interval_join(a, b, key, dt.timedelta(0), dt.timedelta(microseconds=w), left_prefix="a_",
                      right_prefix="b_")
    later = (F.col("b_ts") > F.col("a_ts")) | ((F.col("b_ts") == F.col("a_ts")) & (F.col("b_seq") > F.col("a_seq")))
    j = j.where(later & (F.col("b_ts") != F.col("a_ts") + F.expr(f"INTERVAL {w} MICROSECONDS")))
    out = j.select(key, F.col("a_ts").alias("first_ts"), F.col("a_seq").alias("first_seq"),
                   F.col("b_ts").alias("second_ts"), F.col("b_seq").alias("second_seq"))
    if key == "_k":
        out = out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "first_ts", "first_seq",
                         "second_ts", "second_seq")
    return out


def seq_not_next(df: DataFrame, keys, first: Column, not_next: Column,
                 bucket=DEFAULT_BUCKET, within=None) -> DataFrame:
    """``a`` whose immediately next event exists (less than ``within`` later) and does not satisfy ``not_next``."""
    keys = _keys(keys)
    tl = Timeline(df.withColumn("_is_x", not_next), keys, bucket=bucket, halo=within)
    tl.following("_nx", fields=["ts", "_is_x"])
    d = tl.result().where(first & F.col("_nx").isNotNull() & ~F.col("_nx._is_x")
                          & _within(F.col("_us"), F.col("_nx.us"), within))
    return _pair(d, keys, "_nx")


def seq_not_followed_by(df: DataFrame, keys, first: Column, not_between: Column, second: Column,
                        within=None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """``a`` followed by the first later ``b`` with no ``x`` strictly between them."""
    keys = _keys(keys)
    tl = Timeline(df, keys, bucket=bucket, halo=within)
    tl.following("_nb", fields=["ts"], pred=second)
    tl.following("_nx", pred=not_between)
    d = tl.result()
    before_b = (F.col("_nx.us") < F.col("_nb.us")) | (
        (F.col("_nx.us") == F.col("_nb.us")) & (F.col("_nx.seq") < F.col("_nb.seq")))
    d = d.where(first & F.col("_nb").isNotNull()
                & _within(F.col("_us"), F.col("_nb.us"), within)
                & (F.col("_nx").isNull() | ~before_b))
    return _pair(d, keys, "_nb")


def seq_times(df: DataFrame, keys, pred: Column, n: int, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Looping step: runs of >= n consecutive events satisfying ``pred``.

    Columns: *keys, start_ts, end_ts, length.  The run id is the running count of
    non-matching events, so each run is a partial aggregation by (key, run id).
    """
    keys = _keys(keys)
    tl = Timeline(df.withColumn("_hit", pred), keys, bucket=bucket)
    tl.running_sum("_run", (~F.col("_hit")).cast("long"))
    d = tl.result().where(F.col("_hit"))
    runs = d.groupBy(*keys, "_run").agg(
        F.min(F.struct("_us", "seq", "ts")).alias("_a"), F.max(F.struct("_us", "seq", "ts")).alias("_z"),
        F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= n).select(
        *keys, F.col("_a.ts").alias("start_ts"), F.col("_z.ts").alias("end_ts"), "length")


def seq_until(df: DataFrame, keys, pred: Column, stop: Column, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Looping step with a stop condition: the ``pred`` events between two ``stop`` events.

    A segment starts after a stop event (or at the key's first event); its matching
    events are collected until the next stop.  Columns: *keys, segment (number of
    stops before it), start_ts, end_ts, n.
    """
    keys = _keys(keys)
    tl = Timeline(df.withColumn("_stop", stop), keys, bucket=bucket)
    tl.running_sum("segment", F.col("_stop").cast("long"))
    d = tl.result().where(~F.col("_stop") & pred)
    seg = d.groupBy(*keys, "segment").agg(
        F.min(F.struct("_us", "seq", "ts")).alias("_a"), F.max(F.struct("_us", "seq", "ts")).alias("_z"),
        F.count(F.lit(1)).alias("n"))
    return seg.select(*keys, "segment", F.col("_a.ts").alias("start_ts"),
                      F.col("_z.ts").alias("end_ts"), "n")


def seq_iterative(df: DataFrame, keys, pred: Column, value: str, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Iterative condition: within each run of consecutive ``pred`` events, keep an
    event when its ``value`` is above the mean ``value`` of the earlier events of
    the run (the first event of a run is kept).

    The test ``value * n > sum`` is done in decimal arithmetic, so it is exact.
    Columns: *keys, ts, seq, value, prior_sum (null for a run's first event),
    prior_count.
    """
    keys = _keys(keys)
    hit = F.col("_hit")
    dec = "decimal(24,6)"
    tl = Timeline(df.withColumn("_hit", pred).withColumn("_v", F.col(value).cast(dec)), keys,
                  bucket=bucket)
    tl.running_sum("_s", F.when(hit, F.col("_v")).otherwise(F.lit(0).cast(dec)))
    tl.running_sum("_c", hit.cast("long"))
    tl.df = tl.df  # resolve the sums: the next scan reads them
    # Totals just before the run's first event, taken from the last non-matching event.
    tl.prior("_base", fields=["_s", "_c"], pred=~hit, inclusive=True)
    d = tl.result().where(hit)
    base_s = F.coalesce(F.col("_base._s"), F.lit(0).cast(dec))
    base_c = F.coalesce(F.col("_base._c"), F.lit(0).cast("long"))
    earlier_s = F.col("_s") - F.col("_v") - base_s
    earlier_c = F.col("_c") - 1 - base_c
    keep = (earlier_c == 0) | (F.col("_v") * earlier_c > earlier_s)
    return d.where(keep).select(
        *keys, "ts", "seq", F.col(value).alias(value),
        F.when(earlier_c > 0, earlier_s.cast("double")).alias("prior_sum"),
        earlier_c.cast("long").alias("prior_count"))


@dataclass(frozen=True)
class Step:
    """One step of a :func:`seq_chain`: ``link`` says how its first event follows the step before
    ("next": immediately, "followed_by": the first later match).  ``times`` = n or (least, most) makes it a loop; its
    events are consecutive, or, with ``relaxed`` and a fixed n, each the first later match."""

    name: str
    cond: Column
    link: str = "followed_by"
    times: int | tuple[int, int] = 1
    relaxed: bool = False

    @property
    def least(self) -> int:
        return self.times if isinstance(self.times, int) else self.times[0]

    @property
    def most(self) -> int:
        return self.times if isinstance(self.times, int) else self.times[1]

    def check(self) -> None:
        if self.link not in ("next", "followed_by"):
            raise ValueError(f"unknown link {self.link!r}")
        if not 1 <= self.least <= self.most:
            raise ValueError(f"a step takes at least one event, and at most as many as its bound: {self.times}")
        if self.relaxed and self.least != self.most:
            raise ValueError("a relaxed loop needs a fixed number of events")


def seq_chain(df: DataFrame, keys, steps: Sequence[Step], within, bucket=DEFAULT_BUCKET) -> DataFrame:
    """A pattern of any number of steps, with bounded loops, inside ``within`` from the first event to the last.

    Every event that satisfies the first step starts at most one match.  Loops are greedy: of the matches
    inside ``within``, the one whose first loop is longest is taken, then the second, and so on.  Columns: *keys, and for each step <name>_ts and
    <name>_seq of its first event, for loops also <name>_last_ts and <name>_n.

    Matches are built from the last step to the first: an event of a step holds the possible rests of the match (as
    many as the loops have lengths), which it reads from the event that follows it.  All these scans share one partitioning and one sort (time buckets with
    a halo of ``within``), so a pattern of any length is one shuffle, and a hot key is split by time."""
    keys = _keys(keys)
    if not steps:
        raise ValueError("a pattern has at least one step")
    for st in steps:
        st.check()
    for i, st in enumerate(steps):
        df = df.withColumn(f"_is{i}", F.coalesce(st.cond, F.lit(False)))
    tl = Timeline(df, keys, bucket=bucket, halo=within)
    event = "struct<step:int,us:bigint,seq:bigint,ts:" + df.schema["ts"].dataType.simpleString() + ">"
    scans = 0

    def rest_after(link: str, flag: str, rest: str) -> Column:
        """The rest of the match held by the event that follows."""
        nonlocal scans
        scans += 1
        out = f"_f{scans}"
        tl.following(out, fields=[flag, rest], pred=None if link == "next" else F.col(flag))
        tl.df = tl.df  # resolve: the next scan reads it
        return F.coalesce(F.when(F.col(f"{out}.{flag}"), F.col(f"{out}.{rest}")), F.array().cast(f"array<array<{event}>>"))

    leave = F.array(F.array().cast(f"array<{event}>"))  # behind the last step nothing is needed
    for i in range(len(steps) - 1, -1, -1):
        st, flag = steps[i], f"_is{i}"
        here = F.array(F.struct(F.lit(i).alias("step"), F.col("_us").alias("us"), F.col("seq").cast("bigint").alias("seq"), F.col("ts").alias("ts")))
        if st.most > 1:
            tl.df = tl.df.withColumn(f"_leave{i}", leave)
            leave = F.col(f"_leave{i}")
        for n in range(st.most, 0, -1):
            options = []
            if n < st.most:
                options.append(rest_after("followed_by" if st.relaxed else "next", flag, f"_m{i}_{n + 1}"))
            if n >= st.least:
                options.append(leave)
            tl.df = tl.df.withColumn(f"_m{i}_{n}", F.when(F.col(flag), F.transform(F.concat(*options), lambda x: F.concat(here, x))))
        if i:
            leave = rest_after(st.link, flag, f"_m{i}_1")
    best = F.filter("_m0_1", lambda x: _within(F.col("_us"), F.element_at(x, -1)["us"], within))
    match = F.col("_match")
    d = tl.result().withColumn("_match", F.get(best, 0)).where(match.isNotNull())
    cols = []
    for i, st in enumerate(steps):
        number = F.lit(i)
        mine = F.filter(match, lambda e: e["step"] == number)
        cols += [F.get(mine, 0)["ts"].alias(f"{st.name}_ts"), F.get(mine, 0)["seq"].alias(f"{st.name}_seq")]
        if st.most > 1:
            cols += [F.element_at(mine, -1)["ts"].alias(f"{st.name}_last_ts"), F.size(mine).alias(f"{st.name}_n")]
    return d.select(*keys, *cols)
