"""Ordered per-key scans that do not put a whole key into one task.

Sequence operators need, for each event, facts about its neighbours in the
key's event-time order ``(ts, seq)``: the previous event, the nearest earlier or
later event that satisfies a predicate, or a running sum.  Partitioning a window
function by the key alone would send every event of a hot key (say one user
with a third of all rows) to one task.

Here the order is cut into time buckets: window functions are partitioned by
``(key, bucket)``, and whatever a bucket needs from earlier or later buckets is
*carried* through a small per-(key, bucket) summary:

* the summary is a partial aggregation per (key, bucket) (``max``/``min`` of a
  struct that starts with ``(us, seq)``, or ``sum``);
* a window over the summary (one row per non-empty bucket of a key, bounded by
  the time span / bucket width, not by the data volume) shifts each value to
  the neighbouring buckets;
* it is joined back on ``(key, bucket)``.

Scans that do not depend on each other are resolved together as one *level*:
one window pass over the ``(key, bucket)`` partitioning (one shuffle of the
frame) plus one summary aggregation (partial aggregation before its shuffle, so
only about one row per (key, bucket, map task) moves).  The summary branch reads
the level's input a second time -- a column-pruned pass, not a second shuffle of
the frame.  The operators use at most two levels.

Results are exact for any bucket width; the width only trades task size
against summary size.  Null keys form one group, like any other key.

Where a bound says how far a scan may look (``halo``), nothing is carried: buckets are at least
as wide as twice the bound, and rows within the bound of a bucket's edge are copied to the
neighbour that may look at them.  That is one pass and one shuffle.  A neighbour that a scan
does not find is then farther away than the bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import duration_us, ifloor, to_micros

DEFAULT_BUCKET = "1 hour"
US = "_us"


@dataclass
class _Scan:
    kind: str            # prior | following | running
    out: str
    value: Column        # candidate struct (or null), or the summand
    inclusive: bool = False


class Timeline:
    """A DataFrame with keys, an event time and a tie-break ``seq``, plus bucket columns.

    ``prior``/``following``/``running_sum`` queue scans; the queued scans are
    resolved together when ``df`` or ``result()`` is read.
    """

    def __init__(self, df: DataFrame, keys, ts: str = "ts", seq: str = "seq",
                 bucket=DEFAULT_BUCKET, halo=None, look: str = "following"):
        """``halo``: scans find neighbours at most this far away (None: any distance); they all look
        in the direction ``look`` ("prior", "following" or "both")."""
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.ts, self.seq = ts, seq
        self.bucket_us = duration_us(bucket)
        self.halo = None if halo is None else duration_us(halo)
        us = to_micros(df, ts)
        if self.halo is None:
            self._df = df.withColumn(US, us).withColumn("_b", ifloor(F.col(US), self.bucket_us))
        else:
            self.bucket_us = max(self.bucket_us, 2 * self.halo)
            own = ifloor(F.col(US), self.bucket_us)
            # A following scan of the bucket before, or a prior scan of the bucket behind, sees this row too.
            reach = {"following": [-self.halo], "prior": [self.halo], "both": [-self.halo, self.halo]}[look]
            others = [ifloor(F.col(US) + F.lit(r), self.bucket_us) for r in reach]
            self._df = (df.withColumn(US, us)
                        .withColumn("_b", F.explode(F.array_distinct(F.array(own, *others))))
                        .withColumn("_home", F.col("_b") == own))
        self._pending: list[_Scan] = []

    @property
    def df(self) -> DataFrame:
        self._resolve()
        return self._df

    @df.setter
    def df(self, value: DataFrame) -> None:
        self._resolve()
        self._df = value

    def event(self, *fields: str) -> Column:
        """Struct of the current row, ordered by (us, seq) first."""
        return F.struct(F.col(US).alias("us"), F.col(self.seq).alias("seq"),
                        *[F.col(f).alias(f) for f in fields])

    # -- queued scans --------------------------------------------------------------

    def prior(self, out: str, fields=(), pred: Column | None = None, inclusive: bool = False) -> "Timeline":
        """``out`` = struct(us, seq, *fields) of the nearest earlier row matching ``pred``."""
        value = self.event(*fields)
        self._pending.append(_Scan("prior", out, value if pred is None else F.when(pred, value), inclusive))
        return self

    def following(self, out: str, fields=(), pred: Column | None = None, inclusive: bool = False) -> "Timeline":
        """``out`` = struct(us, seq, *fields) of the nearest later row matching ``pred``."""
        value = self.event(*fields)
        self._pending.append(_Scan("following", out, value if pred is None else F.when(pred, value), inclusive))
        return self

    def running_sum(self, out: str, value: Column) -> "Timeline":
        """``out`` = sum of ``value`` over all rows of the key up to and including this one."""
        self._pending.append(_Scan("running", out, value))
        return self

    def result(self) -> DataFrame:
        done = self.df
        return done.drop("_b") if self.halo is None else done.where("_home").drop("_b", "_home")

    # -- resolution ----------------------------------------------------------------

    def _resolve(self) -> None:
        if not self._pending:
            return
        scans, self._pending = self._pending, []
        keys = self.keys
        base = self._df
        asc = Window.partitionBy(*keys, "_b").orderBy(F.col(US), F.col(self.seq))
        desc = Window.partitionBy(*keys, "_b").orderBy(F.col(US).desc(), F.col(self.seq).desc())
        up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)

        summary_aggs, shifted, local = [], [], []
        for i, sc in enumerate(scans):
            s, c, t = f"_s{i}", f"_c{i}", f"_t{i}"
            if sc.kind == "prior":
                summary_aggs.append(F.max(sc.value).alias(s))
                shifted.append(F.last(F.col(s), ignorenulls=True).over(up).alias(c))
                end = Window.currentRow if sc.inclusive else -1
                local.append((t, F.last(sc.value, ignorenulls=True).over(
                    asc.rowsBetween(Window.unboundedPreceding, end))))
            elif sc.kind == "following":
                # Descending order with a growing frame: linear, unlike an
                # unbounded-following frame.
                summary_aggs.append(F.min(sc.value).alias(s))
                shifted.append(F.last(F.col(s), ignorenulls=True).over(down).alias(c))
                end = Window.currentRow if sc.inclusive else -1
                local.append((t, F.last(sc.value, ignorenulls=True).over(
                    desc.rowsBetween(Window.unboundedPreceding, end))))
            else:
                summary_aggs.append(F.sum(sc.value).alias(s))
                shifted.append(F.sum(F.col(s)).over(up).alias(c))
                local.append((t, F.sum(sc.value).over(
                    asc.rowsBetween(Window.unboundedPreceding, Window.currentRow))))

        if self.halo is not None:
            if any(sc.kind == "running" for sc in scans):
                raise ValueError("a running sum has no bound")
            for (t, expr), sc in zip(local, scans):
                base = base.withColumn(sc.out, expr)
            self._df = base
            return
        summary = base.groupBy(*keys, "_b").agg(*summary_aggs)
        carried = summary.select(*keys, "_b", *shifted)
        main = base
        for t, expr in local:
            main = main.withColumn(t, expr)
        carried = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])],
                                 *[f"_c{i}" for i in range(len(scans))])
        same = F.lit(True)
        for i, k in enumerate([*keys, "_b"]):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        main = main.join(carried, same, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
        for i, sc in enumerate(scans):
            t, c = F.col(f"_t{i}"), F.col(f"_c{i}")
            if sc.kind == "running":
                main = main.withColumn(sc.out, t + F.coalesce(c, F.lit(0)))
            else:
                main = main.withColumn(sc.out, F.coalesce(t, c))
        self._df = main.drop(*[f"_t{i}" for i in range(len(scans))], *[f"_c{i}" for i in range(len(scans))])
