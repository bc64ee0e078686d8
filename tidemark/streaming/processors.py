"""Stateful streaming operators with ``transformWithStateInPandas``.

State lives in the RocksDB state store, partitioned by the grouping key, and is
checkpointed with the query, so a lost executor replays from the checkpoint.

Every event-time operator works in event order ``(ts, seq)``, however the input is cut
into micro-batches: rows wait in time slices until the watermark has passed them, and are then
handed, in order, to a small state machine (:class:`OrderedProcessor`).  A slice is read once
when it is due, so a busy key costs linear time and holds one slice in memory.  Rows that are
late (at or before the watermark) are dropped.  The results equal those of the batch operators
on the rows the watermark has passed, for any split into batches.

The keys are spread over ``BUCKETS`` groups (:class:`BucketedProcessor`): a call to the state store is a round
trip between the Python worker and the JVM, and a group reads, writes and wakes once for all its keys.
Clicks and logins go further (:class:`PackedGroups`, ``applyInPandasWithState``): a group's state comes and goes with its
rows as one packed value, without such calls, and a sort or two serve all its keys.

A group holds one timer, for its next due time: when that time changes, the old timer is deleted, so no
stale timer wakes it.

State expires: a key's waiting rows go with their slice, and its machine's state is cleared by a
timer once no later event can depend on it (see each class for the two cases in which
only a bound given by the caller can say so).

Event times enter as epoch microseconds (``ev_us``) and leave as ``*_us`` columns; the wrappers
convert them back to timestamps.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)

from ..functions.hashing import DEFAULT_BITS, DEFAULT_SEED
from ..functions.sliding import coded, first_start, running_windows, window_rows
from ..functions.time import as_event_time, duration_us, ifloor, micros_to_ts, to_micros
from ..operators.distinct import user_slot
from ..operators.login import BURST_MESSAGE, CONSECUTIVE_MESSAGE, FAIL, PATTERN_MESSAGE, WITHIN
from ..operators.market import BLACKLIST_MESSAGE, CLICK_CAP
from ..operators.orders import (CREATE, MATCH_LATE, MATCH_NO_CREATE, MATCH_NO_PAY, MATCH_PAYED, PATTERN_TIMEOUT,
                                PAYED_SUCCESS, STATUS_PAYED, STATUS_TIMEOUT, TIMEOUT)

DAY_MS = 86_400_000
HOUR_US = 3_600_000_000
#: Groups that the keys of an ordered processor are spread over.
BUCKETS = 8192
#: Groups of the processors that take all keys of a group at once.
GROUPS = 512
#: Groups of tx ids in a reconciliation, and in each time bucket of one.
TX_BUCKETS, SPAN_BUCKETS = 1024, 256


def _pickle_by_value() -> None:
    # The processors run in Python workers (and a driver-side runner) that need not
    # have this package installed: ship their code inside the pickled command.
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _require_rocksdb(df: DataFrame) -> None:
    """``transformWithState`` needs the RocksDB state store (multiple column families)."""
    if df.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        raise RuntimeError(f"stateful processors need {PROVIDER}={ROCKSDB}; session.build_session sets it")


def _ceil_ms(us: int) -> int:
    """Timer (ms) that fires once the watermark has reached ``us`` (inclusive)."""
    return -(-us // 1000)


def rearm(handle: StatefulProcessorHandle, *times: int | None) -> None:
    """The key's timers (ms) become ``times``: pending others are deleted, missing ones registered."""
    pending = {t[0] if isinstance(t, tuple) else t for t in handle.listTimers()}
    wanted = {t for t in times if t is not None}
    for t in pending - wanted:
        handle.deleteTimer(t)
    for t in wanted - pending:
        handle.registerTimer(t)


class OrderedProcessor(StatefulProcessor):
    """Hands each key's rows to :meth:`step` in the order of (ev_us, seq), behind the watermark.

    Input columns: ``ev_us``, ``seq`` and ``payload``.  Subclasses keep their state in a
    JSON-able list and give lists of output rows.
    """

    payload: tuple[str, ...] = ()
    output: tuple[str, ...] = ()
    #: Width of the time slices in which rows wait: what is read at once when the watermark moves.
    slice_us: int = HOUR_US

    def fresh(self) -> list:
        """State of a key without history."""
        raise NotImplementedError

    def step(self, key, st: list, us: int, seq: int, row: tuple) -> list[tuple]:
        """Output of one event; changes ``st`` in place."""
        raise NotImplementedError

    def advance(self, key, st: list, wm_us: int) -> list[tuple]:
        """Output that is due because every event up to ``wm_us`` is in."""
        return []

    def wake_at(self, st: list) -> int | None:
        """Next time at which :meth:`advance` has something to do."""
        return None

    def forget_at(self, st: list) -> int | None:
        """Time from which the state equals a fresh one for all later events; None: never."""
        return None

    # -- all keys of a group at once (PackedGroups) --------------------------------

    def play(self, keys: list[str], held: bytes | None, rows: pd.DataFrame, wm_us: int) -> tuple[pd.DataFrame, bytes | None, int | None]:
        """Output of ``rows``, which are in event order, and of what else is due at ``wm_us``; the machines that stay,
        packed, and the next time at which they have something to do."""
        states = {tuple(k): st for k, st in json.loads(held)} if held is not None else {}
        out = _stepped(self, len(keys), states, zip(*(rows[c].tolist() for c in ("ev_us", "seq", "nulls", *keys, *self.payload))))
        last, live, later = _settled(self, states, wm_us)
        return (pd.DataFrame(out + last, columns=list(self.output), dtype=object), json.dumps(live).encode() if live else None,
                min(later, default=None))

    def needed(self, keys: list[str], held: bytes | None, rows: pd.DataFrame) -> pd.DataFrame:
        """Those of the waiting rows that can still make a difference."""
        return rows

    # -- plumbing ------------------------------------------------------------------

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One entry for what a micro-batch brings to a slice, named by its first row: nothing is rewritten as more comes.
        self.waiting = handle.getMapState("waiting", "slice long, us long, seq long", "rows string")
        self.machine = handle.getValueState("machine", "st string")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        wm_us = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        first = None
        for df in rows:
            # Most keys have a few rows in a batch, so plain lists beat frame operations here.
            parts: dict[int, list[list]] = {}
            for row in zip(*(df[c].tolist() for c in ("ev_us", "seq", *self.payload))):
                if row[0] > wm_us or wm_us == 0:      # late rows are dropped
                    parts.setdefault(row[0] // self.slice_us, []).append(list(row))
                    first = row[0] if first is None else min(first, row[0])
            for part, new in parts.items():
                slot = (part, new[0][0], new[0][1])
                if self.waiting.containsKey(slot):            # the same event again
                    new = json.loads(self.waiting.getValue(slot)[0]) + new
                self.waiting.updateValue(slot, (json.dumps(new),))
        if first is not None:
            due = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
            rearm(self.handle, min([_ceil_ms(first), *due]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.machine.get()
        st = json.loads(held[0]) if held is not None else self.fresh()
        out: list[tuple] = []
        upcoming = None
        slots: dict[int, list[tuple]] = {}
        for slot in self.waiting.keys():
            slots.setdefault(slot[0], []).append(tuple(slot))
        for part in sorted(slots):
            if part * self.slice_us > wm_us:
                upcoming = part * self.slice_us
                break
            events = [e for slot in slots[part] for e in json.loads(self.waiting.getValue(slot)[0])]
            events.sort(key=lambda e: (e[0], e[1]))
            rest = [e for e in events if e[0] > wm_us]
            for us, seq, *row in events[:len(events) - len(rest)]:
                out += self.advance(key, st, us - 1)
                out += self.step(key, st, us, seq, tuple(row))
            for slot in slots[part]:
                self.waiting.removeKey(slot)
            if rest:
                self.waiting.updateValue((part, rest[0][0], rest[0][1]), (json.dumps(rest),))
                upcoming = rest[0][0]
                break
        out += self.advance(key, st, wm_us)
        forget = self.forget_at(st)
        if st == self.fresh() or (forget is not None and forget <= wm_us):
            self.machine.clear()
            later = [upcoming]
        else:
            self.machine.update((json.dumps(st),))
            later = [upcoming, self.wake_at(st), forget]
        later = [t for t in later if t is not None]
        rearm(self.handle, max(_ceil_ms(min(later)), timerValues.getCurrentWatermarkInMs() + 1) if later else None)
        if out:
            yield pd.DataFrame(out, columns=list(self.output))

    def close(self) -> None:
        pass


class BucketedProcessor(StatefulProcessor):
    """Runs an :class:`OrderedProcessor`'s machine for all keys of a bucket.

    Input columns: ``ev_us``, ``seq``, ``nulls`` (which of seq and the keys are null), the keys and the payload.
    Rows wait in sorted chunks of at most ``CHUNK`` rows, in the order of their first row.  Behind the watermark they are
    merged, so memory holds the chunks that overlap in time, and the machines of the bucket."""

    CHUNK = 4096
    #: Rows that make up a chunk of their own before a new time slice begins; sparse slices share one.
    SLICE_ROWS = 256
    OUT_ROWS = 20_000

    def __init__(self, proc: OrderedProcessor, keys: list[str]):
        self.proc, self.keys, self.output = proc, list(keys), list(proc.output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, no long", "rows string")
        self.machines = handle.getValueState("machines", "st string")
        self.book = handle.getValueState("book", "no long, timer long")  # number of the next chunk, pending timer

    def _keep(self, rows: list[list], no: int) -> int:
        """Store sorted rows as chunks."""
        start, slice_us = 0, self.proc.slice_us
        for i in range(1, len(rows) + 1):
            n = i - start
            if i == len(rows) or n >= self.CHUNK or (n >= self.SLICE_ROWS and rows[i][0] // slice_us != rows[i - 1][0] // slice_us):
                self.waiting.updateValue((rows[start][0], no), (json.dumps(rows[start:i]),))
                start, no = i, no + 1
        return no

    def _wake(self, no: int, pending: int | None, at: int | None) -> None:
        if pending != at:
            if pending is not None:
                self.handle.deleteTimer(pending)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.book.clear()
        else:
            self.book.update((no, at))

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        wm_us = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        new = [list(row) for df in rows
               for row in zip(*(df[c].tolist() for c in ("ev_us", "seq", "nulls", *self.keys, *self.proc.payload)))
               if row[0] > wm_us or wm_us == 0]           # late rows are dropped
        if new:
            new.sort(key=_event_order)
            no, pending = self.book.get() or (0, None)
            first = _ceil_ms(new[0][0])
            self._wake(self._keep(new, no), pending, first if pending is None else min(first, pending))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        proc, n_keys = self.proc, len(self.keys)
        now = timerValues.getCurrentWatermarkInMs()
        wm_us = now * 1000
        no, pending = self.book.get()
        held = self.machines.get()
        states = {tuple(k): st for k, st in json.loads(held[0])} if held is not None else {}
        slots = sorted(tuple(slot) for slot in self.waiting.keys())
        due = [slot for slot in slots if slot[0] <= wm_us]
        upcoming = slots[len(due)][0] if len(due) < len(slots) else None
        out: list[tuple] = []
        rows: list[list] = []
        for i, slot in enumerate(due):
            rows += json.loads(self.waiting.getValue(slot)[0])
            self.waiting.removeKey(slot)
            rows.sort(key=_event_order)
            # Rows from here on may be preceded by those of the next chunk.
            end = due[i + 1][0] if i + 1 < len(due) else wm_us + 1
            ready = bisect_left(rows, end, key=_event_time)
            out += _stepped(proc, n_keys, states, rows[:ready])
            del rows[:ready]
            if len(out) >= self.OUT_ROWS:
                yield pd.DataFrame(out, columns=self.output, dtype=object)
                out = []
        if rows:
            no = self._keep(rows, no)
            upcoming = rows[0][0] if upcoming is None else min(upcoming, rows[0][0])
        last, live, later = _settled(proc, states, wm_us)
        out += last
        later += [] if upcoming is None else [upcoming]
        if live:
            self.machines.update((json.dumps(live),))
        else:
            self.machines.clear()
        # The timer that fires is gone.
        self._wake(no, None, max(_ceil_ms(min(later)), now + 1) if later else None)
        if out:
            yield pd.DataFrame(out, columns=self.output, dtype=object)

    def close(self) -> None:
        pass


def _stepped(proc: OrderedProcessor, n_keys: int, states: dict, rows) -> list[tuple]:
    """Output of rows (ev_us, seq, nulls, keys and payload) in event order; changes the machines in ``states``."""
    out: list[tuple] = []
    for us, seq, nulls, *row in rows:
        k = tuple(row[:n_keys])
        if nulls:
            seq = None if nulls & 1 else seq
            k = tuple(None if nulls >> j & 1 else v for j, v in enumerate(k, 1))
        st = states.get(k)
        if st is None:
            st = states[k] = proc.fresh()
        out += proc.advance(k, st, us - 1)
        out += proc.step(k, st, us, seq, tuple(row[n_keys:]))
    return out


def _settled(proc: OrderedProcessor, states: dict, wm_us: int) -> tuple[list[tuple], list, list[int]]:
    """What is due at the watermark: output, the machines that stay, and the times at which they have more to do."""
    out, live, later, fresh = [], [], [], proc.fresh()
    for k, st in states.items():
        out += proc.advance(k, st, wm_us)
        forget = proc.forget_at(st)
        if st != fresh and (forget is None or forget > wm_us):
            live.append((k, st))
            later += [t for t in (proc.wake_at(st), forget) if t is not None]
    return out, live, later


class PackedGroups:
    """Runs an :class:`OrderedProcessor`'s machine for all keys of a group, with one packed state value a group.

    Input columns as :class:`BucketedProcessor` has them.  The state comes and goes with the rows, in Arrow batches, so no
    call to the state store is made for a group.  State: the rows ahead of the watermark in event order (an Arrow table),
    the machines as :meth:`OrderedProcessor.play` packs them, and the time at which these have something to do."""

    HELD = "rows binary, machines binary, wake long"

    def __init__(self, proc: OrderedProcessor, keys: list[str]):
        self.proc, self.keys = proc, list(keys)

    def __call__(self, key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = max(state.getCurrentWatermarkMs(), 0)
        wm_us = now * 1000
        held, machines, wake = state.get if state.exists else (None, None, None)
        cols = ["ev_us", "seq", "nulls", *self.keys, *self.proc.payload]
        parts = [] if held is None else [_unpacked(held)]
        if not state.hasTimedOut:
            parts += [df[cols] if wm_us == 0 else df[cols][df["ev_us"] > wm_us] for df in frames]    # late rows are dropped
        parts = [df for df in parts if len(df)] or [pd.DataFrame({c: np.empty(0, np.int64) for c in cols})]
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.take(np.lexsort((rows["seq"], rows["nulls"] & 1, rows["ev_us"])))
        due = int(np.searchsorted(rows["ev_us"].to_numpy(), wm_us, "right")) if now else 0
        if due or (wake is not None and wake <= wm_us):
            out, machines, wake = self.proc.play(self.keys, machines, rows[:due], wm_us)
            if len(out):
                yield out[list(self.proc.output)]
        rest = self.proc.needed(self.keys, machines, rows[due:])
        later = [t for t in (int(rest["ev_us"].iloc[0]) if len(rest) else None, wake) if t is not None]
        if len(rest) or machines is not None:
            state.update((_packed(rest) if len(rest) else None, machines, wake))
            if later:                                 # the call comes once the watermark is greater
                state.setTimeoutTimestamp(max(_ceil_ms(min(later)) - 1, now, 1))
        elif state.exists:
            state.remove()


def _codes(*cols) -> np.ndarray:
    """A number for each combination of values, in the order in which they come."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        at, values = pd.factorize(c)
        code = pd.factorize(code * len(values) + at)[0]
    return code


def _coded_keys(keys: list[str], *frames: pd.DataFrame | None) -> tuple[pd.DataFrame, np.ndarray]:
    """The keys (and bits ``nulls``, without that of seq) of some frames below one another, and a number for each key."""
    some = [df for df in frames if df is not None and len(df)]
    cols = {c: np.concatenate([df[c].to_numpy() for df in some]) for c in ("nulls", *keys)}
    cols["nulls"] = cols["nulls"].astype(np.int64) & ~1
    return pd.DataFrame(cols), _codes(*cols.values())


def _with_nulls(rows: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    """``rows`` with the nulls that :func:`_filled` took out of ``cols``."""
    nulls = rows["nulls"].to_numpy()
    return rows.assign(**{c: np.where(nulls >> i & 1, None, rows[c].astype(object)) for i, c in enumerate(cols) if (nulls >> i & 1).any()})


def _event_order(row: list) -> tuple:
    return row[0], row[2] & 1, row[1]


def _event_time(row: list) -> int:
    return row[0]


def _filled(df: DataFrame, cols: list[str]) -> tuple[list, Column]:
    """Columns without nulls, as pandas turns whole numbers with nulls into floats, and a bit for each that was null."""
    kinds = dict(df.dtypes)
    nulls = F.lit(0)
    for i, c in enumerate(cols):
        nulls = nulls + F.col(c).isNull().cast("int") * F.lit(1 << i)
    return [F.coalesce(F.col(c), F.lit("" if kinds[c] == "string" else 0).cast(kinds[c])).alias(c) for c in cols], nulls.alias("nulls")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def _event_rows(events: DataFrame, delay) -> DataFrame:
    """``events`` with their watermark column ``_et``; rows without a time are behind no watermark."""
    return as_event_time(events, "ts", "_et").where(F.col("_et").isNotNull()) \
        .withWatermark("_et", f"{duration_us(delay)} microseconds")


def _ordered(events: DataFrame, keys: list[str], proc: OrderedProcessor, schema: str, delay, buckets: int | None = BUCKETS) -> DataFrame:
    """Run an ordered processor over ``events`` (ts, seq, keys and payload columns), in ``buckets`` groups or one a key."""
    _require_rocksdb(events)
    ev = _event_rows(events, delay)
    if buckets is None:
        src = ev.select(*keys, "_et", F.unix_micros("_et").alias("ev_us"), "seq", *proc.payload)
        return src.groupBy(*keys).transformWithStateInPandas(proc, schema, "append", "EventTime")
    src = _bucketed(ev, keys, proc, buckets)
    return src.groupBy("bucket").transformWithStateInPandas(BucketedProcessor(proc, keys), schema, "append", "EventTime")


def _bucketed(ev: DataFrame, keys: list[str], proc: OrderedProcessor, buckets: int) -> DataFrame:
    (seq, *filled), nulls = _filled(ev, ["seq", *keys])
    return ev.select(_bucket(keys, buckets), "_et", F.unix_micros("_et").alias("ev_us"), seq, nulls, *filled, *proc.payload)


def _packed_groups(events: DataFrame, keys: list[str], proc: OrderedProcessor, schema: str, delay, groups: int = GROUPS) -> DataFrame:
    """Like :func:`_ordered`, with one packed state value a group, which is held in memory while it is at work."""
    _require_rocksdb(events)
    src = _bucketed(_event_rows(events, delay), keys, proc, groups)
    return src.groupBy("bucket").applyInPandasWithState(PackedGroups(proc, keys), schema, PackedGroups.HELD, "append", "EventTimeTimeout")


# ------------------------------------------------------------------ click cap

class ClickCapProcessor(OrderedProcessor):
    """The first ``max_count`` clicks of a (user, ad) in each period pass; click ``max_count + 1`` warns.

    State: [period, clicks].  It goes when the watermark has passed the period; without a reset period
    the count holds for ever, by definition."""

    payload = ("province", "city")
    output = ("user_id", "ad_id", "province", "city", "ev_us", "seq", "tag")

    def __init__(self, max_count: int, reset_us: int | None):
        self.max_count, self.reset_us = max_count, reset_us

    def fresh(self) -> list:
        return [None, 0]

    def step(self, key, st, us, seq, row):
        period = us // self.reset_us if self.reset_us else 0
        if period != st[0]:
            st[:] = [period, 0]
        if st[1] > self.max_count:                    # warned already
            return []
        st[1] += 1
        return [(*key, *row, us, seq, "main" if st[1] <= self.max_count else "blacklist")]

    def forget_at(self, st):
        return (st[0] + 1) * self.reset_us if self.reset_us and st[0] is not None else None

    def _numbered(self, keys, held, rows):
        """Keys and their codes (the machines' first), the period and number of each row, and the count and its period of each key."""
        past = _unpacked(held) if held is not None else None
        who, code = _coded_keys(keys, past, rows)
        at = code[len(code) - len(rows):]
        us = rows["ev_us"].to_numpy()
        period = us // self.reset_us if self.reset_us else np.zeros(len(us), np.int64)
        n, of = np.zeros(code.max() + 1, np.int64), np.zeros(code.max() + 1, np.int64)
        if past is not None:
            n[code[:len(past)]], of[code[:len(past)]] = past["n"], past["period"]
        slot = _codes(at, period) if self.reset_us else at
        order = np.argsort(slot, kind="stable")
        number = np.empty(len(us), np.int64)
        number[order] = np.arange(1, len(us) + 1) - np.searchsorted(slot[order], slot[order])
        return who, code, period, number + np.where(of[at] == period, n[at], 0), n, of

    def play(self, keys, held, rows, wm_us):
        who, code, period, number, n, of = self._numbered(keys, held, rows)
        at = code[len(code) - len(rows):]
        n[at], of[at] = np.minimum(number, self.max_count + 1), period      # of a key's rows, the last one counts
        hit = number <= self.max_count + 1
        out = _with_nulls(rows[hit], ["seq", *keys]).assign(tag=np.where(number[hit] <= self.max_count, "main", "blacklist"))
        codes, first = np.unique(code, return_index=True)
        ends = (of + 1) * self.reset_us if self.reset_us else None
        live = codes[ends > wm_us] if self.reset_us else codes
        if not len(live):
            return out, None, None
        machines = _packed(who.take(first[live]).assign(period=of[live], n=n[live]))
        return out, machines, int(ends[live].min()) if self.reset_us else None

    def needed(self, keys, held, rows):
        """More clicks can only come before the ones that wait, so one beyond the warning stays beyond it."""
        return rows[self._numbered(keys, held, rows)[3] <= self.max_count + 1] if len(rows) else rows


class ProcessingResetCapProcessor(StatefulProcessor):
    """The cap in arrival order, reset by a processing-time timer at the next midnight (or after
    ``reset_ms``), like a daily reset job.  State: clicks so far and the pending timer."""

    output = ClickCapProcessor.output

    def __init__(self, max_count: int, reset_ms: int = DAY_MS):
        self.max_count, self.reset_ms = max_count, reset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cap", "n long, timer long")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, timer = self.state.get() or (0, 0)
        for df in rows:
            if not len(df):
                continue
            df = df.sort_values(["ev_us", "seq"], kind="stable")
            number = pd.Series(range(n + 1, n + 1 + len(df)), index=df.index)
            n += len(df)
            tag = number.map(lambda k: "main" if k <= self.max_count else "blacklist")
            out = df.assign(tag=tag)[number <= self.max_count + 1]
            if len(out):
                yield out[list(self.output)]
        if not timer:
            timer = (timerValues.getCurrentProcessingTimeInMs() // self.reset_ms + 1) * self.reset_ms
            self.handle.registerTimer(timer)
        self.state.update((n, timer))

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


CAP_SCHEMA = "user_id long, ad_id long, province string, city string, ev_us long, seq long, tag string"


def stream_click_cap(clicks: DataFrame, max_count: int = CLICK_CAP, reset="1 day",
                     processing_reset=False, delay="0 seconds") -> DataFrame:
    """Both click-cap outputs, tagged 'main' / 'blacklist' (fan out with ``sinks.fan_out``).

    ``processing_reset=True`` (or a duration) counts in arrival order and clears the counters at the
    next processing-time midnight (multiple of the duration) by a timer; a pending timer keeps
    the query scheduling batches, so use it with a continuous trigger, not ``availableNow``.
    """
    if processing_reset:
        _require_rocksdb(clicks)
        reset_ms = DAY_MS if processing_reset is True else duration_us(processing_reset) // 1000
        src = as_event_time(clicks, "ts", "_et").select(
            "user_id", "ad_id", "province", "city", F.unix_micros("_et").alias("ev_us"), "seq")
        out = src.groupBy("user_id", "ad_id").transformWithStateInPandas(
            ProcessingResetCapProcessor(max_count, reset_ms), CAP_SCHEMA, "append", "ProcessingTime")
    else:
        out = _packed_groups(clicks, ["user_id", "ad_id"],
                             ClickCapProcessor(max_count, duration_us(reset) if reset else None), CAP_SCHEMA, delay)
    return out.select("user_id", "ad_id", "province", "city", micros_to_ts(F.col("ev_us")).alias("ts"), "seq", "tag",
                      F.when(F.col("tag") == "blacklist",
                             F.lit(BLACKLIST_MESSAGE.format(n=max_count))).alias("message"))


# ------------------------------------------------------------------ logins

class FailPairProcessor(OrderedProcessor):
    """A failure whose previous event is a failure less than ``within`` before.

    State: [time of the previous event if it failed].  It goes ``within`` after that event."""

    payload = ("fail",)
    output = ("user_id", "first_us", "last_us", "n")

    def __init__(self, within_us: int):
        self.within_us = within_us

    def fresh(self) -> list:
        return [None]

    def step(self, key, st, us, seq, row):
        hit = row[0] and st[0] is not None and us - st[0] < self.within_us
        out = [(key[0], st[0], us, 2)] if hit else []
        st[0] = us if row[0] else None
        return out

    def forget_at(self, st):
        return None if st[0] is None else st[0] + self.within_us

    def play(self, keys, held, rows, wm_us):
        past = _unpacked(held) if held is not None else None
        n = 0 if past is None else len(past)
        who, code = _coded_keys(keys, past, rows)
        us = np.concatenate([[] if past is None else past["us"], rows["ev_us"]]).astype(np.int64)
        fail = np.concatenate([np.ones(n, bool), (rows["fail"] == True).to_numpy(bool)])  # noqa: E712 (null: no failure)
        order = np.argsort(code, kind="stable")
        code, us, fail = code[order], us[order], fail[order]
        same = code[1:] == code[:-1]
        hit = np.flatnonzero(same & fail[1:] & fail[:-1] & (us[1:] - us[:-1] < self.within_us))
        out = _with_nulls(who.take(order[hit]), ["seq", *keys]).rename(columns={keys[0]: "user_id"}) \
            .assign(first_us=us[hit], last_us=us[hit + 1], n=2)
        live = np.flatnonzero(np.append(~same, True) & fail & (us + self.within_us > wm_us))
        if not len(live):
            return out, None, None
        return out, _packed(who.take(order[live]).assign(us=us[live])), int(us[live].min()) + self.within_us


class BurstProcessor(OrderedProcessor):
    """Per run of failures: a warning at t0 + window if enough failures and no success came by then.

    State: [in run, timer open, t0, failures, last failure].  A run ends at a success only, so the
    state of a user whose last event is a failure is one row that stays."""

    payload = ("fail",)
    output = ("user_id", "first_us", "last_us", "n")

    def __init__(self, window_us: int, min_fails: int):
        self.window_us, self.min_fails = window_us, min_fails

    def fresh(self) -> list:
        return [False, False, 0, 0, 0]

    def step(self, key, st, us, seq, row):
        in_run, is_open, t0, n, last = st
        if not row[0]:
            st[:] = self.fresh()                      # a success inside the window suppresses the warning
        elif not in_run:
            st[:] = [True, True, us, 1, us]
        elif is_open:
            st[3:] = [n + 1, us]
        return []

    def advance(self, key, st, wm_us):
        if not st[1] or st[2] + self.window_us > wm_us:
            return []
        st[1] = False
        return [(key[0], st[2], st[4], st[3])] if st[3] >= self.min_fails else []

    def wake_at(self, st):
        return st[2] + self.window_us if st[1] else None


def _login_stream(login: DataFrame, proc: OrderedProcessor, delay) -> DataFrame:
    src = login.withColumn("fail", F.col("event_type") == FAIL)
    out = _packed_groups(src, ["user_id"], proc, "user_id long, first_us long, last_us long, n long", delay)
    return out.select("user_id", micros_to_ts(F.col("first_us")).alias("first_fail_ts"),
                      micros_to_ts(F.col("last_us")).alias("last_fail_ts"), "n")


def stream_login_fail_consecutive(login: DataFrame, within=WITHIN, delay="5 seconds") -> DataFrame:
    return _login_stream(login, FailPairProcessor(duration_us(within)), delay).drop("n") \
        .withColumn("warning", F.lit(CONSECUTIVE_MESSAGE))


def stream_login_fail_pattern(login: DataFrame, within=WITHIN, delay="5 seconds") -> DataFrame:
    return _login_stream(login, FailPairProcessor(duration_us(within)), delay).drop("n") \
        .withColumn("warning", F.lit(PATTERN_MESSAGE))


def stream_login_fail_burst(login: DataFrame, window=WITHIN, min_fails: int = 2,
                            delay="5 seconds") -> DataFrame:
    w = duration_us(window)
    secs = w // 1_000_000 if w % 1_000_000 == 0 else w / 1_000_000
    head, tail = BURST_MESSAGE.split("{n}")
    return _login_stream(login, BurstProcessor(w, min_fails), delay).select(
        "user_id", "first_fail_ts", "last_fail_ts",
        F.concat(F.lit(head.format(secs=secs)), F.col("n").cast("string"), F.lit(tail)).alias("warning"))


# ------------------------------------------------------------------ reconciliation

class Reconciler:
    """Pays and receipts of the same tx id at most ``bound`` apart, for all tx ids of a group.

    Input columns: ``us``, ``pay`` (else a receipt), ``home`` (else a copy, there for its partners' sake only), ``nulls``
    (which of ``NULLS`` are null), tx_id, order_id, pay_channel.  A pair comes from the group that is its pay's home, as
    soon as both are in; a row without a partner comes from its home once the watermark has passed ``bound`` after it.

    State: the rows that the watermark has not passed by ``bound``, with ``hit`` if a partner came, in one Arrow table.
    It is joined with what a micro-batch brings by binary search in the receipts, ordered by (tx id, time)."""

    #: Bits of ``nulls``.
    NULLS = ("order_id", "pay_channel", "tx_id")
    PAIR, LONE_PAY, LONE_RECEIPT = range(3)
    OUT_ROWS = 50_000

    def __init__(self, bound_us: int):
        self.bound_us = bound_us

    def __call__(self, key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = [_unpacked(state.get[0])] if state.exists else []
        old = sum(len(df) for df in held)
        came = [] if state.hasTimedOut else [df.drop(columns=[c for c in df.columns if c in ("bucket", "span", "_et")]) for df in frames]
        rows = pd.concat([*held, *(df.assign(hit=False) for df in came if len(df))], ignore_index=True) if held or came else None
        if rows is None or not len(rows):
            return
        us, hit, home = (rows[c].to_numpy(copy=True) for c in ("us", "hit", "home"))
        if len(rows) > old:
            for p, r in self._pairs(rows, old):
                hit[p] = True
                hit[r] = True
                yield from self._out(rows, p[home[p]], r[home[p]], self.PAIR)
        keep = (us + self.bound_us > now * 1000) if now > 0 else np.ones(len(us), dtype=bool)
        lone, pay = ~keep & ~hit & home, rows["pay"].to_numpy()
        yield from self._out(rows, np.flatnonzero(lone & pay), np.flatnonzero(lone & pay), self.LONE_PAY)
        yield from self._out(rows, np.flatnonzero(lone & ~pay), np.flatnonzero(lone & ~pay), self.LONE_RECEIPT)
        if keep.any():
            state.update((_packed(rows.assign(hit=hit)[keep]),))
            # The call comes once the watermark is greater.
            state.setTimeoutTimestamp(max(_ceil_ms(int(us[keep].min()) + self.bound_us) - 1, now, 1))
        elif state.exists:
            state.remove()

    def _pairs(self, rows: pd.DataFrame, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of (pay, receipt), of which at least one is new."""
        us, pay = rows["us"].to_numpy(), rows["pay"].to_numpy()
        tx = pd.factorize(rows["tx_id"])[0].astype(np.int64)
        times, rank = np.unique(us, return_inverse=True)
        tx *= len(times) + 1
        place = tx + rank
        lo = tx + np.searchsorted(times, us - self.bound_us, "left")
        hi = tx + np.searchsorted(times, us + self.bound_us, "right")
        new = np.arange(len(us)) >= old
        for pays, recs in ((pay, ~pay & new), (pay & new, ~pay & ~new)):
            pays, recs = np.flatnonzero(pays), np.flatnonzero(recs)
            recs = recs[np.argsort(place[recs], kind="stable")]
            there = place[recs]
            for i, j in _expanded(np.searchsorted(there, lo[pays]), np.searchsorted(there, hi[pays]), self.OUT_ROWS):
                yield pays[i], recs[j]

    def _out(self, rows: pd.DataFrame, p: np.ndarray, r: np.ndarray, tag: int) -> Iterator[pd.DataFrame]:
        if len(p):
            col = lambda c, at: rows[c].to_numpy()[at]
            yield pd.DataFrame({"tx_id": col("tx_id", p), "order_id": col("order_id", p), "pay_us": col("us", p),
                                "pay_channel": col("pay_channel", r), "receipt_us": col("us", r),
                                "nulls": col("nulls", p) & 5 | col("nulls", r) & 2, "tag": tag})


def _expanded(first: np.ndarray, last: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each number with all of its span [first, last), some ``most`` pairs at once."""
    counts = last - first
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        before = ends[start] - counts[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        some = counts[start:stop]
        shift = np.repeat(first[start:stop] - (ends[start:stop] - some - before), some)
        if len(shift):
            yield np.repeat(np.arange(start, stop), some), np.arange(len(shift)) + shift
        start = stop


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


def reconcile(pays: DataFrame, receipts: DataFrame, bound_us: int, width_us: int | None = None) -> DataFrame:
    """Pays (tx_id, order_id, _et) and receipts (tx_id, pay_channel, _et), both behind watermarks, in groups of tx ids, or
    of tx ids and time buckets; columns as :class:`Reconciler` gives them."""
    kinds = {**dict(receipts.dtypes), **dict(pays.dtypes)}
    us = F.unix_micros("_et").alias("us")
    rows = pays.select("_et", us, F.lit(True).alias("pay"), "tx_id", "order_id", F.lit(None).cast(kinds["pay_channel"]).alias("pay_channel")) \
        .unionByName(receipts.select("_et", us, F.lit(False).alias("pay"), "tx_id", F.lit(None).cast(kinds["order_id"]).alias("order_id"),
                                     "pay_channel"))
    filled, nulls = _filled(rows, list(Reconciler.NULLS))
    keys, spans, home = ["bucket"], [], F.lit(True)
    if width_us is not None:
        first, last = ifloor(F.col("us") - F.lit(bound_us), width_us), ifloor(F.col("us") + F.lit(bound_us), width_us)
        rows = rows.withColumn("span", F.explode(F.sequence(first, last)))
        keys, spans, home = ["bucket", "span"], ["span"], F.col("span") == ifloor(F.col("us"), width_us)
    src = rows.select(_bucket(["tx_id"], TX_BUCKETS if width_us is None else SPAN_BUCKETS), *spans, "_et", "us", "pay", home.alias("home"),
                      nulls, *filled)
    out = (f"tx_id {kinds['tx_id']}, order_id {kinds['order_id']}, pay_us long, pay_channel {kinds['pay_channel']}, "
           "receipt_us long, nulls int, tag int")
    return src.groupBy(*keys).applyInPandasWithState(Reconciler(bound_us), out, "held binary", "append", "EventTimeTimeout")


# ------------------------------------------------------------------ orders

class OrderPatternProcessor(OrderedProcessor):
    """Each create with the first later pay less than ``within`` after it, else a timeout.

    State: [times of undecided creates]; empty once all are decided."""

    payload = ("is_create",)
    output = ("order_id", "create_us", "pay_us", "result")

    def __init__(self, within_us: int):
        self.within_us = within_us

    def fresh(self) -> list:
        return [[]]

    def step(self, key, st, us, seq, row):
        out = self.advance(key, st, us)               # a pay at the bound itself is too late
        if row[0]:
            st[0].append(us)
        else:
            out += [(key[0], c, us, PAYED_SUCCESS) for c in st[0]]
            st[0] = []
        return out

    def advance(self, key, st, wm_us):
        out = [(key[0], c, None, PATTERN_TIMEOUT) for c in st[0] if c + self.within_us <= wm_us]
        st[0] = [c for c in st[0] if c + self.within_us > wm_us]
        return out

    def wake_at(self, st):
        return min(st[0]) + self.within_us if st[0] else None


class OrderStatusProcessor(OrderedProcessor):
    """Each create that no pay preceded: paid if a pay comes by create + timeout (inclusive), else timeout.

    State: [times of undecided creates, time of the latest pay].  A pay is remembered for ``memory``
    (for ever if None, as the batch form does by default): only the caller can know how much
    later a create may still come."""

    payload = ("is_create",)
    output = ("order_id", "create_us", "pay_us", "result")

    def __init__(self, timeout_us: int, memory_us: int | None):
        self.timeout_us, self.memory_us = timeout_us, memory_us

    def fresh(self) -> list:
        return [[], None]

    def step(self, key, st, us, seq, row):
        if not row[0]:
            out = [(key[0], c, us, STATUS_PAYED) for c in st[0]]
            st[:] = [[], us]
            return out
        known = st[1] is not None and (self.memory_us is None or us - st[1] <= self.memory_us)
        if not known:
            st[0].append(us)
        return []

    def advance(self, key, st, wm_us):
        out = [(key[0], c, None, STATUS_TIMEOUT) for c in st[0] if c + self.timeout_us <= wm_us]
        st[0] = [c for c in st[0] if c + self.timeout_us > wm_us]
        return out

    def wake_at(self, st):
        return min(st[0]) + self.timeout_us if st[0] else None

    def forget_at(self, st):
        if st[0] or st[1] is None or self.memory_us is None:
            return None
        return st[1] + self.memory_us + 1


class OrderMatchProcessor(OrderedProcessor):
    """One row per order, decided by its first create and first pay within ``horizon`` of each other.

    State: [create, pay, done].  An order that is done is remembered for ``memory`` more (for ever if
    None), so that its later events make no second row."""

    payload = ("is_create",)
    output = ("order_id", "create_us", "pay_us", "result")

    def __init__(self, timeout_us: int, horizon_us: int, memory_us: int | None):
        self.timeout_us, self.horizon_us, self.memory_us = timeout_us, horizon_us, memory_us

    def fresh(self) -> list:
        return [None, None, None]

    def _decide(self, key, st, us, result):
        st[2] = us
        return [(key[0], st[0], st[1], result)]

    def step(self, key, st, us, seq, row):
        if st[2] is not None:
            return []
        at = 0 if row[0] else 1
        if st[at] is None:
            st[at] = us
        if st[0] is None or st[1] is None:
            return []
        in_time = st[1] < st[0] + self.timeout_us
        return self._decide(key, st, us, MATCH_PAYED if in_time else MATCH_LATE)

    def advance(self, key, st, wm_us):
        if st[2] is not None or (st[0] is None and st[1] is None):
            return []
        end = (st[0] if st[1] is None else st[1]) + self.horizon_us
        if end > wm_us:
            return []
        return self._decide(key, st, end, MATCH_NO_PAY if st[1] is None else MATCH_NO_CREATE)

    def wake_at(self, st):
        known = [t for t in st[:2] if t is not None]
        return min(known) + self.horizon_us if known and st[2] is None else None

    def forget_at(self, st):
        return None if st[2] is None or self.memory_us is None else st[2] + self.memory_us


ORDER_SCHEMA = "order_id long, create_us long, pay_us long, result string"


def _order_stream(order_events: DataFrame, proc: OrderedProcessor, delay) -> DataFrame:
    src = order_events.withColumn("is_create", F.col("event_type") == CREATE)
    out = _ordered(src, ["order_id"], proc, ORDER_SCHEMA, delay)
    return out.select("order_id", micros_to_ts(F.col("create_us")).alias("create_ts"),
                      micros_to_ts(F.col("pay_us")).alias("pay_ts"), "result")


def stream_order_pattern(order_events: DataFrame, within=TIMEOUT, delay="0 seconds") -> DataFrame:
    """Both outputs of the create-followed-by-pay pattern, as ``orders.order_pattern``."""
    out = _order_stream(order_events, OrderPatternProcessor(duration_us(within)), delay)
    return out.withColumn("output", F.when(F.col("result") == PAYED_SUCCESS, F.lit("payed"))
                          .otherwise(F.lit("timeout")))


def stream_order_status(order_events: DataFrame, timeout=TIMEOUT, delay="0 seconds", memory=None) -> DataFrame:
    """(order_id, create_ts, result) as ``orders.order_timeout_status``."""
    memory_us = None if memory is None else duration_us(memory)
    return _order_stream(order_events, OrderStatusProcessor(duration_us(timeout), memory_us), delay).drop("pay_ts")


def stream_order_match(order_events: DataFrame, timeout=TIMEOUT, horizon=None, delay="0 seconds",
                       memory=None) -> DataFrame:
    """(order_id, result, output) as ``orders.order_pay_match`` with the same ``horizon`` (default: twice
    the timeout; a stream cannot wait for ever)."""
    t = duration_us(timeout)
    proc = OrderMatchProcessor(t, 2 * t if horizon is None else duration_us(horizon),
                               None if memory is None else duration_us(memory))
    out = _order_stream(order_events, proc, delay)
    return out.select("order_id", "result", F.when(F.col("result") == MATCH_PAYED, F.lit("payed"))
                      .otherwise(F.lit("timeout")).alias("output"))


class OpenOrderProcessor:
    """Create and pay of an order meet as soon as both are in; an order that is still half open has a timer.

    The first of the two to arrive is stored with a timer: a create's fires at create + timeout (no pay came in
    time), a pay's at the pay itself (by then its create would have come).  When the other arrives in time, the row is
    emitted at once, the timers are deleted and nothing of the order is held.  A pay at or after create + timeout meets no
    create: both ends of the order are then reported on their own.  An order has one create and one pay; the result is
    the same for any split into batches.

    State, only of half-open orders: [create, pay, timers] (times null: not seen), in ``open``."""

    output = ("order_id", "create_us", "pay_us", "result")

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us
        self.open: dict[tuple, list] = {}

    def _due(self, create, pay):
        return (None if create is None else _ceil_ms(create + self.timeout_us)), (None if pay is None else _ceil_ms(pay))

    def arrive(self, key, us: int, is_create: bool) -> None:
        st = self.open.setdefault(key, [None, None, []])
        at = 0 if is_create else 1
        if st[at] is None:
            st[at] = us

    def meet(self, key, now: int) -> list[tuple]:
        """What the rows of ``key`` that came in decide."""
        st = self.open[key]
        create, pay, _ = st
        if create is not None and pay is not None and pay < create + self.timeout_us:
            del self.open[key]                            # paid: no timer is left
            return [(*key, create, pay, MATCH_PAYED)]
        st[2] = sorted({max(t, now + 1) for t in self._due(create, pay) if t is not None})
        return []

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[tuple]:
        """One timer of an order."""
        now = timerValues.getCurrentWatermarkInMs()
        create, pay, timers = self.open.get(key, (None, None, ()))
        ends = self._due(create, pay)
        if ends[0] is not None and ends[0] <= now:
            yield (*key, create, None, MATCH_NO_PAY)
            create = None
        if ends[1] is not None and ends[1] <= now:
            yield (*key, None, pay, MATCH_NO_CREATE)
            pay = None
        if create is None and pay is None:
            self.open.pop(key, None)
        else:
            self.open[key] = [create, pay, [t for t in timers if t > now]]


class OpenOrderBuckets(StatefulProcessor):
    """Runs an :class:`OpenOrderProcessor` for all orders of a bucket, with one timer for the next due one."""

    def __init__(self, orders: OpenOrderProcessor):
        self.orders, self.output = orders, list(orders.output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "orders string, timer long")

    def _load(self) -> int | None:
        held = self.held.get()
        self.orders.open = {tuple(k): st for k, st in json.loads(held[0])} if held is not None else {}
        return held[1] if held is not None else None

    def _store(self, pending: int | None) -> None:
        at = min((t for st in self.orders.open.values() for t in st[2]), default=None)
        if pending != at:
            if pending is not None:
                self.handle.deleteTimer(pending)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.held.clear()
        else:
            self.held.update((json.dumps([*self.orders.open.items()]), at))

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pending, now, seen = self._load(), timerValues.getCurrentWatermarkInMs(), {}
        for df in rows:
            for order, null, us, is_create in zip(*(df[c].tolist() for c in ("order_id", "nulls", "ev_us", "is_create"))):
                k = (None if null else order,)
                self.orders.arrive(k, us, is_create)
                seen[k] = True
        out = [row for k in seen for row in self.orders.meet(k, now)]
        self._store(pending)
        if out:
            yield pd.DataFrame(out, columns=self.output, dtype=object)

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for k, t in [(k, t) for k, st in self.orders.open.items() for t in st[2] if t <= now]:
            for row in self.orders.handleExpiredTimer(k, timerValues, t):
                out += row.itertuples(index=False, name=None) if isinstance(row, pd.DataFrame) else [row]
        self._store(None)                                 # the timer that fires is gone
        if out:
            yield pd.DataFrame(out, columns=self.output, dtype=object)

    def close(self) -> None:
        pass


def stream_open_orders(order_events: DataFrame, timeout=TIMEOUT, delay="0 seconds",
                       processor: type[OpenOrderProcessor] = OpenOrderProcessor) -> DataFrame:
    """(order_id, create_ts, pay_ts, result, output): paid orders as soon as both events are in, the rest when
    their timers fire.  For orders with one create and one pay; ``seq`` is not needed."""
    _require_rocksdb(order_events)
    ev = _event_rows(order_events, delay)
    (order,), nulls = _filled(ev, ["order_id"])
    src = ev.select(_bucket(["order_id"], BUCKETS), "_et", F.unix_micros("_et").alias("ev_us"), order, nulls,
                    (F.col("event_type") == CREATE).alias("is_create"))
    out = src.groupBy("bucket").transformWithStateInPandas(OpenOrderBuckets(processor(duration_us(timeout))), ORDER_SCHEMA,
                                                           "append", "EventTime")
    return out.select("order_id", micros_to_ts(F.col("create_us")).alias("create_ts"),
                      micros_to_ts(F.col("pay_us")).alias("pay_ts"), "result",
                      F.when(F.col("result") == MATCH_PAYED, F.lit("payed")).otherwise(F.lit("timeout")).alias("output"))


# ------------------------------------------------------------------ unique visitors, one row per view

class RunningUvProcessor(OrderedProcessor):
    """Every view with the bitmap count of its window after it, in event order.

    The key is the window.  Its bitmap is kept in pages of ``PAGE_BITS`` slots in a map state; a page is read when a
    view of a due slice falls into it, and written back once when the slices are done.  Everything goes when
    the watermark has passed the window.  Unknown users share a slot of their own, as in the batch form.
    State: [views seen, bits set]."""

    payload = ("user_id", "known", "slot")
    output = ("window_us", "ev_us", "seq", "user_id", "known", "uv")
    PAGE_BITS = 1 << 15

    def __init__(self, size_us: int, slice_us: int):
        self.size_us, self.slice_us = size_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pages = handle.getMapState("pages", "page long", "bits binary")
        self.held: dict[int, bytearray] = {}

    def fresh(self) -> list:
        return [0, 0]

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held = {}
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if timerValues.getCurrentWatermarkInMs() * 1000 >= key[0] + self.size_us:
            self.pages.clear()
        else:
            for page, bits in self.held.items():
                self.pages.updateValue((page,), (bytes(bits),))

    def step(self, key, st, us, seq, row):
        user, known, slot = row
        st[0] += 1
        page, bit = divmod(slot, self.PAGE_BITS)
        if page not in self.held:
            stored = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
            self.held[page] = bytearray(stored[0]) if stored else bytearray(self.PAGE_BITS // 8)
        bits, mask = self.held[page], 1 << (bit & 7)
        if not bits[bit >> 3] & mask:
            bits[bit >> 3] |= mask
            st[1] += 1
        return [(key[0], us, seq, user, known, st[1])]

    def forget_at(self, st):
        return self.end

    def advance(self, key, st, wm_us):
        self.end = key[0] + self.size_us
        return []


def stream_uv_per_view(views: DataFrame, size="1 hour", delay="0 seconds", user: str = "user_id",
                       seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS) -> DataFrame:
    """The rows of ``distinct.uv_running`` as a stream: window_start, window_end, ts, seq, user_id, uv."""
    size_us = duration_us(size)
    src = views.withColumn("slot", F.coalesce(user_slot(views, user, seed, bits), F.lit(-1))).withColumn("known", F.col(user).isNotNull()) \
        .withColumn("user_id", F.coalesce(F.col(user).cast("long"), F.lit(0)))
    src = src.withColumn("window_us", ifloor(to_micros(views, "ts"), size_us) * F.lit(size_us))
    out = _ordered(src, ["window_us"], RunningUvProcessor(size_us, max(1, size_us // 60)),
                   "window_us long, ev_us long, seq long, user_id long, known boolean, uv long", delay, buckets=None)
    return out.select(micros_to_ts(F.col("window_us")).alias("window_start"),
                      micros_to_ts(F.col("window_us") + F.lit(size_us)).alias("window_end"),
                      micros_to_ts(F.col("ev_us")).alias("ts"), "seq", F.when(F.col("known"), F.col("user_id")).alias("user_id"), "uv")


# ------------------------------------------------------------------ sliding sums of closed panes

class SlidingProcessor(StatefulProcessor):
    """Counts of the sliding windows that start in one block of time, from closed panes (start, key, count).

    Rows of the state: what a micro-batch brought, sorted by pane; a window is given out once the watermark has passed
    its end, by a running count that panes enter and leave.  With ``top`` only its highest counts are, ties to the smaller
    key.  A row goes when no open window has its pane, all go with the block's last window."""

    output = ("window_start_us", "key", "cnt")
    OUT_ROWS = 50_000
    CHUNK = 50_000

    def __init__(self, size_us: int, slide_us: int, width_us: int, top: int | None, number: bool):
        self.size_us, self.slide_us, self.width_us, self.top, self.number = size_us, slide_us, width_us, top, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "last long, no long", "rows string")
        self.book = handle.getValueState("book", "no long, start long, timer long")  # next chunk, window and timer

    def _first_start(self, pane: int) -> int:
        return first_start(pane, self.size_us, self.slide_us)

    def _wake(self, no: int, start: int | None, pending: int | None, now: int) -> None:
        """The timer of the next window that may have rows; nothing is kept without one."""
        at = None if start is None else max(_ceil_ms(start + self.size_us), now)
        if pending != at:
            if pending is not None:
                self.handle.deleteTimer(pending)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.book.clear()
        else:
            self.book.update((no, start, at))

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        no, start, pending = self.book.get() or (0, None, None)
        block = key[0] * self.width_us
        for df in rows:
            for i in range(0, len(df), self.CHUNK):
                new = df.iloc[i:i + self.CHUNK].sort_values("pane_us", kind="stable")
                panes = new["pane_us"].tolist()
                keys = [k if isinstance(k, str) else None for k in new["key"].tolist()]
                self.panes.updateValue((panes[-1], no), (json.dumps([panes, keys, new["cnt"].tolist()]),))
                no += 1
                first = max(self._first_start(panes[0]), -(-block // self.slide_us) * self.slide_us)
                start = first if start is None else min(start, first)
        if start is not None:
            self._wake(no, start, pending, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        no, start, _ = self.book.get()
        slots = [tuple(slot) for slot in self.panes.keys()]
        at, keys, cnt = [], [], []
        for slot in slots:
            for held, part in zip((at, keys, cnt), json.loads(self.panes.getValue(slot)[0])):
                held += part
        names, codes = coded(keys, self.number)
        del keys
        at, cnt = np.array(at, dtype=np.int64), np.array(cnt, dtype=np.int64)
        order = np.argsort(at, kind="stable")
        at, cnt, codes = at[order], cnt[order], codes[order]
        # Windows whose end the watermark has reached, up to the last one that starts in the block.
        end = min((now * 1000 - self.size_us) // self.slide_us * self.slide_us,
                  ((key[0] + 1) * self.width_us - 1) // self.slide_us * self.slide_us)
        end = min(end, int(at[-1]) // self.slide_us * self.slide_us)
        found: list[tuple] = []
        n_found = 0
        for window in running_windows(at, codes, cnt, len(names), start, end, self.size_us, self.slide_us, self.top):
            found.append(window)
            n_found += len(window[1])
            if n_found >= self.OUT_ROWS:
                yield window_rows(found, names, "window_start_us")
                found, n_found = [], 0
        start = max(start, end + self.slide_us)
        if found:
            yield window_rows(found, names, "window_start_us")
        for slot in slots:
            if slot[0] < start:
                self.panes.removeKey(slot)
        last = ((key[0] + 1) * self.width_us - 1) // self.slide_us * self.slide_us
        left = int(np.searchsorted(at, start))
        more = start <= last and left < len(at)
        if not more:
            self.panes.clear()
        # The timer that fires is gone; the next window is one that has panes.
        self._wake(no, max(start, self._first_start(int(at[left]))) if more else None, None, now + 1)

    def close(self) -> None:
        pass


#: Groups of keys a block of time is split into.
PARTS = 8


def sliding_sums(panes: DataFrame, keys: list[str], size_us: int, slide_us: int, count_col: str, top: int | None = None) -> DataFrame:
    """(window_start_us, *keys, count) of closed sliding windows from closed panes (window_start_us, *keys, count)."""
    from pyspark.sql import types as T
    _require_rocksdb(panes)
    if top is not None and len(keys) != 1:
        raise ValueError("the highest counts need one key")
    fields = T.StructType([panes.schema[k] for k in keys])
    if len(keys) == 1:
        name, number = F.col(keys[0]).cast("string"), isinstance(fields[0].dataType, T.IntegralType)
    else:
        name, number = F.to_json(F.struct(*keys)) if keys else F.lit(""), False
    # Blocks are whole slides, at least as long as a window, so a pane is in two of them at most; short windows share one.
    width = max(-(-size_us // slide_us), -(-HOUR_US // slide_us)) * slide_us
    pane = F.col("window_start_us")
    first = ifloor((ifloor(pane - F.lit(size_us), slide_us) + 1) * F.lit(slide_us), width)
    last = ifloor(ifloor(pane, slide_us) * F.lit(slide_us), width)
    src = panes.select(F.explode(F.sequence(first, last)).alias("block"), F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("part") if keys else F.lit(0).alias("part"),
                       pane.alias("pane_us"), name.alias("key"), F.col(count_col).alias("cnt"))
    out = src.groupBy("block", "part").transformWithStateInPandas(
        SlidingProcessor(size_us, slide_us, width, top, number), "window_start_us long, key string, cnt long", "append", "EventTime")
    if len(keys) == 1:
        back = [F.col("key").cast(fields[0].dataType).alias(keys[0])]
    else:
        row = F.from_json("key", fields)
        back = [row[k].alias(k) for k in keys]
    return out.select("window_start_us", *back, F.col("cnt").alias(count_col))


# ------------------------------------------------------------------ top-n of closed windows

class TopNProcessor(StatefulProcessor):
    """The n best rows of a window's counts.

    State: at most n (count, key) entries a window, however many keys it has; it is emitted and
    cleared by a timer at the end of the window."""

    output = ("window_end_us", "key", "cnt", "rank")

    def __init__(self, n: int, number: bool):
        self.n, self.number = n, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "entries string")

    def _order(self, e):
        return -e[0], (e[1] is not None, e[1] if self.number else (e[1] or "").encode())

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        best = json.loads(held[0]) if held is not None else []
        for df in rows:
            top = df.nlargest(self.n, "cnt", keep="all") if len(df) > self.n else df
            keys = [None if k is None or k != k else int(k) if self.number else k for k in top["key"].tolist()]
            best = sorted([*best, *([c, k] for c, k in zip(top["cnt"].tolist(), keys))], key=self._order)[:self.n]
        self.best.update((json.dumps(best),))
        rearm(self.handle, _ceil_ms(key[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        self.best.clear()
        if held is not None:
            rows = [(key[0], k, c, r) for r, (c, k) in enumerate(json.loads(held[0]), 1)]
            yield pd.DataFrame(rows, columns=list(self.output))

    def close(self) -> None:
        pass


def stream_topn(events: DataFrame, key: str, size, slide, n: int, delay="0 seconds") -> DataFrame:
    """(window_start, window_end, key, cnt, rank): the n keys with the highest counts of each closed window, ties to
    the smaller key.  The ranking is a stateful operator behind the window count, in one streaming plan."""
    from pyspark.sql import types as T
    from .windows import window_counts
    _require_rocksdb(events)
    dtype = events.schema[key].dataType
    number = isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    counts = window_counts(events, "ts", [key], size, slide, delay, top=n)
    src = counts.select((F.col("window_start_us") + F.lit(duration_us(size))).alias("window_end_us"),
                        F.col(key).cast("long" if number else "string").alias("key"), "cnt")
    kind = "long" if number else "string"
    out = src.groupBy("window_end_us").transformWithStateInPandas(
        TopNProcessor(n, number), f"window_end_us long, key {kind}, cnt long, rank int", "append", "EventTime")
    end = F.col("window_end_us")
    return out.select(micros_to_ts(end - F.lit(duration_us(size))).alias("window_start"), micros_to_ts(end).alias("window_end"),
                      F.col("key").cast(dtype).alias(key), "cnt", "rank")
