"""The cost of the streaming operators: calls to the state store and rows between operators, not seconds."""

import json
import random

import pandas as pd
import pytest

from conftest import frame
from tidemark.operators import topn, windows
from tidemark.streaming import processors as SP

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


class Store:
    """The state of one group; counts the calls, each of which is a round trip to the JVM."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        return Cells(self)

    getValueState = getMapState

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)


class Cells:
    def __init__(self, store):
        self.store, self.cells = store, {}

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "keys", "containsKey", "getValue", "updateValue", "removeKey"):
            self.store.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.cells.get(None)

    def update(self, v):
        self.cells[None] = v

    def clear(self):
        self.cells.clear()

    def keys(self):
        return list(self.cells)

    def containsKey(self, k):
        return k in self.cells

    def getValue(self, k):
        return self.cells[k]

    def updateValue(self, k, v):
        self.cells[k] = v

    def removeKey(self, k):
        del self.cells[k]


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _play(proc, batches, key):
    """Output and state calls of one group; ``batches``: (rows, watermark in ms after them)."""
    store, out, now = Store(), [], 0
    proc.init(store)
    for frame, then in batches:
        out += [r for df in proc.handleInputRows(key, iter([frame]), At(now)) for r in df.itertuples(index=False, name=None)]
        now = then
        due = {t for t in store.timers if t <= now}
        assert len(due) <= 1
        store.timers -= due
        for _ in due:
            out += [r for df in proc.handleExpiredTimer(key, At(now), None) for r in df.itertuples(index=False, name=None)]
    return out, store


def test_state_calls_do_not_grow_with_the_keys():
    """Keys of a group share its reads, writes and timer: 3,000 orders over 300 days took some ten calls each."""
    rows = [(DAY * (k % 300) + 1 + p * DAY, 2 * k + p, 0, k, not p) for k in range(3000) for p in (0, 1) if not (p and k % 3 == 0)]
    cols = ["ev_us", "seq", "nulls", "order_id", "is_create"]
    batches = [(pd.DataFrame(rows[::2], columns=cols), 0), (pd.DataFrame(rows[1::2], columns=cols), 200 * 86_400_000),
               (pd.DataFrame([], columns=cols), 400 * 86_400_000)]
    out, store = _play(SP.BucketedProcessor(SP.OrderPatternProcessor(30 * DAY), ["order_id"]), batches, (0,))
    assert sorted(r[0] for r in out) == list(range(3000)) and not store.timers
    assert all((r[2] is None or r[2] != r[2]) == (r[0] % 3 == 0) for r in out)
    assert store.calls < 300


def test_open_orders_share_their_state_calls():
    rows = [(k, 0, DAY * (k % 300) + p, not p) for k in range(3000) for p in (0, 1) if not (p and k % 3 == 0)]
    cols = ["order_id", "nulls", "ev_us", "is_create"]
    batches = [(pd.DataFrame(rows[::2], columns=cols), 0), (pd.DataFrame(rows[1::2], columns=cols), 1000 * 86_400_000)]
    out, store = _play(SP.OpenOrderBuckets(SP.OpenOrderProcessor(30 * DAY)), batches, (0,))
    assert sorted(r[0] for r in out) == list(range(3000)) and not store.timers
    assert store.calls < 30


def test_null_keys_and_numbers_stay_null():
    """Nulls would make pandas turn a column of longs into floats; key and seq come back as they were."""
    big = (1 << 60) + 1
    cols = ["ev_us", "seq", "nulls", "user_id", "ad_id", "province", "city"]
    rows = [(5, 0, 1, big, 1, "p", None), (5, 7, 0, big, 1, "p", "c"), (6, 8, 2, 0, 1, None, "c")]
    out, _ = _play(SP.BucketedProcessor(SP.ClickCapProcessor(1, None), ["user_id", "ad_id"]),
                   [(pd.DataFrame(rows, columns=cols), 1000)], (0,))
    got = [tuple(None if v is None or v != v else v for v in r) for r in out]
    assert [r[-1] for r in got] == ["main", "blacklist", "main"]
    assert got[0][0] == got[1][0] == big and got[2][0] is None
    assert got[0][5] == 7 and got[1][5] is None and got[2][2:4] == (None, "c")


def _sliding(seed, number):
    """Closed panes in batches with the watermark that closed them, and the counts of each window that starts in the hour."""
    rnd = random.Random(seed)
    panes, want = {}, {}
    for _ in range(300):
        at = HOUR + rnd.choice([rnd.randrange(60), 40 + rnd.randrange(3)]) * MINUTE
        panes.setdefault(at, {})
        k = rnd.choice([None, *(["3", "10", "200"] if number else ["a", "B", "ü", "zz"])])
        panes[at][k] = panes[at].get(k, 0) + 1
        for start in range(at - 9 * MINUTE, at + 1, MINUTE):
            if HOUR <= start < 2 * HOUR:
                want[start, k] = want.get((start, k), 0) + 1
    cuts = [0, 67, 67, 91, 93, 130, 140]
    batches = [(pd.DataFrame([(at, k, c) for at in sorted(panes) if lo < at // MINUTE + 1 <= hi for k, c in panes[at].items()],
                             columns=["pane_us", "key", "cnt"]), hi * 60_000) for lo, hi in zip(cuts, cuts[1:])]
    return batches, want


@pytest.mark.parametrize("top, number", [(None, False), (2, False), (2, True)])
def test_sliding_sums_of_one_block(top, number):
    """A pane is held once in its block, not once for each window; windows come once, with all or the highest counts."""
    batches, want = _sliding(3, number)
    now, got = 0, []
    proc, store = SP.SlidingProcessor(10 * MINUTE, MINUTE, HOUR, top, number), Store()
    proc.init(store)
    for frame, then in batches:                           # the panes come in the batch whose watermark closes them
        list(proc.handleInputRows((1, 0), iter([frame] if len(frame) else []), At(then)))
        now = then
        assert sum(len(json.loads(rows)[0]) for (rows,) in proc.panes.cells.values()) <= len(want) // 2
        due = {t for t in store.timers if t <= now}
        store.timers -= due
        for _ in due:
            out = [r for df in proc.handleExpiredTimer((1, 0), At(now), None) for r in df.itertuples(index=False, name=None)]
            assert all(now * 1000 - r[0] >= 10 * MINUTE for r in out)
            got += out
    if top is not None:
        order = lambda w: (-w[1], w[0][1] is not None, (int(w[0][1]) if number else w[0][1].encode()) if w[0][1] is not None else 0)
        want = {k: c for s in {s for s, _ in want} for k, c in sorted((w for w in want.items() if w[0][0] == s), key=order)[:top]}
    assert sorted(map(str, got)) == sorted(str((s, k, c)) for (s, k), c in want.items())
    assert not store.timers and not proc.panes.cells and store.calls < 100


@pytest.mark.parametrize("key", ["url", "item"])
def test_batch_ranking_expands_no_windows(spark, key):
    """The ranking sees a few rows for each window, however many keys it has, and gives the rows of the plain counts."""
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *(f"ü{k}" for k in range(60))]), rnd.randrange(9, 200), 1_700_000_000 + rnd.randrange(5000)) for _ in range(2000)]
    df = frame(spark, rows, "url string, item long, ts long")
    top = windows.sliding_top(df, "ts", key, "10 minutes", "5 seconds", 2).cache()
    plain = windows.sliding_count(df, "ts", [key], "10 minutes", "5 seconds")
    per_window = top.groupBy("window_end").count().agg({"count": "max"}).first()[0]
    assert per_window <= 2 * windows.TOP_PARTS and top.count() * 2 < plain.count()
    ranked = [sorted(map(str, topn.topn_per_group(c, "window_end", "cnt", key, 2).collect())) for c in (top, plain)]
    assert ranked[0] == ranked[1] and ranked[0]
    top.unpersist()


class Held:
    """The state of one group of a reconciliation; counts its writes."""

    def __init__(self):
        self.get, self.now, self.due, self.writes, self.hasTimedOut = None, 0, None, 0, False

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, v):
        self.get, self.writes = v, self.writes + 1

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.now and ms > 0
        self.due = ms


@pytest.mark.parametrize("seed, width", [(1, None), (2, None), (3, 40), (4, 25)])
def test_reconciliation_writes_its_state_once_a_call(seed, width):
    """All rows of a group take one write a call, not some for each row; every pair and lone row comes once, nulls and repeats too."""
    rnd = random.Random(seed)
    bound, sec = 10, 1_000_000
    rows = [(100 + k // 3 + rnd.randrange(8), rnd.random() < 0.5, rnd.choice(["a", "b", "c"]), rnd.choice([None, (1 << 60) + k])) for k in range(600)]
    rows += [(100 + k, False, None, None) for k in range(0, 200, 20)] + rows[:20]
    rows.sort(key=lambda r: r[0] + rnd.randrange(9))
    cuts = [0, 150, 151, 400, len(rows)]
    groups, got, top = {}, [], 0

    def call(span, df, timed_out):
        state = groups[span]
        state.hasTimedOut, writes, state.due = timed_out, state.writes, None
        for out in SP.Reconciler(bound * sec)((0,), iter([df]), state):
            for tx, order, p, ch, r, nulls, tag in out.itertuples(index=False, name=None):
                got.append((None if nulls & 4 else tx, None if tag == 2 or nulls & 1 else order, None if tag == 2 else p // sec,
                            None if tag == 1 or nulls & 2 else ch, None if tag == 1 else r // sec))
        assert state.writes - writes <= 1
        if state.exists:
            held = SP._unpacked(state.get[0])
            assert state.due is not None and (held["us"] + bound * sec > state.now * 1000).all()

    cols = ["us", "pay", "home", "nulls", "tx_id", "order_id", "pay_channel"]
    for lo, hi in [*zip(cuts, cuts[1:]), (len(rows), len(rows))]:
        new = {}
        for at, pay, tx, x in rows[lo:hi]:
            for span in [0] if width is None else range((at - bound) // width, (at + bound) // width + 1):
                nulls = (1 if not pay or x is None else 0) + (2 if pay or x is None else 0) + (4 if tx is None else 0)
                new.setdefault(span, []).append((at * sec, pay, width is None or span == at // width, nulls, tx or "",
                                                 x if pay and x else 0, str(x) if not pay and x else ""))
        for span, some in new.items():
            groups.setdefault(span, Held())
            call(span, pd.DataFrame(some, columns=cols), False)
        top = max([top, *(r[0] for r in rows[lo:hi])])
        for span, state in groups.items():
            state.now = (top - 9) * 1000 if hi > lo else 10_000_000
            if state.exists and state.due < state.now:
                call(span, pd.DataFrame([], columns=cols), True)
    assert not any(s.exists for s in groups.values())
    pays, recs = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    near = lambda p, r: p[2] == r[2] and abs(p[0] - r[0]) <= bound
    name = lambda x: None if x is None else str(x)
    want = [(p[2], p[3], p[0], name(r[3]), r[0]) for p in pays for r in recs if near(p, r)]
    want += [(p[2], p[3], p[0], None, None) for p in pays if not any(near(p, r) for r in recs)]
    want += [(r[2], None, None, name(r[3]), r[0]) for r in recs if not any(near(p, r) for p in pays)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def _play_packed(proc, keys, batches):
    """Output of one packed group, nulls as None, and the most rows that waited; ``batches``: (rows, watermark in ms after them)."""
    state, out, most = Held(), [], 0

    def call(df, timed_out):
        state.hasTimedOut, state.due, writes = timed_out, None, state.writes
        got = [r for o in SP.PackedGroups(proc, keys)((0,), iter([df]), state) for r in o.itertuples(index=False, name=None)]
        assert state.writes - writes <= 1
        return [tuple(None if v is None or v != v else v for v in r) for r in got]

    for df, then in batches:
        if len(df):
            out += call(df, False)
        if state.exists and state.get[0]:
            most = max(most, len(SP._unpacked(state.get[0])))
        state.now = then
        if state.exists and state.due is not None and state.due < state.now:
            out += call(df[:0], True)
    return out, most, state


def _packed_batches(rows, cols, lag):
    """``rows`` (seconds first) in batches, late rows left out, with a watermark ``lag`` seconds behind and one far on at the end."""
    batches, kept, top, cuts, n = [], [], 0, [0, 120, 121, 300, len(rows)], cols.index("nulls")
    for lo, hi in zip(cuts, cuts[1:]):
        wm = max(0, top - lag)
        some = rows[lo:hi]
        kept += [r for r in some if r[0] > wm]
        filled = [(r[0] * 1_000_000, *(0 if v is None else v for v in r[1:n]), sum(1 << i for i, v in enumerate(r[1:n]) if v is None), *r[n:])
                  for r in some]
        top = max([top, *(r[0] for r in some)])
        batches.append((pd.DataFrame(filled, columns=cols), max(0, top - lag) * 1000))
    return [*batches, (pd.DataFrame([], columns=cols), 10_000_000_000)], kept


@pytest.mark.parametrize("seed, reset", [(1, None), (2, None), (3, 100)])
def test_packed_click_cap(seed, reset):
    """All keys of a group at once, one write a call, and no more waiting clicks than can pass; nulls, ties and late rows too."""
    rnd = random.Random(seed)
    big = 1 << 60
    rows = [(500 + 2 * k + rnd.randrange(-9, 9), rnd.choice([None, k, k]), rnd.choice([None, 0, big + 1]), rnd.choice([0, 1]), rnd.choice([None, "p"]), "c")
            for k in range(450)]
    batches, kept = _packed_batches(rows, ["ev_us", "seq", "user_id", "ad_id", "nulls", "province", "city"], 12)
    want, seen = [], {}
    for at, seq, user, ad, province, city in sorted(kept, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        key = user, ad, at // reset if reset else 0
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= 3:
            want.append((user, ad, province, city, at * 1_000_000, seq, "main" if seen[key] <= 2 else "blacklist"))
    got, most, state = _play_packed(SP.ClickCapProcessor(2, reset and reset * 1_000_000), ["user_id", "ad_id"], batches)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    assert most <= 3 * 6 * (1 if not reset else 5)
    assert state.exists == (reset is None)               # without a reset the counts stay


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packed_login_pairs(seed):
    rnd = random.Random(seed)
    rows = [(500 + k + rnd.randrange(-9, 9), k, rnd.choice([None, 0, 7, (1 << 60) + 1]), rnd.choice([True, True, False])) for k in range(450)]
    batches, kept = _packed_batches(rows, ["ev_us", "seq", "user_id", "nulls", "fail"], 12)
    want, last = [], {}
    for at, _, user, fail in sorted(kept, key=lambda r: r[:2]):
        if fail and last.get(user) is not None and at - last[user] < 5:
            want.append((user, last[user] * 1_000_000, at * 1_000_000, 2))
        last[user] = at if fail else None
    got, _, state = _play_packed(SP.FailPairProcessor(5_000_000), ["user_id"], batches)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    assert not state.exists


@pytest.mark.parametrize("own", [None, "false"])
def test_streams_commit_changes_unless_the_session_says_otherwise(spark, own):
    from tidemark.streaming import runner
    before = spark.conf.get(runner.CHANGELOG, None)
    spark.conf.unset(runner.CHANGELOG) if own is None else spark.conf.set(runner.CHANGELOG, own)
    try:
        with runner.state_store(spark):
            assert spark.conf.get(runner.CHANGELOG) == (own or "true")
        assert spark.conf.get(runner.CHANGELOG, None) == own
    finally:
        spark.conf.unset(runner.CHANGELOG) if before is None else spark.conf.set(runner.CHANGELOG, before)
