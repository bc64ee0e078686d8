"""Cancelled timers, late updates, the keyed sink, per-view unique visitors, ranking in the plan, text with order."""

import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import epoch, frame
from test_streaming import FAR, ORDER, _feed, _rows
from tidemark.operators import distinct, topn, windows
from tidemark.sources import text
from tidemark.streaming import processors as SP
from tidemark.streaming import sinks
from tidemark.streaming import windows as SW

T0 = 1_700_000_000
VIEW = "user_id long, item_id long, ts long, seq long"


class CountingOrders(SP.OpenOrderProcessor):
    """Reports every timer that fires, also those that find nothing to do."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = list(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))
        yield pd.DataFrame([(key[0], None, None, "fired")], columns=list(self.output))
        yield from out


def _orders(seed=0, n=60, timeout=100):
    """One create and / or one pay an order, in disorder of up to 20 s; the right results, and the orders of the timers that
    are due."""
    rnd = random.Random(seed)
    rows, want, due = [], [], []
    for k in range(n):
        c, d = T0 + 10 * k, rnd.choice([-3, 0, 1, 50, 99, 100, 101, 300])
        has_c, has_p = rnd.choice([(1, 1), (1, 1), (1, 0), (0, 1)])
        if has_c:
            rows.append((k, "create", "", c, 2 * k))
        if has_p:
            rows.append((k, "pay", f"t{k}", c + d, 2 * k + 1))
        if has_c and has_p and d < timeout:
            want.append((k, "payed successfully"))
        else:
            want += [(k, "time out")] * has_c + [(k, "already payed but not found create log")] * has_p
            due += [k] * len({*[c + timeout] * has_c, *[c + d] * has_p})  # one timer where both are due at once
    rows.sort(key=lambda r: r[3] + rnd.randrange(20))
    return [*rows, (10_000, "create", "", rows[-1][3] + FAR, 9999)], sorted(want), sorted(due)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_open_orders_cancel_their_timers(spark, parts):
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows, want, due = _orders(parts)
    df = SP.stream_open_orders(_feed(spark, rows, ORDER, parts, "open"), "100 seconds", "30 seconds", CountingOrders)
    got = _rows(spark, df, f"open{parts}")
    results = sorted((r.order_id, r.result) for r in got if r.result != "fired")
    assert results == want
    # Each timer that fired had a result of its own: none was stale.  Paid orders fired none.
    fired = sorted(r.order_id for r in got if r.result == "fired")
    assert fired == due


def test_ordered_processors_hold_one_timer_a_key(spark):
    """A row before the waiting ones moves the key's timer: the later one is deleted, not left to fire for nothing."""
    class Handle:
        def __init__(self):
            self.timers, self.deleted = set(), 0

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, t):
            assert t not in self.timers
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)
            self.deleted += 1

    handle = Handle()
    SP.rearm(handle, 50)
    SP.rearm(handle, 30, None)
    SP.rearm(handle, 30)
    assert handle.timers == {30} and handle.deleted == 1
    SP.rearm(handle)
    assert not handle.timers


def _views(seed=1, n=150, users=40):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 7, *range(users)]), rnd.randrange(6), T0 + rnd.randrange(3 * 3600), k) for k in range(n)]
    rows.sort(key=lambda r: r[2] + rnd.randrange(600))
    return rows


def test_late_rows_update_their_window_and_later_ones_are_dropped(spark):
    hour = T0 // 3600 * 3600
    rows = [(1, 1, hour + 10, 1), (1, 1, hour + 3599, 2), (1, 1, hour + 3700, 3),  # wm after batch 1: hour + 3700 - 90
            (1, 1, hour + 20, 4), (1, 1, hour + 3690, 5), (1, 2, hour + 3700, 6),  # on the heels: in the grace
            (1, 1, hour + 9000, 7), (2, 1, hour + 8000, 8), (2, 1, hour + 8001, 9),
            (2, 1, hour + 9001, 13), (2, 1, hour + 9002, 14), (2, 1, hour + 9003, 15),  # rows are late by the batch before
            (1, 1, hour + 30, 10), (1, 1, hour + 3800, 11), (2, 1, hour + 9001, 12)]  # 10 and 11: too late
    out, ck = tempfile.mkdtemp(prefix="tm-up-"), tempfile.mkdtemp(prefix="tm-ck-")
    counts = SW.stream_window_updates(_feed(spark, rows, VIEW, 5, "late"), "ts", ["item_id"], "1 hour", None, "30 seconds", "1 minute")
    keys = ["window_start", "window_end", "item_id"]
    sinks.start_batches(counts, sinks.upsert_batches(out, keys), ck, "update").awaitTermination()

    def table(as_of=None):
        return {(epoch(r.window_start) - hour, r.item_id): (r.cnt, r.versions)
                for r in sinks.read_upserts(spark, out, keys, as_of).collect()}

    assert table(0) == {(0, 1): (2, 1), (3600, 1): (1, 1)}
    assert table() == {(0, 1): (3, 2), (3600, 1): (2, 2), (3600, 2): (1, 1), (7200, 1): (7, 3)}


def test_a_replayed_batch_changes_nothing(spark):
    out, target = tempfile.mkdtemp(prefix="tm-up-"), tempfile.mkdtemp(prefix="tm-up-")
    write = sinks.upsert_batches(out, ["k"], order="n")
    frames = [spark.createDataFrame(rows, "k string, v int, n int") for rows in
              ([("a", 1, 1), ("b", 2, 2), ("a", 9, 3), (None, 0, 4)], [("a", 5, 1), ("c", 3, 2)], [("b", None, 1)])]

    def table(path=out, as_of=None):
        return {r.k: r.v for r in sinks.read_upserts(spark, path, ["k"], as_of).collect()}

    for batch in (0, 1, 2, 1, 0):   # batches 1 and 0 come again after a failure
        write(frames[batch], batch)
        if batch == 2:
            want = table()
    assert want == {"a": 5, "b": None, "c": 3, None: 0} == table()
    assert table(as_of=0) == {"a": 9, "b": 2, None: 0}
    assert sinks.compact_upserts(spark, out, target, ["k"]) == 2
    assert table(target) == want
    assert sinks.read_upserts(spark, target, ["k"]).count() == 4


@pytest.mark.parametrize("parts", [1, 4])
def test_unique_visitors_per_view_equal_batch(spark, parts):
    rows = _views(parts)
    stream = _feed(spark, [*rows, (1, 1, rows[-1][2] + FAR, 10_000)], VIEW, parts, "uvv")
    got = _rows(spark, SP.stream_uv_per_view(stream, "1 hour", "700 seconds"), f"uvv{parts}")
    batch = distinct.uv_running(frame(spark, rows, VIEW).withColumn("behavior", F.lit("pv")))
    key = lambda r: (r.seq, r.uv, r.user_id or -1, r.window_start, r.window_end, r.ts)
    assert sorted(map(key, got)) == sorted(map(key, batch.collect()))


@pytest.mark.parametrize("key", ["item_id", "name"])
def test_ranking_in_the_plan_equals_batch(spark, key):
    rows = _views(5, 300)
    stream = _feed(spark, [*rows, (1, 1, rows[-1][2] + FAR, 10_000)], VIEW, 3, "rank")
    name = F.concat(F.lit("ü"), F.col("item_id").cast("string"))
    got = _rows(spark, SP.stream_topn(stream.withColumn("name", name), key, "1 hour", "20 minutes", 2, "700 seconds"), f"rank_{key}")
    counts = windows.sliding_count(frame(spark, rows, VIEW).withColumn("name", name), "ts", [key], "1 hour", "20 minutes")
    want = topn.topn_per_group(counts, "window_end", "cnt", key, 2).collect()
    pick = lambda r: (r.window_start, r.window_end, r[key], r.cnt, r["rank"])
    assert sorted(map(pick, got)) == sorted(map(pick, want)) and want


def test_topn_state_is_independent_of_the_number_of_keys():
    proc = SP.TopNProcessor(3, True)

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return iter([])

        def registerTimer(self, t):
            pass

    proc.init(Handle())
    rnd = random.Random(0)
    rows = [(k, rnd.randrange(50)) for k in range(20_000)]
    frames = [pd.DataFrame(rows[i:i + 5000], columns=["key", "cnt"]) for i in range(0, 20_000, 5000)]
    proc.handleInputRows((3_600_000_000,), iter(frames), None)
    import json
    assert json.loads(proc.best.get()[0]) == [[c, k] for k, c in sorted(rows, key=lambda r: (-r[1], r[0]))[:3]]


def test_side_outputs_have_their_own_sinks(spark):
    rows = [(k, "ab"[k % 2] if k % 5 else "c", T0 + k, k) for k in range(40)]
    stream = _feed(spark, rows, "user_id long, tag string, ts long, seq long", 3, "sides")
    base = tempfile.mkdtemp(prefix="tm-sides-")
    paths = {t: os.path.join(base, t) for t in "ab"}
    sinks.start_batches(stream, sinks.fan_out(paths), tempfile.mkdtemp(prefix="tm-ck-")).awaitTermination()
    for tag, path in paths.items():
        assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [k for k, t, _, _ in rows if t == tag]
    assert sorted((r.seq, r.tag) for r in sinks.read_fan_out(spark, paths).collect()) == [(k, t) for k, t, _, _ in rows if t != "c"]


@pytest.mark.parametrize("streaming", [False, True])
def test_text_lines_keep_their_order(spark, tmp_path, streaming):
    """seq rises along a file that is split into many blocks, and from an older file to a newer one."""
    lines = [f"{k},10.0.0.1,{'fail' if k % 3 else 'success'},{T0 + k}" for k in range(3000)]
    for name, part, age in (("b", lines[:1700], 100), ("a", lines[1700:], 50)):
        path = tmp_path / name
        path.write_bytes("\r\n".join(part).encode() + b"\r\n")
        os.utime(path, (T0 - age, T0 - age))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = text.read_lines(spark, str(tmp_path), streaming)
        if streaming:
            _rows(spark, df, "text_order")
            df = spark.table("text_order")
        got = df.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in got] == lines and len({r.seq for r in got}) == len(lines)


def test_parse_evaluates_each_field_once(spark):
    df = spark.createDataFrame([("10.0.0.1 7 - 17/05/2015:10:05:03 +0000 GET /a",), ("x",), (None,)], "value string")
    parsed = text.parse(df, "access_log")
    plan = text.accepted(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("split(") == 1
    rows = parsed.collect()
    assert [r._error for r in rows] == [None, "too few fields", "too few fields"]
    assert str(rows[0].ts) == "2015-05-17 10:05:03" and rows[0].url == "/a"
