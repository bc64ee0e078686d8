"""The bucketed scans must equal a plain per-key sequential scan for any bucket width."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import epoch, frame
from tidemark.operators import login
from tidemark.operators.timeline import Timeline


def _rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # Few distinct timestamps -> many ties broken by seq; key 0 is hot.
        key = 0 if rnd.random() < 0.5 else rnd.randrange(1, 4)
        out.append((key, rnd.choice("abc"), 1_000 + rnd.randrange(200), i))
    return out


def _brute(rows):
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        by_key.setdefault(r[0], []).append(r)
    prev, next_b, run_a, prior_c_incl = {}, {}, {}, {}
    for key, evs in by_key.items():
        total = 0
        last_c = None
        for i, (k, t, ts, seq) in enumerate(evs):
            prev[seq] = evs[i - 1][3] if i else None
            nb = next((e[3] for e in evs[i + 1:] if e[1] == "b"), None)
            next_b[seq] = nb
            total += 1 if t == "a" else 0
            run_a[seq] = total
            if t == "c":
                last_c = seq
            prior_c_incl[seq] = last_c
    return prev, next_b, run_a, prior_c_incl


@pytest.mark.parametrize("bucket", ["1 second", "7 seconds", "1 hour"])
def test_scans_equal_sequential(spark, bucket):
    rows = _rows(hash(bucket) % 1000)
    df = frame(spark, rows, "k long, t string, ts long, seq long")
    tl = Timeline(df, "k", bucket=bucket)
    tl.prior("p")
    tl.following("nb", pred=F.col("t") == "b")
    tl.running_sum("ra", (F.col("t") == "a").cast("long"))
    tl.prior("pc", pred=F.col("t") == "c", inclusive=True)
    got = {r.seq: r for r in tl.result().collect()}
    prev, next_b, run_a, prior_c = _brute(rows)
    for seq, r in got.items():
        assert (r.p.seq if r.p else None) == prev[seq]
        assert (r.nb.seq if r.nb else None) == next_b[seq]
        assert r.ra == run_a[seq]
        assert (r.pc.seq if r.pc else None) == prior_c[seq]


def _hot_rows(null_key=False):
    rnd = random.Random(21)
    key = None if null_key else 1
    return [(key if k % 3 else 2, rnd.choice(["fail", "fail", "success"]), 1_700_000_000 + rnd.randrange(20_000), k)
            for k in range(300)]


LOGIN = "user_id long, event_type string, ts long, seq long"


@pytest.mark.parametrize("null_key", [False, True])
@pytest.mark.parametrize("bucket", ["1 second", "7 seconds", "1 day"])
def test_bounded_scans_do_not_depend_on_the_bucket(spark, bucket, null_key):
    rows = _hot_rows(null_key)
    want = []
    for user in {r[0] for r in rows}:
        events = sorted((r[2], r[3], r[1]) for r in rows if r[0] == user)
        want += [(str(user), a[0], b[0]) for a, b in zip(events, events[1:])
                 if a[2] == b[2] == "fail" and b[0] - a[0] < 60]
    df = frame(spark, rows, LOGIN)
    got = [(str(r.user_id), epoch(r.first_fail_ts), epoch(r.last_fail_ts))
           for r in login.login_fail_pattern(df, "60 seconds", bucket).collect()]
    assert sorted(got) == sorted(want) and want
    # Unbounded scans carry their neighbours over bucket edges, for a null key too.
    runs = sorted(map(str, login.login_fail_burst(df, "60 seconds", 2, bucket).collect()))
    assert runs == sorted(map(str, login.login_fail_burst(df, "60 seconds", 2, "365 days").collect()))


def test_bounded_scan_is_one_scan_and_one_shuffle(spark, tmp_path):
    frame(spark, _hot_rows(), LOGIN).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.read.parquet(str(tmp_path / "t"))
        plan = login.login_fail_pattern(df, "60 seconds")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
