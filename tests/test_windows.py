import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import epoch, frame, ntz
from tidemark.functions.time import duration_us
from tidemark.operators.topn import topn_per_group
from tidemark.operators.traffic import hot_items_topn
from tidemark.operators.windows import Agg, sliding_count, tumbling_count, window_aggregate, window_average


def brute_sliding(rows, size, slide):
    """{(window_end_sec, key): count} by checking every aligned window."""
    out = Counter()
    for key, t in rows:
        e = (t // slide + 1) * slide
        while e - size <= t:
            out[(e, key)] += 1
            e += slide
    return out


def test_hot_items_rank(spark):
    rnd = random.Random(11)
    views = [(rnd.randrange(30), 1_700_000_000 + rnd.randrange(9000)) for _ in range(300)]
    df = frame(spark, [(n, i, 0, "pv", t, n) for n, (i, t) in enumerate(views)],
               "user_id long, item_id long, category_id int, behavior string, ts long, seq long")
    got = {}
    for r in hot_items_topn(df, "60 minutes", "5 minutes", 3).collect():
        got.setdefault(epoch(r.window_end), []).append((r.rank, r.item_id, r.cnt))
    want = {}
    for (end, item), n in brute_sliding(views, 3600, 300).items():
        want.setdefault(end, []).append((-n, item))
    # Ties go to the smaller item.
    assert {e: sorted(v) for e, v in got.items()} \
        == {e: [(k + 1, i, -n) for k, (n, i) in enumerate(sorted(v)[:3])] for e, v in want.items()}


@pytest.mark.parametrize("size,slide", [(3600, 300), (600, 5), (3600, 10), (100, 30), (60, 60)])
def test_sliding_matches_brute_force(spark, size, slide):
    rnd = random.Random(size * 7 + slide)
    rows = [(rnd.randrange(4), 1_700_000_000 + rnd.randrange(20_000)) for _ in range(400)]
    df = frame(spark, rows, "k long, ts long")
    got = {(epoch(r.window_end), r.k): r.cnt
           for r in sliding_count(df, "ts", ["k"], f"{size} seconds", f"{slide} seconds").collect()}
    assert got == dict(brute_sliding(rows, size, slide))


def test_window_bounds_and_types(spark):
    df = frame(spark, [(1, 7200), (1, 7199)], "k long, ts long")
    rows = sorted(tumbling_count(df, "ts", [], "1 hour").collect())
    assert [(r.window_start, r.window_end, r.cnt) for r in rows] == [
        (ntz(3600), ntz(7200), 1), (ntz(7200), ntz(10800), 1)]
    assert dict(tumbling_count(df, "ts", [], "1 hour").dtypes)["window_end"] == "timestamp_ntz"


def test_window_average_integer_division(spark):
    df = frame(spark, [(1, 10, 100), (1, 11, 110), (1, 12, 120)], "k long, v long, ts long")
    df = df.withColumn("v", F.col("v"))
    r = window_average(df, "ts", "v", ["k"], "1 hour", exact=False).collect()[0]
    assert r.avg_value == 11.0
    df2 = frame(spark, [(1, 10, 100), (1, 11, 110)], "k long, v long, ts long")
    assert window_average(df2, "ts", "v", ["k"], "1 hour", exact=False).collect()[0].avg_value == 10.0
    assert window_average(df2, "ts", "v", ["k"], "1 hour", exact=True).collect()[0].avg_value == 10.5


def test_topn_uses_partial_group_limit(spark):
    df = frame(spark, [(i % 7, 1000 + i) for i in range(50)], "k long, ts long")
    counts = sliding_count(df, "ts", ["k"], "60 seconds", "10 seconds")
    plan = topn_per_group(counts, "window_end", "cnt", "k", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_duration_parsing():
    assert duration_us("60 minutes") == 3_600_000_000
    assert duration_us("5 s") == 5_000_000
    assert duration_us(2) == 2_000_000
    assert duration_us("1 day") == 86_400_000_000


def test_results_do_not_depend_on_session_time_zone(spark):
    df = frame(spark, [(1, 7199), (1, 7200)], "k long, ts long")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        rows = sorted(tumbling_count(df, "ts", [], "1 day").collect())
        assert [(r.window_start, r.window_end) for r in rows] == [(ntz(0), ntz(86400))]
        assert sorted(epoch(r.ts) for r in df.collect()) == [7199, 7200]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sums_and_averages_of_nulls(spark):
    df = frame(spark, [(1, None, 100), (1, None, 130), (2, 4, 100), (2, None, 130), (2, 6, 130)], "k long, v long, ts long")
    rows = window_aggregate(df, "ts", ["k"], "60 seconds", "30 seconds", {"s": Agg("sum", "v"), "n": Agg("count")}).collect()
    got = {(r.k, epoch(r.window_end)): (r.s, r.n) for r in rows}
    assert got == {(1, 120): (None, 1), (1, 150): (None, 2), (1, 180): (None, 1),
                   (2, 120): (4, 1), (2, 150): (10, 3), (2, 180): (6, 2)}
    avg = {(r.k, epoch(r.window_end)): r.avg_value
           for r in window_average(df, "ts", "v", ["k"], "60 seconds", "30 seconds", exact=True).collect()}
    assert avg[(2, 150)] == 5.0 and avg[(2, 180)] == 6.0 and avg[(1, 150)] is None
