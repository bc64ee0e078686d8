"""Randomised properties (hypothesis): sliding windows vs brute force for random
window shapes, and the bucketed scans vs a sequential scan for random buckets."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import epoch, frame
from tidemark.operators.timeline import Timeline
from tidemark.operators.windows import Agg, window_aggregate

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows_st = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5_000), st.integers(-3, 9)),
                   min_size=1, max_size=60)


@settings(**SETTINGS)
@given(rows=rows_st, slide=st.integers(1, 400), mult=st.integers(1, 9), extra=st.integers(0, 250))
def test_windows_match_brute_force(spark, rows, slide, mult, extra):
    size = slide * mult + extra          # includes sizes that are not a multiple of the slide
    data = [(k, t, v, i) for i, (k, t, v) in enumerate(rows)]
    df = frame(spark, data, "k long, ts long, v long, seq long")
    got = {(epoch(r.window_end), r.k): (r.cnt, r.s, r.lo)
           for r in window_aggregate(df, "ts", ["k"], f"{size} seconds", f"{slide} seconds",
                                     {"cnt": Agg("count"), "s": Agg("sum", "v"), "lo": Agg("min", "v")})
           .collect()}
    want = {}
    for k, t, v, _ in data:
        e = (t // slide + 1) * slide
        while e - size <= t:
            c, s, lo = want.get((e, k), (0, 0, None))
            want[(e, k)] = (c + 1, s + v, v if lo is None else min(lo, v))
            e += slide
    assert got == want
    # The sweep path (count and integral sum only) agrees as well.
    sweep = {(epoch(r.window_end), r.k): (r.cnt, r.s)
             for r in window_aggregate(df, "ts", ["k"], f"{size} seconds", f"{slide} seconds",
                                       {"cnt": Agg("count"), "s": Agg("sum", "v")}).collect()}
    assert sweep == {key: val[:2] for key, val in want.items()}


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.integers(0, 300)),
                     min_size=1, max_size=80),
       bucket=st.integers(1, 400))
def test_timeline_matches_sequential(spark, rows, bucket):
    data = [(k, t, ts, i) for i, (k, t, ts) in enumerate(rows)]
    df = frame(spark, data, "k long, t string, ts long, seq long")
    tl = Timeline(df, "k", bucket=f"{bucket} seconds")
    tl.prior("p")
    tl.following("nb", pred=F.col("t") == "b")
    tl.running_sum("ra", (F.col("t") == "a").cast("long"))
    got = {r.seq: (r.p.seq if r.p else None, r.nb.seq if r.nb else None, r.ra)
           for r in tl.result().collect()}
    want = {}
    by_key = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[3])):
        by_key.setdefault(r[0], []).append(r)
    for evs in by_key.values():
        run = 0
        for i, (_, t, _, seq) in enumerate(evs):
            run += t == "a"
            nb = next((e[3] for e in evs[i + 1:] if e[1] == "b"), None)
            want[seq] = (evs[i - 1][3] if i else None, nb, run)
    assert got == want
