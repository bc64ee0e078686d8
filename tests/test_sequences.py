import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import frame
from tidemark.operators import sequences as S


@pytest.fixture(scope="module")
def readme_seq(spark):
    # The documented pattern example: a c b1 b2 (one key, one second apart).
    rows = [(1, "a", "a", 100, 1), (1, "c", "c", 101, 2), (1, "b", "b1", 102, 3), (1, "b", "b2", 103, 4)]
    return frame(spark, rows, "k long, t string, name string, ts long, seq long")


def pairs(df):
    return sorted((r.first_seq, r.second_seq) for r in df.collect())


def t(x):
    return F.col("t") == x


def test_next_readme(readme_seq):
    assert pairs(S.seq_next(readme_seq, "k", t("a"), t("b"))) == []


def test_followed_by_readme(readme_seq):
    assert pairs(S.seq_followed_by(readme_seq, "k", t("a"), t("b"))) == [(1, 3)]


def test_followed_by_any_readme(readme_seq):
    assert pairs(S.seq_followed_by_any(readme_seq, "k", t("a"), t("b"), "1 hour")) == [(1, 3), (1, 4)]


def test_followed_by_any_needs_bound(readme_seq):
    with pytest.raises(ValueError):
        S.seq_followed_by_any(readme_seq, "k", t("a"), t("b"), None)


def test_within_is_strict(readme_seq):
    assert pairs(S.seq_followed_by(readme_seq, "k", t("a"), t("b"), "2 seconds")) == []
    assert pairs(S.seq_followed_by(readme_seq, "k", t("a"), t("b"), "3 seconds")) == [(1, 3)]
    assert pairs(S.seq_followed_by_any(readme_seq, "k", t("a"), t("b"), "3 seconds")) == [(1, 3)]


def test_not_next_and_not_followed_by(readme_seq):
    assert pairs(S.seq_not_next(readme_seq, "k", t("a"), t("b"))) == [(1, 2)]
    assert pairs(S.seq_not_next(readme_seq, "k", t("a"), t("c"))) == []
    assert pairs(S.seq_not_followed_by(readme_seq, "k", t("a"), t("c"), t("b"))) == []
    assert pairs(S.seq_not_followed_by(readme_seq, "k", t("c"), t("a"), t("b"))) == [(2, 3)]


def test_and_or_conditions(readme_seq):
    cond = t("b") & (F.col("name") == "b2")
    assert pairs(S.seq_followed_by(readme_seq, "k", t("a"), cond)) == [(1, 4)]
    assert pairs(S.seq_followed_by(readme_seq, "k", t("a"), t("c") | t("b"))) == [(1, 2)]


def test_times_until_iterative(spark):
    rows = [(1, "x", 1.0, 100 + i, i) for i in range(3)] + [(1, "y", 0.0, 110, 10)] + \
           [(1, "x", v, 120 + i, 20 + i) for i, v in enumerate([5.0, 3.0, 7.0, 4.0])]
    df = frame(spark, rows, "k long, t string, v double, ts long, seq long")
    runs = sorted((r.length, r.start_ts) for r in S.seq_times(df, "k", t("x"), 3).collect())
    assert [n for n, _ in runs] == [3, 4]
    segs = sorted((r.segment, r.n) for r in S.seq_until(df, "k", t("x"), t("y")).collect())
    assert segs == [(0, 3), (1, 4)]
    kept = sorted(r.seq for r in S.seq_iterative(df, "k", t("x"), "v").collect())
    # run 1: 1,1,1 -> first kept, equal values are not above the mean;
    # run 2: 5 kept, 3 < 5, 7 > 4, 4 < 5.
    assert kept == [0, 20, 22]


def test_composite_keys(spark):
    rows = [(1, 1, "a", 100, 1), (1, 2, "b", 101, 2), (1, 1, "b", 102, 3)]
    df = frame(spark, rows, "k1 long, k2 long, t string, ts long, seq long")
    assert pairs(S.seq_followed_by(df, ["k1", "k2"], t("a"), t("b"))) == [(1, 3)]
    assert pairs(S.seq_followed_by_any(df, ["k1", "k2"], t("a"), t("b"), "1 hour")) == [(1, 3)]


# -- chains ---------------------------------------------------------------------------

def brute_chain(rows, steps, within):
    """Best match of each first event by recursion; steps: (kind, link, least, most)."""
    out = []
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        by_key.setdefault(r[0], []).append(r)

    def rests(evs, i, at, n):
        """Matches from step i on, whose n-th event is at ``at``, longest loops first."""
        kind, link, least, most = steps[i]
        if at >= len(evs) or evs[at][1] != kind:
            return
        if n < most:
            for x in rests(evs, i, at + 1, n + 1):
                yield [(i, at), *x]
        if n >= least:
            if i + 1 == len(steps):
                yield [(i, at)]
            elif steps[i + 1][1] == "next":
                yield from ([(i, at), *x] for x in rests(evs, i + 1, at + 1, 1))
            else:
                later = [j for j in range(at + 1, len(evs)) if evs[j][1] == steps[i + 1][0]]
                if later:
                    yield from ([(i, at), *x] for x in rests(evs, i + 1, later[0], 1))

    for evs in by_key.values():
        for a in range(len(evs)):
            for m in rests(evs, 0, a, 1):
                if evs[m[-1][1]][2] - evs[a][2] < within:
                    out.append(tuple(tuple(evs[j][3] for i, j in m if i == s) for s in range(len(steps))))
                    break
    return sorted(out)


PATTERNS = [
    [("a", "", 1, 1)],
    [("a", "", 1, 1), ("b", "followed_by", 1, 1), ("c", "followed_by", 1, 1)],
    [("a", "", 1, 1), ("b", "next", 1, 1), ("a", "followed_by", 1, 1), ("c", "next", 1, 1)],
    [("a", "", 2, 4), ("b", "followed_by", 1, 1)],
    [("a", "", 1, 3), ("b", "next", 1, 3), ("c", "followed_by", 2, 2)],
]


@pytest.mark.parametrize("number", range(len(PATTERNS)))
@pytest.mark.parametrize("bucket", ["1 second", "1 hour"])
def test_chains_equal_brute_force(spark, number, bucket):
    import random
    rnd = random.Random(number)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.choice("aabbcx"), rnd.randrange(100, 260), k) for k in range(250)]
    steps = PATTERNS[number]
    names = [f"s{i}" for i in range(len(steps))]
    chain = [S.Step(n, t(kind), link or "followed_by", (lo, hi)) for n, (kind, link, lo, hi) in zip(names, steps)]
    got = S.seq_chain(frame(spark, rows, "k long, t string, ts long, seq long"), "k", chain, "20 seconds", bucket).collect()
    want = brute_chain(rows, steps, 20)
    assert sorted(tuple(r[f"{n}_seq"] for n in names) for r in got) == sorted(tuple(x[0] for x in m) for m in want) and want
    for i, (n, st) in enumerate(zip(names, steps)):
        if st[3] > 1:
            assert sorted((r[f"{names[0]}_seq"], r[f"{n}_n"]) for r in got) == sorted((m[0][0], len(m[i])) for m in want)


def test_chain_of_relaxed_repeats_and_bad_steps(spark, readme_seq):
    got = S.seq_chain(readme_seq, "k", [S.Step("a", t("a")), S.Step("b", t("b"), times=2, relaxed=True)], "1 hour").collect()
    assert [(r.a_seq, r.b_seq, r.b_n) for r in got] == [(1, 3, 2)]
    for bad in ([], [S.Step("a", t("a"), times=0)], [S.Step("a", t("a"), "near")], [S.Step("a", t("a"), times=(1, 2), relaxed=True)]):
        with pytest.raises(ValueError):
            S.seq_chain(readme_seq, "k", bad, "1 hour")


def test_a_chain_is_one_shuffle(spark):
    rows = [(1, "a", 100, 1), (1, "b", 101, 2)]
    df = frame(spark, rows, "k long, t string, ts long, seq long")
    chain = [S.Step("x", t("a"), times=(1, 3)), S.Step("y", t("b")), S.Step("z", t("c"))]
    plan = S.seq_chain(df, "k", chain, "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
