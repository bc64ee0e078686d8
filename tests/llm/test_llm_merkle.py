import hashlib
import random
import zlib

import llm_cases as C
import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, path string, digest string, row int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def mark(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return h(*[mark(v) for v in (r[0], r[3], r[2], n_chars, r[1])])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(levels, i, acc):
    sib = []
    for level in levels[:-1]:
        j = i ^ 1
        other = level[j] if j < len(level) else ""
        acc = h(other, acc) if i % 2 else h(acc, other)
        sib += [other] if other else []
        i //= 2
    return acc, sib


def brute(rows):
    """Sorted result rows by the definition, one tree in memory."""
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((first(r[0]), leaf(r, r[4]), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = levels_of([x[1] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, d, r) in enumerate(groups[g]):
            tamper = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc, low = climb(trees[g], i, leaf(r, r[4] + 1) if tamper else d)
            acc, high = climb(top, k, acc)
            out.append((str(r[0]), d, trees[g][-1][0], top[-1][0], h(*low, *high), acc, acc == top[-1][0]))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", "d", 2) for r in rows], SCHEMA)
    got = merkle.audit(merkle.prove(df.repartition(3)))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def cases(seed):
    rnd = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", "", None, "日本", "zz", "und"]
    rows = [(d, t, rnd.choice(langs), rnd.choice(["web", "", None]), rnd.choice([None, 0, 7, 10 ** 12]))
            for d, t in C.awkward(seed)]
    rows += [(rnd.randrange(-40, 400), f"t{k}", "en", "hot", k) for k in range(60)]
    rows += [(5000, "alone", "only", "s", 3)] + [(77, "same", "en", "s", 5)] * 9 + [(78, "same", "rep", "s", 5)] * 8
    return rows


@pytest.mark.parametrize("height", [2, 10])
def test_manifest_equals_brute_force_at_every_segment_height(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = cases(height)
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_lone_leaf_and_empty_table(spark):
    rows = [(7, "x", "en", None, None)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert run(spark, []) == []


def test_equal_subtrees_are_stored_once(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    df = spark.createDataFrame([(1, "a", "en", "s", 1)] * 64, "doc_id long, text string, lang string, source string, n_chars long")
    _, layers, _, _, _ = merkle.manifest(df)
    assert [x.count() for x in layers] == [16, 4, 1]
    assert merkle.records(layers).count() == 3


def test_descent_serves_a_few_leaves_only(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    df = spark.createDataFrame([(k, f"t{k}", "en", "s", 1) for k in range(100)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    ranked, layers, subroots, _, _ = merkle.manifest(df)
    start = subroots.select("lang", F.col("leaves").alias("members"), "digest", F.array().cast(f"array<{merkle.STEP}>").alias("path"))
    got = merkle.descend(layers, ranked.filter("doc_id in (3, 97)"), start, "lang", ("doc_id",))
    rows = {r.doc_id: (r.leaf, len(r.path)) for r in got.collect()}
    assert rows == {k: (leaf((k, f"t{k}", "en", "s"), 1), 7) for k in (3, 97)}


def test_text_is_read_but_never_shuffled(spark):
    df = C.frame(spark, [(1, "a")]).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    plan = merkle.prove(df)._jdf.queryExecution().toString()
    assert "text#" not in plan
