import random
import re

import llm_cases as C
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, substrings
from tidemark.llm.components import connected_components


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def close(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4


def near_rows():
    rnd = random.Random(9)
    rows = C.awkward(1)
    long = [C.words(rnd, 300) for _ in range(4)]
    for k in range(40):  # near copies: a few words changed
        w = long[k % 4].split()
        for _ in range(rnd.randrange(0, 3)):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((300 + k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints, close)
    first = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            first[r] = min(first.get(r, d), d)
    want = sorted((str(d), p if p < 2 ** 63 else p - 2 ** 64, first.get(r)) for (d, _), p, r in zip(rows, prints, root))
    got = simhash.near_duplicates(C.clashing(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    assert len(set(root)) < len(set(prints)) < len(rows)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_dense_and_sparse_fingerprints(spark, block):
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(3):  # dense groups: up to 3 bits around a centre, and chains of 4 bits
        centre = rnd.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(80)}
    chain = rnd.getrandbits(64)
    for _ in range(12):
        prints.add(chain)
        for b in rnd.sample(range(64), 4):
            chain ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = simhash.near_links(df, block)
    pairs = links.collect()
    assert all(close(r.a, r.b) for r in pairs)
    root = {r.node: r.root for r in connected_components(links).collect()}
    want = brute_components(prints, close)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = [root.get(s, s) for s in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    if block == 4096:  # a spanning forest per key, never all pairs
        assert len(pairs) < 60 * len(prints)


def test_spark_hash_is_the_contract_hash(spark):
    for s in ("", "a b c d", "é 日本 🙂 x" * 9):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2 ** 64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_deduplicate_keeps_one_row_of_each_component(spark):
    rows = near_rows()
    found = {r.root: r.component_id for r in simhash.near_duplicates(C.frame(spark, rows)).collect()}
    docs = C.clashing(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = sorted(x for x in ids if x is not None)
    assert named == sorted(c for c in found.values() if c is not None)
    assert simhash.deduplicate(C.frame(spark, [])).count() == 0


def test_deduplicate_keeps_a_component_whose_id_is_used_elsewhere(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    kept = simhash.deduplicate(C.frame(spark, [(4, a), (4, b), (7, b), (None, "p q r s t"), (None, "p q r s t")])).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(x) for x in [(4, a), (4, b), (None, "p q r s t")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(50)] + [(5, 5)]
    root = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({root[k] for k in range(61)}) == 1 and len({root[2000 + k] for k in range(50)} | {root[1000]}) == 1
    assert root[0] != root[1000]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ substring dedup

def brute_kept(rows, window):
    """n_words, n_removed and kept text of each row; equal (id, start) is not earlier."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [2 ** 63 if d is None else d for d, _ in rows]
    first = {}
    for r, w in zip(rank, split):
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (r, i)), (r, i))
    out = []
    for r, w in zip(rank, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (r, i):
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window,vocabulary,buckets", [(20, 3, 5), (8, 2, 1), (20, 400, None)])
def test_remove_repeats_equals_brute_force(spark, window, vocabulary, buckets):
    rnd = random.Random(window + vocabulary)
    passages = [C.words(rnd, 60, 500) for _ in range(3)]
    rows = C.awkward(2)
    for k in range(40):
        text = C.words(rnd, rnd.randrange(40), vocabulary)
        if k % 2:
            text += "  \n" + passages[k % 3] + "\t" + C.words(rnd, 10, vocabulary)
        rows.append((400 + rnd.randrange(60), text))
    rows.append((900, "same " * 90))
    got = substrings.remove_repeats(C.clashing(spark, rows).repartition(3), window, buckets).collect()
    want = [(str(d), *x) for (d, _), x in zip(rows, brute_kept(rows, window))]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert sum(x[2] for x in want)


@pytest.mark.parametrize("hot_words", [0, 3000])
def test_windows_of_a_common_line_are_spread(spark, hot_words):
    rnd = random.Random(5)
    line = "licensed to you under the usual terms of this site"
    rows = [(k, f"{C.words(rnd, 30, 4000)} {line} {C.words(rnd, 30, 4000)}") for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(0, 300, 7)] + C.awkward(4)
    docs = C.frame(spark, rows).repartition(5)
    sizes = {}
    for r in substrings.super_kmers(docs, 16, hot_words=hot_words).filter("bucket >= 0").collect():
        sizes[r.bucket] = sizes.get(r.bucket, 0) + len(substrings._unpack(r.packed)[1])
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 16
    got = substrings.remove_repeats(docs, buckets=16, hot_words=hot_words).collect()
    want = [(str(d), *x) for (d, _), x in zip(rows, brute_kept(rows, 20))]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)


def test_texts_that_share_an_id_and_a_passage_each_lose_it(spark):
    passage = C.words(random.Random(6), 25, 4000)
    rows = [(1, passage), (5, passage + " a b"), (5, passage + " c d"), (None, passage + " e"), (None, passage + " f")]
    docs = C.frame(spark, rows[:1]).coalesce(1).union(C.frame(spark, rows[1:]).coalesce(1))
    got = substrings.remove_repeats(docs).collect()
    assert sorted(r.kept for r in got) == sorted([passage, "a b", "c d", "e", "f"])


def test_remove_repeats_of_nothing(spark):
    assert substrings.remove_repeats(C.frame(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [1, 12])
def test_hot_slots_are_told_by_their_share_at_any_size(spark, copies):
    """The same texts again and again make no slot hot: the line moves with the mean bucket."""
    rnd = random.Random(4)
    texts = [" ".join(str(rnd.random()) for _ in range(60)) for _ in range(40)]
    line = "this very line is in each and every one of the documents of the corpus"
    docs = C.frame(spark, [(k, f"{rnd.random()} {rnd.random()} {line} {rnd.random()} {t}") for k, t in enumerate(texts * copies)])
    counted = {r.slot: r.n for r in substrings.slot_words(docs, 8).collect()}
    hot = substrings.hot_slots(docs, 8)
    mean = sum(counted.values()) / 8
    assert set(hot.tolist()) == {s for s, n in counted.items() if n > int(mean * substrings.HOT_SHARE)}
    assert len(hot) < 8 / substrings.HOT_SHARE
    plain = substrings.hot_slots(C.frame(spark, list(enumerate(texts * copies))), 8)
    assert len(plain) == 0


def test_buckets_follow_the_size_of_the_texts(spark, monkeypatch):
    docs = C.frame(spark, [(k, "w " * 500) for k in range(200)] + [(None, None)])
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert substrings.bucket_count(docs) == least
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1000)
    assert substrings.bucket_count(docs) == 200
    assert substrings.bucket_count(C.frame(spark, [])) == least
