import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, id long, n long, score double"


def brute(rows, min_count, limit):
    """Sorted result rows by the definition, in Python integers."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i:i + m])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, ph), a in f.items():
        if len(ph) == 1:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, ph[:k]] + f[lang, ph[k:]]), k, f[lang, ph[:k]], f[lang, ph[k:]])
                                    for k in range(1, len(ph)))
        if any(len(q) > len(ph) and g == lang and 100 * b >= 80 * a and any(q[i:i + len(ph)] == ph for i in range(len(q)))
               for (g, q), b in f.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(ph).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:limit]))


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(k, t, g, "x", 1, 2, None) for k, (t, g) in enumerate(rows)], SCHEMA)
    got = phrases.collocations(df.repartition(parts), **options).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)] + ["Ärger", "ärger", "it's", "N.Y", "a\x00b", "日本"]
    stock = ["new york city hall", "New York", "in spite of", "one and one and one", "w1 w1 w1 w1 w1"]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(rnd.randrange(0, 40)):
            text += rnd.choice(stock + rnd.choices(vocabulary, k=6)) + rnd.choice([" ", " ", "\t", "  ", ". ", "\r\n", ",", "\x0b"])
        rows.append((text, rnd.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", "de"), (" \t ", None), (" ".join(rnd.choice(vocabulary) for _ in range(5000)), "en")]
    return rows + rows[:5]


@pytest.mark.parametrize("seed,shard_words", [(1, 2_000_000), (2, 100)])
def test_phrases_equal_brute_force(spark, seed, shard_words):
    rows = corpus(seed)
    want = brute(rows, 6, 40)
    assert want and {len(x[2].split()) for x in want} == {2, 3, 4}
    assert run(spark, rows, min_count=6, limit=40, shard_words=shard_words) == want


def test_empty_table_and_tables_without_phrases(spark):
    assert run(spark, []) == []
    assert run(spark, [("a b c", "en"), (None, None)]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a = 9 * 10 ** 12 + 7
    df = spark.createDataFrame([(a, [a + 5], [a + 11])], "f long, heads array<long>, tails array<long>")
    r = df.select(phrases.lowest_cut(2).alias("c")).select(F.col("c.score")).first()
    assert r.score == 2_000_000 * a // (2 * a + 16)


def test_index_counts_and_intervals():
    """Every phrase of 2 .. 4 words, by extension in both directions, has its count, and search steps find its intervals."""
    rnd = np.random.default_rng(0)
    seq = np.concatenate([[0], *[np.append(rnd.integers(1, 5, size=rnd.integers(1, 9)), 0) for _ in range(60)]])
    forward, reverse = phrases.Index(phrases.transform(seq)), phrases.Index(phrases.transform(seq[::-1]))
    local = np.arange(1, 5)
    nodes, names = phrases.word_nodes(forward.bwt, local, local * 10), [(int(k),) for k in local]
    for d in range(2, 5):
        p, s, n = phrases.next_depth(forward, reverse, nodes)
        assert all(names[a][1:] == names[b][:-1] for a, b in zip(p, s))
        names = [names[a] + names[b][-1:] for a, b in zip(p, s)]
        text = seq.tolist()
        want = Counter(tuple(text[i:i + d]) for i in range(len(text) - d + 1) if 0 not in text[i:i + d])
        assert dict(zip(names, n.tolist())) == want
        nodes = phrases.find_nodes(forward, reverse, nodes, np.arange(len(p)) * 7, nodes.ids[p], nodes.ids[s])
        assert nodes.size.tolist() == n.tolist()
        for index, rows, key in ((seq, nodes.first, lambda x: x), (seq[::-1], nodes.back, lambda x: x[::-1])):
            at = phrases.order_by_words(index, 4)
            for name, row, m in zip(names, rows, n):
                assert all(tuple(index[i:i + d]) == key(name) for i in at[row:row + m])


def test_numbers_are_packed_by_need():
    for values in ([], [3, 65_535], [65_536, 0], [2 ** 40]):
        assert phrases.unpacked(phrases.packed(np.array(values, dtype=np.int64))).tolist() == values
    columns = [np.array(c, dtype=np.int64) for c in ([2 ** 33, 2 ** 33, 2 ** 50], [5, 2 ** 41, 0], [1, 2, 3])]
    assert [c.tolist() for c in phrases.unpack_phrases(phrases.pack_phrases(*columns))] == [c.tolist() for c in columns]


def test_large_ids_sort_by_digits():
    keys = np.random.default_rng(0).integers(0, 2 ** 40, size=500)
    assert (phrases.stable_order(keys) == np.argsort(keys, kind="stable")).all()
