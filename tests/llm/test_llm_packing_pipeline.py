import random
import re
import zlib

import llm_cases as C
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import decontam, packing, pii, simhash

SF = "/root/testdata/sf0.001"


def tokens(text, tok=[]):
    if not tok:
        tok.append(Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    return [*tok[0].encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(rows, pieces, capacity=2048):
    """Every id of every row lies in one piece, and sequences are gapless and bounded."""
    want = sorted((str(d), zlib.crc32(np.array(tokens(t), "<u4").tobytes()), len(tokens(t))) for d, t in rows)
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in pieces) == sum(w[2] for w in want)
    whole = sorted((d, r.ids_crc32, n) for (d, n), v in by_doc.items() for r in v if r.length == n)
    assert whole == [w for w in want if w[2] <= capacity]
    return len(by_seq)


def test_tokens_equal_the_tokenizer(spark):
    enc = packing.Encoder()
    rnd = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "b'", "'s", "é", "1", "23", "!?", "日本", "🙂", "​",
              "<|endoftext|>", "the", " foo", "_", "́", "½", "٣"]
    for _ in range(3000):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(15)))
        assert [*enc.encode(s), 1] == tokens(s), repr(s)


def test_long_white_space_equals_the_tokenizer():
    enc, exact = packing.Encoder(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in (" " * 1_500_000 + "x", "a b" + "\n" * 1_500_000, "x" + " " * 99_999 + "y", "x" + " \t" * 60_000 + "y"):
        assert enc.encode(text) == exact.encode(text, add_special_tokens=False).ids
    assert not packing.LONG_SPACE.search(("x" + " " * 99_999) * 20)


def test_first_fit_decreasing_equals_a_plain_one():
    rnd = random.Random(2)
    for n in (0, 1, 2, 7, 300):
        lengths = [rnd.randrange(1, 101) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], [None] * n
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            b = next((i for i, r in enumerate(room) if r >= lengths[k]), None)
            if b is None:
                b = len(room)
                room.append(100)
            want[k] = (b, 100 - room[b])
            room[b] -= lengths[k]
        assert list(zip(bins, offsets)) == want


def test_packing_round_trip(spark):
    rows = C.awkward(3)
    docs = C.clashing(spark, rows)
    got = packing.pack_documents(docs).collect()
    assert len(got) > len(rows)
    used = check_packed(rows, got)
    assert used <= -(-sum(len(tokens(t)) for _, t in rows) // 2048) + 1
    seqs = packing.sequences(docs, pad_id=0).collect()
    assert len(seqs) == used and all(len(s.input_ids) == 2048 for s in seqs)
    ids = sorted(x for s in seqs for x in s.input_ids[:s.length])
    assert ids == sorted(x for _, t in rows for x in tokens(t))
    assert packing.pack_documents(C.frame(spark, [])).count() == 0


def test_groups_are_packed_apart(spark):
    df = spark.createDataFrame([(k, k, 1 + k * 37 % 90) for k in range(400)], "piece long, doc_id long, length long")
    got = packing.pack(df, capacity=100, group_size=50).collect()
    assert len({r.sequence_id >> 25 for r in got}) == 8
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(r.length for r in got)


# ------------------------------------------------------------------ pipeline

@pytest.fixture(scope="module")
def stages(spark):
    """What every stage of the pipeline kept, on the smallest tables."""
    import corpus_pipeline as pipe
    from tidemark.llm.common import save
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, fn in pipe.STAGES:
        docs = out[name] = save(fn(spark, docs, SF), name)
    return out


def test_stages_keep_columns_and_take_effect(spark, stages):
    import corpus_pipeline as pipe
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n in list(stages)[1:-1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in stages["toxicity"].collect()}
    ids = {r.doc_id for r in stages["documents"].collect()}
    gone = ids - left
    assert not any(labels.get(d) == 0 for d in gone)


def test_near_dedup_stage_equals_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    prints = [simhash.fingerprint(t.encode()) & (2 ** 64 - 1) for _, t in rows]
    group = {}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    for k, (d, _) in enumerate(rows):
        group[find(k)] = min(group.get(find(k), d), d)
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted(group.values())


def test_later_stages(spark, stages):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    after = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    assert after == {d: t for d, t in before.items() if not any(b in t for b in bench)}
    clean = {r.doc_id: (r.text, r.n_chars) for r in stages["pii"].collect()}
    assert set(clean) == set(after)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for d, (t, n) in clean.items():
        assert n == len(t) and not email.search(t)
        assert len(email.findall(after[d])) == t.count("<EMAIL>")
    check_packed([(d, t) for d, (t, _) in clean.items()], stages["packing"].collect())


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipe
    for name, rows in (("awkward", C.awkward(6)), ("empty", [])):
        d = str(tmp_path / name)
        docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = pipe.run(spark, d)
        kept = simhash.deduplicate(docs)
        assert decontam.remove_contaminated(kept, spark.read.parquet(f"{d}/benchmark.parquet")).count() == kept.count()
        text = [(r.doc_id, r.text) for r in pii.redact(kept).collect()]
        check_packed(text, out.collect())


def test_registered_queries_of_the_subpackage(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and "op2_top_k_search" in entry.oracle_sql()
