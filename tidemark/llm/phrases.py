"""Phrase mining with an FM-index per shard over word ids.

A *shard* is what one map task reads of one language, about ``SHARD_WORDS`` words at a time; texts never
move.  Its words get shard-local ids (0 ends a piece), and a bidirectional FM-index is built: the
Burrows-Wheeler transforms of the sequence and of its reverse, ordered by ``DEPTH`` words, which
is all that phrases of that length need.  The indices are a bucketed table, so no later join moves them.

N-grams are enumerated by depth.  A node is a phrase with its interval in either index and its size, the
count.  All right extensions of a node are the symbols in its interval of the reverse transform, all left
extensions those in its interval of the forward one; either step moves both intervals.  A phrase of d + 1
words is counted where a right extension of a frequent d-gram and a left extension of a frequent d-gram
meet at one interval, so every phrase comes with its two parents, and its count is the interval's size.

Counts are summed across shards, and only phrases whose sum is frequent go back to their shards for the next
depth: a phrase with ``min_count`` occurrences has parents with as many, so nothing is lost.
A phrase travels as its parents' numbers, never as text, and packed: a shard sends one array of
phrases to each of many *ranges* (by hash of the parents, about ``RANGE_WORDS`` words of the corpus for each), which
adds them up and returns the numbers of the frequent ones.  A shard finds their intervals again by one search
step from the parents.  Counts of the first and last words of a phrase come along with its parents, and so do
the counts of the extensions that decide whether a longer phrase stands for it.

Edge cases: a null language is ``und``, a null text is empty; words are compared as bytes; texts of any length
belong to one shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, save, scratch_path, small_batches

DEPTH = 4
MIN_COUNT = 30
LIMIT = 2000
#: A phrase goes if a longer one has this share (percent) of its count.
COVERED = 80
SCALE = 2_000_000
SHARD_WORDS = 2_000_000
RANGE_WORDS = 2_000_000
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")


# ---------------------------------------------------------------- FM-index

def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers by 16-bit digits."""
    out = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    rest = keys >> 16
    while rest.any():
        out = out[np.argsort((rest[out] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return out


def order_by_words(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` sorted by the ``depth`` symbols from there on; behind the end stand zeros."""
    at = np.arange(len(seq))
    ahead = np.concatenate([seq, np.zeros(depth, dtype=seq.dtype)])
    for k in range(depth - 1, -1, -1):
        at = at[stable_order(ahead[at + k])]
    return at


def transform(seq: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Symbol before each place, in the places' order."""
    return seq[order_by_words(seq, depth) - 1]  # the last symbol, an end of piece, stands before the first


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as all of them need; the first byte is the width."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


class Index:
    """One direction of an FM-index."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.order = stable_order(bwt)                        # row of each symbol as a first symbol -> its row
        self.keys = bwt[self.order] * len(bwt) + self.order   # ascending

    def step(self, sym: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First-symbol row of the first ``sym`` at or below ``row`` (the search step of an FM-index)."""
        return np.searchsorted(self.keys, sym * len(self.bwt) + row)

    def extend(self, here: np.ndarray, there: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of nodes by one word: (node, count, row here, row there).

        ``here`` is a node's first row in this index, ``there`` that in the other one; the intervals do not
        overlap.  Ends of pieces extend nothing, but are smaller than any word."""
        node_at = np.full(len(self.bwt), -1, dtype=np.int64)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        node_at[np.repeat(here, size) + inside] = np.repeat(np.arange(len(size)), size)
        # By symbol and row, equal symbols of one interval stand together.
        node = node_at[self.order]
        at = np.flatnonzero(node >= 0)
        node, sym = node[at], self.bwt[self.order[at]]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (sym[1:] != sym[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        node, sym, jump = node[start], sym[start], at[start]
        by = stable_order(node)
        before = np.cumsum(n[by]) - n[by]
        first_of = np.searchsorted(node[by], np.arange(len(size)))
        smaller = np.empty(len(n), dtype=np.int64)
        smaller[by] = before - before[np.minimum(first_of, len(by) - 1)][node[by]] if len(by) else before
        word = sym > 0
        return node[word], n[word], jump[word], (there[node] + smaller)[word]


class Nodes:
    """Phrases of one length in a shard: numbers, rows in either index, counts, first and last word (local ids)."""

    def __init__(self, ids, first, back, size, head, tail):
        self.ids, self.first, self.back, self.size, self.head, self.tail = ids, first, back, size, head, tail


def word_nodes(seq_or_bwt: np.ndarray, local: np.ndarray, ids: np.ndarray) -> Nodes:
    """Nodes of words, given their local ids and numbers; the interval is the same in both indices."""
    counts = np.bincount(seq_or_bwt)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return Nodes(ids, first[local], first[local], counts[local], local, local)


def find_nodes(forward: Index, reverse: Index, up: Nodes, ids: np.ndarray, p: np.ndarray, s: np.ndarray) -> Nodes:
    """Nodes of the phrases with parents numbered ``p`` and ``s`` among ``up``, by one search step each way."""
    by = np.argsort(up.ids, kind="stable")
    p, s = by[np.searchsorted(up.ids, p, sorter=by)], by[np.searchsorted(up.ids, s, sorter=by)]
    back = reverse.step(up.tail[s], up.back[p])
    size = reverse.step(up.tail[s], up.back[p] + up.size[p]) - back
    return Nodes(ids, forward.step(up.head[p], up.first[s]), back, size, up.head[p], up.tail[s])


def next_depth(forward: Index, reverse: Index, nodes: Nodes) -> tuple[np.ndarray, ...]:
    """(prefix node, suffix node, count) of the phrases, longer by a word, whose prefix and suffix are nodes."""
    prefix, n, _, right = reverse.extend(nodes.back, nodes.first, nodes.size)
    suffix, _, left, _ = forward.extend(nodes.first, nodes.back, nodes.size)
    _, i, j = np.intersect1d(right, left, assume_unique=True, return_indices=True)
    return prefix[i], suffix[j], n[i]


# ---------------------------------------------------------------- shards

class Shard:
    """Words of one language while a task reads them."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(count(1).__next__)
        self.seq = array("I", [0])

    def add(self, text: bytes) -> None:
        for piece in PIECE_END.split(text.lower()):
            words = piece.split()
            if words:
                self.seq.extend(map(self.ids.__getitem__, words))
                self.seq.append(0)


INDEX_SCHEMA = "shard long, lang string, forward binary, reverse binary, words array<string>, size array<long>"


def build_shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, forward, reverse, words, size): the transforms, and the words (by local id, from 1) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held: dict[str, Shard] = {}

        def emit(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            shard = held.pop(lang)
            seq = np.frombuffer(shard.seq, dtype=np.uint32).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([lang]), pa.array([packed(transform(seq))]), pa.array([packed(transform(seq[::-1]))]),
                 pa.array([[w.decode() for w in shard.ids]], pa.list_(pa.string())),
                 pa.array([np.bincount(seq, minlength=1)[1:]], pa.list_(pa.int64()))],
                names=["shard", "lang", "forward", "reverse", "words", "size"])

        for batch in batches:
            for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                if text:
                    shard = held.setdefault(lang, Shard())
                    shard.add(text)
                    if len(shard.seq) > shard_words:
                        yield emit(lang)
        for lang in list(held):
            yield emit(lang)

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, INDEX_SCHEMA)


def save_bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, bucketed by ``key``, and its catalog name; joins on the key do not shuffle it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:16]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
     .bucketBy(buckets, key).saveAsTable(table))
    return spark.table(table), table


def pack_phrases(*columns: np.ndarray) -> bytes:
    """Columns of integers, the first one ascending, as one byte string."""
    first = np.diff(columns[0], prepend=0)
    return b"".join(struct.pack("<I", len(x)) + x for x in (packed(first), *map(packed, columns[1:])))


def unpack_phrases(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        out.append(unpacked(data[at + 4:at + 4 + n]))
        at += 4 + n
    out[0] = np.cumsum(out[0])
    return out


def deal(p: np.ndarray, s: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each phrase, by a hash of its parents."""
    h = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


def local_phrases(index: DataFrame, known: DataFrame, ranges: int) -> DataFrame:
    """(range, shard, data): the phrases of the next depth in each shard, packed by range.

    ``known``: (shard, depth, data) with the frequent phrases of each shard: local ids and numbers of the words
    (depth 1), and (number, prefix, suffix) of longer ones."""
    schema = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])

    def run(shard: pa.Table, found: pa.Table) -> pa.Table:
        if not shard.num_rows or not found.num_rows:
            return schema.empty_table()
        forward, reverse = (Index(unpacked(shard.column(c)[0].as_py())) for c in ("forward", "reverse"))
        parts: dict[int, list[list[np.ndarray]]] = {}
        for d, data in zip(found.column("depth").to_pylist(), found.column("data").to_pylist()):
            parts.setdefault(d, []).append(unpack_phrases(data))
        nodes = word_nodes(forward.bwt, *map(np.concatenate, zip(*parts[1])))
        for d in range(2, max(parts) + 1):
            nodes = find_nodes(forward, reverse, nodes, *map(np.concatenate, zip(*parts[d])))
        p, s, n = next_depth(forward, reverse, nodes)
        p, s = nodes.ids[p], nodes.ids[s]
        to = deal(p, s, ranges)
        by = np.lexsort((p, to))
        p, s, n, to = p[by], s[by], n[by], to[by]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        return pa.Table.from_arrays(
            [pa.array(to[cut]), pa.array(np.full(len(cut), shard.column("shard")[0].as_py())),
             pa.array([pack_phrases(p[i:j], s[i:j], n[i:j]) for i, j in zip(cut, [*cut[1:], len(to)])], pa.binary())], schema=schema)

    return index.select("shard", "forward", "reverse").groupBy("shard").cogroup(known.groupBy("shard")) \
        .applyInArrow(run, "range long, shard long, data binary")


def frequent_in_ranges(local: DataFrame, min_count: int) -> DataFrame:
    """Sums over shards.  Frequent phrases are rows (id, p, s, f); a row (shard, data) returns to a shard the packed
    (id, p, s) of those that it holds."""
    schema = pa.schema([("id", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        cells = [unpack_phrases(x) for x in part.column("data").to_pylist()]
        p, s, n = (np.concatenate(c) for c in zip(*cells))
        who = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
        by = np.lexsort((s, p))
        p, s, n, who = p[by], s[by], n[by], who[by]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        start = np.flatnonzero(new)
        f = np.add.reduceat(n, start)
        keep = f >= min_count
        ids = (key[0].as_py() << 32) + np.cumsum(keep) - 1
        group = np.cumsum(new) - 1
        hit = np.flatnonzero(keep[group])
        hit = hit[stable_order(who[hit])]                      # by shard, ascending in id
        cut = np.flatnonzero(np.diff(who[hit], prepend=-1))
        data = [pack_phrases(ids[group[hit[i:j]]], p[hit[i:j]], s[hit[i:j]]) for i, j in zip(cut, [*cut[1:], len(hit)])]
        shards = part.column("shard").to_numpy()[who[hit[cut]]]
        rows = pa.Table.from_arrays([pa.array(ids[keep]), pa.array(p[start][keep]), pa.array(s[start][keep]), pa.array(f[keep]),
                                     pa.nulls(int(keep.sum()), pa.int64()), pa.nulls(int(keep.sum()), pa.binary())], schema=schema)
        back = pa.Table.from_arrays([*[pa.nulls(len(data), pa.int64())] * 4, pa.array(shards, pa.int64()), pa.array(data, pa.binary())], schema=schema)
        return pa.concat_tables([rows, back])

    return local.groupBy("range").applyInArrow(run, "id long, p long, s long, f long, shard long, data binary")


# ---------------------------------------------------------------- phrases

def pack_words(rows: DataFrame) -> DataFrame:
    """(shard, data): packed (local id, number) of each shard's frequent words."""
    @F.arrow_udf("binary")
    def run(local: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([pack_phrases(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
                         for a, b in zip(local.to_pylist(), ids.to_pylist())], pa.binary())

    each = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("w"))
    return each.select("shard", run(F.col("w.k"), F.col("w.id")).alias("data"))


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT,
                     shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the phrases of 1 .. depth words that occur at least ``min_count`` times in their language, and (lang, words).

    Columns: id, lang, f (count), phrase, last (its last word), p and s (parents; null for words), and heads and
    tails, the counts of its first 1, 2, .. and last 1, 2, .. words."""
    spark = docs.sparkSession
    small_batches(spark)
    index, table = save_bucketed(build_shards(docs, shard_words), "shard", "fm_index")
    none = F.array().cast("array<long>")
    words = index.select("shard", "lang", F.posexplode(F.arrays_zip("words", "size")).alias("k", "w")) \
        .select("shard", "lang", F.col("w.words").alias("word"), F.col("w.size").alias("n"), (F.col("k") + 1).cast("long").alias("k"))
    totals = save(words.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    level = save(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
                 .select("lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"),
                         F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("s"), none.alias("heads"), none.alias("tails"))
                 .withColumn("id", F.monotonically_increasing_id()), "phrases-1")
    known = save(pack_words(words.join(level.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"]))
                 .withColumn("depth", F.lit(1)), "known-1")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 -(-(totals.agg(F.sum("words")).first()[0] or 0) // RANGE_WORDS))
    levels = [level]
    for d in range(2, depth + 1):
        sums = save(frequent_in_ranges(local_phrases(index, known, ranges), min_count), f"sums-{d}")
        known = known.unionByName(sums.filter("shard is not null").select("shard", "data", F.lit(d).alias("depth")))
        prefix = level.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("_a"), F.col("f").alias("_fp"), F.col("heads").alias("_heads"))
        suffix = level.select(F.col("id").alias("s"), F.col("last").alias("last"), F.col("f").alias("_fs"), F.col("tails").alias("_tails"))
        level = save(sums.filter("shard is null").select("id", "p", "s", "f").join(prefix, "p").join(suffix, "s").select(
            "id", "lang", "f", F.concat_ws(" ", "_a", "last").alias("phrase"), "last", "p", "s",
            F.concat("_heads", F.array("_fp")).alias("heads"), F.concat("_tails", F.array("_fs")).alias("tails")), f"phrases-{d}")
        levels.append(level)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return levels, totals


def lowest_cut(d: int) -> Column:
    """struct (score, k, l, r) of the cut with the lowest score of a phrase of d words, the first of equals."""
    cuts = []
    for k in range(1, d):
        left, right = F.col("heads")[k - 1], F.col("tails")[d - k - 1]
        whole = F.col("f").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)")  # may pass 64 bits
        cuts.append(F.struct(F.call_function("div", whole, (left + right).cast("decimal(20,0)")).alias("score"),
                             F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, limit: int = LIMIT, depth: int = DEPTH, min_count: int = MIN_COUNT,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 .. depth words."""
    levels, totals = frequent_phrases(docs, depth, min_count, shard_words)
    candidates = None
    for d in range(2, depth + 1):
        rows = levels[d - 1].withColumn("cut", lowest_cut(d))
        if d < depth:
            # Of longer phrases around this one, those longer by a word have the largest counts.
            up = levels[d]
            longer = up.select(F.col("p").alias("id"), "f").union(up.select("s", "f")).groupBy("id").agg(F.max("f").alias("_f"))
            rows = rows.join(longer, "id", "left") \
                .filter(F.col("_f").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("_f") < F.lit(COVERED).cast("decimal(20,0)") * F.col("f")))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        candidates = rows if candidates is None else candidates.unionByName(rows)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = candidates.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= limit)
    return top.join(totals.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
