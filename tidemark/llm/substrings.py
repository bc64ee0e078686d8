"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash among its
``GRAM``-word grams.  Consecutive windows with the same minimiser travel as one packed string
(a super-k-mer, about a window and a half of words) to the bucket of the minimiser, where all equal windows
meet.  A bucket sorts its windows by hash, then document, then start; equal neighbours are compared
word for word, and every one but the first is a repeat.

What keeps it small: super-k-mers for one bucket are compressed together before the shuffle; a
block of texts first looks for repeats in itself and ships only the first of equal windows, so copies and
common passages are combined before they travel; a bucket opens only minimisers that came
more than once.  There is a bucket for every ``BUCKET_BYTES`` of text (and two a shuffle partition at least), so
buckets grow in number and not in size, whatever the partitions are.

Hot minimisers: a short common line gives every document windows of its own with one minimiser.  A
first pass counts the words of super-k-mers by slots of minimisers (``SLOTS`` a bucket), and windows of a slot
with more words than ``HOT_SHARE`` of a mean bucket travel one by one to the bucket of their own hash, where equal ones
meet all the same.  There are less than buckets / ``HOT_SHARE`` such slots; their numbers (8 bytes each) are broadcast.

Repeats come back as word ranges keyed by (doc_id, content key), and one join brings them to the
texts.  The first occurrence is the one with the smallest (doc_id, start); windows are judged on
the input.

Edge cases: null and empty texts have no words; rows equal in id and text are the same document
(neither is earlier); equal starts under one id are not earlier either; null ids come after all
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, save, small_batches, text_blocks

WINDOW = 20
GRAM = 4
NULL_ID = (1 << 63) - 1
SLOTS = 16
BUCKET_BYTES = 8 << 20
HOT_SHARE = 0.5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0x27D4EB2F165667C5)]


def _gram_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of the gram that starts at each word; the last GRAM - 1 places are filled with zeros."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words), dtype=np.uint64)
    if len(words) >= GRAM:
        n = len(words) - GRAM + 1
        for k in range(GRAM):
            out[:n] += (h[k:k + n] ^ (h[k:k + n] >> np.uint64(29))) * _MIX[k]
        out ^= out >> np.uint64(32)
        out *= _MIX[4]
        out ^= out >> np.uint64(29)
    return out


def _window_hashes(grams: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window that starts at each place (places without a full window: any value)."""
    n = len(grams) - window + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k, at in enumerate([*range(0, window - GRAM, GRAM), window - GRAM]):
        out = (out ^ (out >> np.uint64(31))) * _MIX[k % 5] + grams[at:at + n]
    return out


def _minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Smallest of the ``window - GRAM + 1`` grams from each place, by doubling."""
    span, have, low = window - GRAM + 1, 1, grams
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = span - have
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _repeats(order: np.ndarray, hashes: np.ndarray, place: np.ndarray, words: list[bytes], window: int,
             rank: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by (hash, id, start): which repeat an earlier one, and which equal the first one
    in id, start and content key.  ``place`` is a window's first word in ``words``."""
    repeat, same = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    sorted_hash = hashes[order]
    new = np.concatenate([[True], sorted_hash[1:] != sorted_hash[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    ids, starts, keys = rank
    firsts: dict[int, dict[tuple, int]] = {}
    for k in np.flatnonzero(~new):
        i, first = int(order[k]), int(order[head[k]])
        mine = words[place[i]:place[i] + window]
        if mine != words[place[first]:place[first] + window]:  # other words, same hash
            seen = firsts.setdefault(int(head[k]), {})
            first = seen.setdefault(tuple(mine), i)
            if first == i:
                continue
        if ids[i] == ids[first] and starts[i] == starts[first]:
            same[i] = keys[i] == keys[first]
        else:
            repeat[i] = True
    return repeat, same


def _ranges(flag: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(doc, first word, end word) of runs of flagged windows with consecutive starts in one document."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    d, s = doc[at], start[at]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    return d[lo], s[lo], s[hi] + window


def _pack(numbers: list[np.ndarray], text: bytes, tool: zstandard.ZstdCompressor) -> bytes:
    head = np.array([len(x) for x in numbers], dtype="<i8").tobytes()
    return tool.compress(head + b"".join(x.astype("<i8").tobytes() for x in numbers[:2])
                         + b"".join(x.astype("<i4").tobytes() for x in numbers[2:]) + text)


def _unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    counts, at, out = np.frombuffer(raw[:40], dtype="<i8"), 40, []
    for k, n in enumerate(counts):
        kind = "<i8" if k < 2 else "<i4"
        size = int(n) * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at:at + size], dtype=kind))
        at += size
    return out, raw[at:]


def slot_words(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """(slot, n): words of the super-k-mers of each slot of minimisers, in all texts."""
    slots = buckets * SLOTS

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        at, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return at, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(at)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        waiting = 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, j in text_blocks(texts):
                per_doc = [t.split() for t in texts[i:j]]
                words = [w for x in per_doc for w in x]
                if len(words) < window:
                    continue
                doc = np.repeat(np.arange(j - i), [len(x) for x in per_doc])
                minima = _minimisers(_gram_hashes(words), window)[:len(words) - window + 1]
                whole = np.flatnonzero(doc[:len(minima)] == doc[window - 1:])
                if not len(whole):
                    continue
                minima = minima[whole]
                new = np.concatenate([[True], (np.diff(whole) != 1) | (minima[1:] != minima[:-1])])
                # A super-k-mer has its windows' number of words and ``window`` - 1 more.
                parts.append(summed([((minima % np.uint64(slots)).astype(np.int64), 1 + new * (window - 1))]))
                waiting += len(parts[-1][0])
                if waiting > 1 << 21:
                    parts, waiting = [summed(parts)], 0
        at, n = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["slot", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def hot_slots(docs: DataFrame, buckets: int, window: int = WINDOW, hot_words: int | None = None) -> np.ndarray:
    """Sorted slots with more than ``hot_words`` words (default: ``HOT_SHARE`` of a mean bucket)."""
    counted = save(slot_words(docs, buckets, window), "slot_words")
    if hot_words is None:
        hot_words = int(HOT_SHARE * (counted.agg(F.sum("n")).first()[0] or 0) / buckets)
    return np.array(sorted(r.slot for r in counted.filter(F.col("n") > hot_words).select("slot").collect()), dtype=np.uint64)


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def super_kmers(docs: DataFrame, buckets: int, window: int = WINDOW, hot_words: int | None = None) -> DataFrame:
    """(bucket, ids, ranges): compressed super-k-mers of a block of texts for one bucket, or (bucket -1)
    the repeats that a block found in itself."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_slots(docs, buckets, window, hot_words))

    def block(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], tool) -> Iterator[tuple]:
        per_doc = [t.split() for t in texts]
        words = [w for x in per_doc for w in x]
        counts = np.array([len(x) for x in per_doc], dtype=np.int64)
        if len(words) < window:
            return
        doc = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        grams = _gram_hashes(words)
        hashes, minima = _window_hashes(grams, window), _minimisers(grams, window)
        whole = np.flatnonzero(doc[:len(hashes)] == doc[window - 1:])
        if not len(whole):
            return
        hashes, minima, doc = hashes[whole], minima[whole], doc[whole]
        start = whole - first[doc]
        # Texts come in the order of their ids, so a stable sort by hash keeps (id, start).
        order = np.argsort(hashes, kind="stable")
        repeat, same = _repeats(order, hashes, whole, words, window, (ids[doc], start, keys[doc]))
        d, lo, hi = _ranges(repeat, doc, start, window)
        if len(d):
            yield -1, _pack([ids[d], keys[d], lo, hi, lo[:0]], b"", tool)
        keep = np.flatnonzero(~repeat & ~same)
        if not len(keep):
            return
        hot = np.isin(minima % np.uint64(buckets * SLOTS), shared.value)
        minima = np.where(hot, hashes, minima)
        cut = np.flatnonzero((np.diff(whole[keep]) != 1) | (np.diff(doc[keep]) != 0)
                             | (minima[keep][1:] != minima[keep][:-1]) | hot[keep][1:]) + 1
        begin = keep[np.concatenate([[0], cut])]
        end = keep[np.concatenate([cut, [len(keep)]]) - 1]
        low = minima[begin]
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        for part in np.split(by_bucket, edges):
            b, e = begin[part], end[part]
            used, index = np.unique(doc[b], return_inverse=True)
            text = b"\n".join([b" ".join(words[i:j + window]) for i, j in zip(whole[b].tolist(), whole[e].tolist())])
            mini = (low[part] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield int(bucket[part[0]]), _pack([ids[used], keys[used], index, start[b], mini], text, tool)

    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = np.array([NULL_ID if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
            keys = batch.column(1).to_numpy()
            texts = as_bytes(batch.column(2))
            order = np.argsort(ids, kind="stable")
            ids, keys, texts = ids[order], keys[order], [texts[k] for k in order]
            for i, j in text_blocks(texts, 6 << 20):
                rows = list(block(ids[i:j], keys[i:j], texts[i:j], tool))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                      pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string")) \
        .mapInArrow(run, "bucket int, packed binary")


def _bucket_repeats(blocks: list[bytes], window: int) -> list[tuple[np.ndarray, ...]]:
    """(ids, keys, first word, end word) of the repeats among the super-k-mers of one bucket."""
    numbers, lines = [], []
    for packed in blocks:
        (ids, keys, index, start, mini), text = _unpack(packed)
        numbers.append((ids[index], keys[index], start, mini))
        lines.append(text)
    mini = np.concatenate([x[3] for x in numbers])
    _, inverse, times = np.unique(mini, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    if not shared.any():
        return []
    ids, keys, start = (np.concatenate([x[k] for x in numbers])[shared] for k in range(3))
    picked, at = [], 0
    for text in lines:
        parts = text.split(b"\n")
        picked += [parts[k].split(b" ") for k in np.flatnonzero(shared[at:at + len(parts)])]
        at += len(parts)
    counts = np.array([len(x) for x in picked], dtype=np.int64)
    words = [w for x in picked for w in x]
    row = np.repeat(np.arange(len(picked)), counts)
    hashes = _window_hashes(_gram_hashes(words), window)
    place = np.flatnonzero(row[:len(hashes)] == row[window - 1:])
    hashes, row = hashes[place], row[place]
    begin = start[row] + place - (np.cumsum(counts) - counts)[row]
    order = np.lexsort((begin, ids[row], hashes))
    repeat, _ = _repeats(order, hashes, place, words, window, (ids[row], begin, keys[row]))
    r, lo, hi = _ranges(repeat, row, begin, window)
    return [(ids[r], keys[r], lo, hi)] if len(r) else []


def repeated_ranges(docs: DataFrame, window: int = WINDOW, buckets: int | None = None,
                    hot_words: int | None = None) -> DataFrame:
    """(doc_id, text_key, first, end): word ranges covered by windows that occur earlier."""
    buckets = buckets or bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for ids, keys, lo, hi in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(keys, pa.int64()),
                     pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    names=["doc_id", "text_key", "first", "end"])

        now, held = None, []
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket < 0:
                    (ids, keys, lo, hi, _), _text = _unpack(packed)
                    yield from emit([(ids, keys, lo, hi)])
                    continue
                if bucket != now and held:
                    yield from emit(_bucket_repeats(held, window))
                    held = []
                now = bucket
                held.append(packed)
        if held:
            yield from emit(_bucket_repeats(held, window))

    packed = super_kmers(docs, buckets, window, hot_words)
    # Repeats found within a block (bucket -1) spread by content; they need no meeting place.
    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("packed"))
    return packed.repartition(buckets, spread).sortWithinPartitions("bucket") \
        .mapInArrow(run, "doc_id long, text_key long, first int, end int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None,
                   hot_words: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: ``kept`` holds the words left, one blank apart."""
    small_batches(docs.sparkSession)
    ranges = save(repeated_ranges(docs, window, buckets, hot_words), "repeats")
    marks = (ranges.distinct().groupBy("doc_id", "text_key")
             .agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("_r")))
    marks = marks.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"),
                         F.col("text_key").alias("_key"), F.col("_r.first").alias("_first"), F.col("_r.end").alias("_end"))

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, first, end in batches:
            total, removed, kept = [], [], []
            for t, lo, hi in zip(as_bytes(text), first.to_pylist(), end.to_pylist()):
                words = t.split()
                n = len(words)
                if lo:
                    left, at = [], 0
                    for i, j in zip(lo, hi):
                        if i > at:
                            left += words[at:i]
                        at = max(at, j)
                    words = left + words[at:]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                       F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_key"))
    return (rows.join(marks, ["_id", "_null", "_key"], "left")
            .select("doc_id", cut("text", "_first", "_end").alias("_c")).select("doc_id", "_c.*"))
