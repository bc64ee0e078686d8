"""Benchmark decontamination through question templates.

Words lose the marks at their edges and become template tokens: numbers, units and names turn into
typed placeholders, others are lower-cased.  A name is a capitalised word that does not
begin a sentence.  Windows of ``WINDOW`` tokens are hash-joined with the benchmark's windows on the
template text itself, so a question asked again with other numbers or names still meets its item.  Windows
with placeholders are joined by their plain case-folded words too: a copy in any casing and a list of
numbers or names are found as they stand.

Items whose whole templates are equal, and whose slots repeat alike, are one *class*: a document is joined with
classes, so a question that the benchmark asks in a thousand variants is one row for a document and not a thousand.
``item_classes`` says which items a class has; its smallest item id represents it.  The plain windows of all its
items belong to the class.

A join row is judged with the others on its diagonal (place in the document minus place in the
item).  A slot of the item has one main value there, the one that most windows give it;
windows that give it another are dropped, and windows of equal text always count.  Different slots
may get the same value.  The item tokens covered by the windows left decide: a document
is contaminated by an item if at least ``COVERAGE`` of them are covered.

Scale: one map pass reads the texts and passes on windows that hit a fixed-size bit map of the
benchmark's windows (``BITMAP_BITS``, the only thing broadcast, whatever the benchmark's size);
the join settles them exactly.  Items shorter than a window are one window of their own length.

Edge cases: null and empty texts, and items without words, match nothing; windows of placeholders
only are no evidence as templates and count by their plain words alone; an item text that repeats is one class with all of
its ids; rows equal in id and text are one document; null ids are kept as such; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, save, small_batches, text_blocks

WINDOW = 5
COVERAGE = 0.8
BITMAP_BITS = 1 << 23
CACHE_TOKENS = 300_000

EDGES = "\"'`()[]{}<>«»„“”‚‘’…*_~.,;:!?"
NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
                         "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
                         "eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
                  "pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute "
                  "minutes hour hours day days week weeks month months year years mph kmh dollar dollars cent cents "
                  "euro euros percent degree degrees meter meters metre metres kilometer kilometers".split())
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


class Tokens(dict):
    """Raw word -> packed (hash of the plain token, hash of the template token, flags: 1 number or unit,
    2 capitalised, 4 ends a sentence)."""

    def __missing__(self, raw: str) -> bytes:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        word = raw.strip(EDGES)
        low = word.casefold()
        typed = placeholder(word, low)
        flags = (1 if typed else 2 if word[:1].isupper() else 0) + 4 * raw.rstrip("\"'”’»)]").endswith((".", "!", "?"))
        got = self[raw] = struct.pack("<QQQ", hash64(low), hash64(typed or low), flags)
        return got


def placeholder(word: str, low: str) -> str | None:
    """Placeholder of a number or unit, None for other words."""
    return NUM if NUMBER.match(word) or low in NUMBER_WORDS else UNIT if low in UNITS else None


def hash64(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


NAME_HASH = hash64(NAME)
_FACTORS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                        0xD6E8FEB86659FD93, 0x27D4EB2F165667C5)]


def template(words: list[str], cache: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's plain tokens and of its template tokens, which are placeholders, and which names."""
    got = np.frombuffer(b"".join([cache[w] for w in words]), dtype="<u8").reshape(-1, 3)
    plain, hashes, flags = got[:, 0].copy(), got[:, 1].copy(), got[:, 2]
    name = flags & np.uint64(2) > 0
    name[:1] = False
    name[1:] &= flags[:-1] < 4
    hashes[name] = np.uint64(NAME_HASH)
    return plain, hashes, name | (flags & np.uint64(1) > 0), name


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    n = len(hashes) - length + 1
    out = np.full(max(n, 0), length, dtype=np.uint64)
    for k in range(length):
        out = (out ^ (out >> np.uint64(29))) * _FACTORS[k % 5] + hashes[k:k + n]
    return out ^ (out >> np.uint64(31))


def windows(words: list[str], lengths: list[int], cache: Tokens, keep=None) -> Iterator[tuple[int, int, str, list[str]]]:
    """(place, hash, text, slot values) of the windows of each length that pass ``keep`` (a test on an array
    of window hashes): as templates where they have a plain word, and where they have a placeholder also as
    plain tokens, without slots.  Plain tokens have no angle brackets at their edges, so the two never meet."""
    if not words:
        return
    plain, hashes, slot, name = template(words, cache)
    before = np.concatenate([[0], np.cumsum(slot)])
    for length in lengths:
        if len(words) < length:
            continue
        filled = before[length:] - before[:-length]
        h, ok = window_hashes(hashes, length), filled < length
        if keep is not None:
            ok &= keep(h)
        for i in np.flatnonzero(ok).tolist():
            tokens = [w.strip(EDGES) for w in words[i:i + length]]
            low = [w.casefold() for w in tokens]
            shown = [NAME if name[i + k] else placeholder(w, x) if slot[i + k] else x
                     for k, (w, x) in enumerate(zip(tokens, low))]
            yield i, int(h[i]), " ".join(shown), [x for k, x in enumerate(low) if slot[i + k]]
        at = np.flatnonzero(filled)
        if not len(at):
            continue
        h = window_hashes(plain, length)[at]
        ok = np.ones(len(at), dtype=bool) if keep is None else keep(h)
        for i, x in zip(at[ok].tolist(), h[ok].tolist()):
            yield i, x, " ".join([w.strip(EDGES).casefold() for w in words[i:i + length]]), []


WINDOW_SCHEMA = "place int, template string, slots array<string>"


def signature(words: list[str], cache: Tokens) -> tuple[str, dict[str, str]]:
    """Digest of an item's whole template with the pattern in which its slot values repeat, and each value's label."""
    _, _, slot, name = template(words, cache)
    labels: dict[str, str] = {}
    shown = []
    for k, w in enumerate(words):
        token = w.strip(EDGES)
        low = token.casefold()
        if slot[k]:
            shown.append((NAME if name[k] else placeholder(token, low)) + labels.setdefault(low, str(len(labels))))
        else:
            shown.append(low)
    return hashlib.sha256(" ".join(shown).encode("utf-8", "surrogatepass")).hexdigest(), labels


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, class, n_tokens, place, length, hash, template, slots) of every item's windows; ``slots`` are labels that
    number the item's slot values."""
    schema = pa.schema([("item_id", pa.int64()), ("class", pa.string()), ("n_tokens", pa.int32()), ("place", pa.int32()),
                        ("length", pa.int32()), ("hash", pa.int64()), ("template", pa.string()),
                        ("slots", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            for i, j in text_blocks(texts := as_text(batch.column(1))):
                rows = []
                for item, text in zip(batch.column(0).slice(i, j - i).to_pylist(), texts[i:j]):
                    words = text.split()
                    length = min(window, len(words))
                    if not length:
                        continue
                    name, labels = signature(words, cache)
                    rows += [(item, name, len(words), at, length, h - (h >> 63 << 64), t, [labels[x] for x in s])
                             for at, h, t, s in windows(words, [length], cache)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().mapInArrow(
        run, "item_id long, class string, n_tokens int, place int, length int, hash long, template string, slots array<string>")


def item_classes(windows_of_items: DataFrame) -> DataFrame:
    """(class, item_id): the items of each class of :func:`benchmark_windows`."""
    return windows_of_items.select("class", "item_id").distinct()


def bit_map(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Fixed-size bit map of the benchmark's window hashes: each task makes one, the driver joins them
    pairwise in a tree, so it receives a few maps of ``bits`` / 8 bytes."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            seen[batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.select("hash").distinct().coalesce(4).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_key, item_id, n_items, n_windows, coverage, exact) of every contaminated document and class of items:
    ``item_id`` represents the class, ``n_items`` is its size; ``exact``: no slot has another value than in its items."""
    small_batches(docs.sparkSession)
    by_item = save(benchmark_windows(items, window), "benchmark_windows")
    classes = item_classes(by_item).groupBy("class").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    bench = save(by_item.drop("item_id").distinct(), "class_windows")
    lengths = sorted(r.length for r in bench.select("length").distinct().collect())  # 1 to window
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(bit_map(bench))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()),
                        ("template", pa.string()), ("slots", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = Tokens(), seen.value

        def keep(h: np.ndarray) -> np.ndarray:
            at = h % np.uint64(BITMAP_BITS)
            return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_text(batch.column(2))
            for i, j in text_blocks(texts):
                rows = [(ids[k], keys[k], at, t, s) for k in range(i, j)
                        for at, _, t, s in windows(texts[k].split(), lengths, cache, keep)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    hits = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id long, text_key long, " + WINDOW_SCHEMA)
    met = hits.join(bench.select("class", "n_tokens", F.col("place").alias("item_place"), "length", "template",
                                 F.col("slots").alias("item_slots")), "template") \
        .withColumn("diagonal", F.col("place") - F.col("item_place"))
    doc = ["doc_id", "text_key", "class", "n_tokens"]
    key = [*doc, "diagonal"]
    pairs = F.array_distinct(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("was"), b.alias("is"))))
    # All that follows up to the diagonals is dealt by ``key``; a diagonal has at most an item's windows.
    votes = (met.repartition(*key).distinct().withColumn("plain", F.size("item_slots") == 0)
             .select(*key, "item_place", "length", "plain", F.explode_outer(pairs).alias("p"))
             .select(*key, "item_place", "length", "plain", "p.was", "p.is")
             .withColumn("votes", F.count("*").over(Window.partitionBy(*key, "was", "is"))))
    best = Window.partitionBy(*key, "was").orderBy(F.desc("votes"), "is")
    judged = (votes.withColumn("main", F.first("is").over(best))
              .groupBy(*key, "item_place", "length", "plain").agg(F.min(F.col("is").eqNullSafe(F.col("main"))).alias("ok")))
    diagonal = (judged.groupBy(*key)
                .agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("ok"), F.sequence(
                         "item_place", F.col("item_place") + F.col("length") - 1))))).alias("covered"),
                     F.countDistinct(F.when(F.col("ok"), F.col("item_place"))).alias("windows"),
                     F.size(F.array_except(F.collect_set(F.when(~F.col("plain"), F.col("item_place"))),
                                           F.collect_set(F.when(F.col("plain"), F.col("item_place"))))).alias("other")))
    found = (diagonal.filter("windows > 0").groupBy(*doc)
             .agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"),
                  F.sum("windows").alias("n_windows"), (F.sum("other") == 0).alias("exact")))
    return (found.withColumn("coverage", F.size("covered") / F.col("n_tokens")).filter(F.col("coverage") >= coverage)
            .join(classes, "class").select("doc_id", "text_key", "item_id", "n_items", "n_windows", "coverage", "exact"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no item contaminates (null ids are judged by their texts)."""
    keys = ["__tm_id", "__tm_null", "__tm_key"]

    def keyed(df: DataFrame, key) -> DataFrame:
        return df.withColumns({keys[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                               keys[1]: F.col("doc_id").isNull(), keys[2]: key})

    bad = keyed(contaminated(docs, items), F.col("text_key")).select(*keys).distinct()
    return keyed(docs, F.xxhash64("text")).join(bad, keys, "left_anti").select(*docs.columns)
