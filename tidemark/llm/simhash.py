"""SimHash near-dedup with a pigeonring filter.

Fingerprints: words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; shingles of
``SHINGLE`` words (fewer words: the whole sequence) are hashed by XXH64 (seed 42), and a bit is
set if it is set in over half of the hashes.  No words: fingerprint zero.

Links (at most ``MAX_BITS`` differing bits): the 64 bits are a ring of ``SEGMENTS`` segments.  By
the strong pigeonring principle two fingerprints within ``MAX_BITS`` have a start segment from
which every chain of l consecutive segments differs in at most l * MAX_BITS / SEGMENTS bits:
with 5 segments and 4 bits that is 0, 1, 2, 3, 4 bits.  The first two steps are the grouping key
(start segment equal, next segment at most one bit apart: the fingerprint whose bit is 0 also
visits the key with the bit set), the next two prune candidates, and the full Hamming check
comes last.

Only distinct fingerprints are compared, and a group of mutual neighbours is never written out
as pairs: within a key a breadth-first search over the fingerprints not yet reached yields a
spanning forest (at most members - 1 links), which has the same components.  Keys with
more than ``BLOCK`` members are split into a grid of blocks; each cell pairs two blocks, so no task
holds more than two blocks of a key, and still every pair meets in one cell.

Edge cases: null and empty texts have fingerprint zero and link like any other; equal rows share a
component; a component whose ids are all null has a null component id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, save, small_batches
from .components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (lowest bit, width) of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[i:j - 1], SEED) for i, j in zip(starts, starts[shingle:])]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k:k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> Column:
    """Fingerprint (long) of a text column."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([fingerprint(t, shingle) for t in as_bytes(col)], pa.int64())

    return run(F.col(text))


def _segment(fp: Column, k: int) -> Column:
    low, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fingerprints: DataFrame) -> DataFrame:
    """(key, fp, own) of every fingerprint: its own key for each start segment, and the keys with one
    unset bit of the next segment set.  Two fingerprints whose chain holds meet at the own key of one."""
    fp = F.col("fp")
    keys = []
    for k in range(len(SEGMENTS)):
        a, b = _segment(fp, k), _segment(fp, k + 1)
        head = F.lit(k).cast("long") * (1 << 26) + a * (1 << 13)
        keys.append(F.array(F.struct((head + b).alias("key"), F.lit(True).alias("own"))))
        width = SEGMENTS[(k + 1) % len(SEGMENTS)][1]
        flips = [F.when(b.bitwiseAND(F.lit(1 << j)) == 0,
                        F.struct((head + b + (1 << j)).alias("key"), F.lit(False).alias("own"))) for j in range(width)]
        keys.append(F.filter(F.array(*flips), lambda x: x.isNotNull()))
    return fingerprints.select("fp", F.explode(F.concat(*keys)).alias("_k")).select("_k.key", "fp", "_k.own")


def _masks(start: int) -> list[np.uint64]:
    """Bits of the chains of 3 and 4 segments from a start segment."""
    out, mask = [], 0
    for step in range(4):
        low, width = SEGMENTS[(start + step) % len(SEGMENTS)]
        mask |= ((1 << width) - 1) << low
        if step >= 2:
            out.append(np.uint64(mask))
    return out


def _close(one: np.uint64, many: np.ndarray, start: int) -> np.ndarray:
    """Places in ``many`` within MAX_BITS of ``one``: chain budgets first, the full check last."""
    diff = many ^ one
    at = np.arange(len(many))
    for budget, mask in zip((2, 3), _masks(start)):
        keep = np.bitwise_count(diff & mask) <= budget
        diff, at = diff[keep], at[keep]
    return at[np.bitwise_count(diff) <= MAX_BITS]


def spanning_links(fps: np.ndarray, own: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a key's members (fingerprints as uint64).

    Breadth first: each member is compared with the members not reached yet, and those it links
    leave the list, so dense groups take about linear time.  Links between two visiting members
    (not ``own``) belong to other keys, and are left to them."""
    links: list[tuple[int, int]] = []
    rest = {True: fps[own], False: fps[~own]}
    while len(rest[True]):
        todo = [(rest[True][0], True)]
        rest[True] = rest[True][1:]
        while todo:
            one, is_own = todo.pop()
            for side in (True, False) if is_own else (True,):
                at = _close(one, rest[side], start)
                if len(at):
                    found = rest[side][at]
                    rest[side] = np.delete(rest[side], at)
                    links += [(int(one), int(x)) for x in found]
                    todo += [(x, side) for x in found]
    return links


def _links_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the keys of one partition, which comes sorted by (key, cell)."""
    held: list[tuple[np.ndarray, ...]] = []

    def links_of(key: np.ndarray, cell: np.ndarray, fp: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        start = np.concatenate([[0], cut])
        end = np.concatenate([cut, [len(key)]])
        keep = (end - start >= 2) & (np.add.reduceat(own, start) > 0)
        out: list[tuple[int, int]] = []
        for i, j in zip(start[keep], end[keep]):
            out += spanning_links(fp[i:j], own[i:j].astype(bool), int(key[i] >> 26))
        return out

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    for batch in batches:
        cols = (batch.column("key").to_numpy(), batch.column("cell").to_numpy(),
                batch.column("fp").to_numpy().view(np.uint64),
                batch.column("own").to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(cols[0]):
            continue
        held.append(cols)
        if cols[0][0] == cols[0][-1] and cols[1][0] == cols[1][-1]:
            continue  # maybe one key in the whole batch: wait for its end
        joined = [np.concatenate(c) for c in zip(*held)]
        last = np.flatnonzero((joined[0] != joined[0][-1]) | (joined[1] != joined[1][-1]))[-1] + 1
        held = [tuple(c[last:] for c in joined)]
        yield emit(links_of(*(c[:last] for c in joined)))
    if held:
        yield emit(links_of(*(np.concatenate(c) for c in zip(*held))))


def large_keys(rows: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the keys that may have more than ``block`` members.

    A key's members come from its own fingerprints and from those of at most 13 keys one bit
    away, so a large one has a source of over block / 14; only such sources are spread here, and
    ``blocks`` allows for what the smaller ones add."""
    own = rows.filter("own").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block // 14)
    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(13)])
    near = F.concat(F.array("key"), F.transform(F.filter(bits, lambda x: F.col("key").bitwiseAND(x) == 0),
                                                lambda x: F.col("key") + x))
    return (own.select(F.explode(near).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
            .select("key", (F.ceil(F.col("n") / block) + 1).cast("int").alias("blocks")))


def near_links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as the relation "within MAX_BITS" does."""
    rows = chain_keys(fingerprints)
    large = save(large_keys(rows, block), "large_keys")
    if large.limit(1).count():
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                            lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
        rows = (rows.join(large, "key", "left")
                .withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cells)))
                .select("key", "cell", "fp", "own"))
    else:
        rows = rows.withColumn("cell", F.lit(0))
    return (rows.repartition("key", "cell").sortWithinPartitions("key", "cell")
            .mapInArrow(_links_in_partition, "a long, b long"))


def classes(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp); ``root`` names its component."""
    first = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = connected_components(near_links(first.select("fp"), block))
    rooted = save(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                  .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of every row."""
    small_batches(docs.sparkSession)
    prints = save(docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                              fingerprint_column("text", shingle).alias("fp")), "prints")
    return prints.join(classes(prints, block), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` with one document of each component kept: the one with the smallest id.

    Null ids come last.  Of rows equal in id and text one stays; where an id repeats over different texts of a
    component, the text with the smallest content key stays."""
    found = near_duplicates(docs, shingle)
    best = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("b"))
            .select("b.doc_id", "b.text_key"))
    keys = ["__tm_id", "__tm_null", "__tm_key"]

    def keyed(df: DataFrame, key: Column) -> DataFrame:
        return df.withColumns({keys[0]: F.coalesce("doc_id", F.lit(0)), keys[1]: F.col("doc_id").isNull(), keys[2]: key})

    winners = keyed(best, F.col("text_key")).select(*keys).distinct()
    rest = [F.col(c) for c in docs.columns if c != "text" and docs.schema[c].dataType.typeName() != "map"]
    one = Window.partitionBy(*keys).orderBy(*rest)
    return (keyed(docs, F.xxhash64("text")).join(winners, keys, "left_semi")
            .withColumn("__tm_n", F.row_number().over(one)).filter("__tm_n = 1").select(*docs.columns))
