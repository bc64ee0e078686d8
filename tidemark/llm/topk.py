"""Exact top-k inner-product search with a pivot-distance index.

Vectors are quantised to integers and get one more coordinate that brings all of them to the
largest norm M, so the highest inner product is the smallest Euclidean distance: for a query q
(extra coordinate 0) and a vector x, |q - x|^2 = |q|^2 + M^2 - 2 <q, x>.

* Index: at most ``SAMPLE`` vectors (by id hash) give the pivots by a few k-means steps; their number
  grows with the rows (``pivot_count``).  Every vector is keyed by its nearest pivot and its distance to it, rows are range-partitioned by
  (pivot, distance, id), and runs of at most ``CHUNK`` rows become *annuli*: packed matrices with
  their least and largest distance.  A hot cell is cut into as many annuli as its rows need.
* First expansion: a query scores the annulus nearest to its own distance in each of its ``PROBES``
  nearest cells; its k-th best score so far is a lower bound t.
* Second expansion: a vector that reaches t lies within D = sqrt(|q|^2 + M^2 - 2t), so by the triangle
  inequality its pivot distance is in [s - D, s + D] for the query's pivot distance s.  Only annuli
  that meet this interval are opened; all others are proven to hold nothing.

Queries find their annuli by a join on (cell, distance bucket): a cell's range of distances is cut into
as many buckets as it has annuli, and an annulus stands in each bucket up to the start of the next
one.  So no query is compared with a whole cell, and a hot cell is many join keys.

Queries meet annuli in blocks of at most about ``QUERY_BLOCK``, so a task holds one annulus and one
block.  Scores are exact: products that fit are multiplied in float64 (exact below 2^53), others
as Python integers, cut to the range of a long.

Edge cases: vectors that are null, hold null or non-finite components, or have a null id take no
part; shorter vectors count as padded with zeros (an empty one is all zeros); every row is a
candidate, repeated ones each time; rows sharing a query's id are never its candidates; rows that
share an id and are queries are ranked together, pairs of repeated rows each time (as in a join of
the table with itself); fewer than k candidates give fewer rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches

PIVOTS = 64
SAMPLE = 4096
CHUNK = 512
PROBES = 3
QUERY_BLOCK = 4096
SCALE = 256
SLACK = 1e-6
LONG = (1 << 63) - 1


def usable(vec: str) -> Column:
    c = F.col(vec)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & F.coalesce(finite, F.lit(False)), F.lit(False))


def quantise(lists: list, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) as float64 (exact: such integers of 32-bit floats fit), padded to ``dim``."""
    out = np.zeros((len(lists), dim))
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return np.floor(out * SCALE)


def encode(rows: np.ndarray) -> list[bytes]:
    """Vectors as bytes: 16-bit integers where all components of a row fit, else float64."""
    small = np.abs(rows).max(axis=1, initial=0) < 32768
    return [r.astype("<i2").tobytes() if s else r.astype("<f8").tobytes() for r, s in zip(rows, small)]


def decode(cells: list[bytes], dim: int) -> np.ndarray:
    if not cells:
        return np.zeros((0, dim))
    if dim and all(len(c) == 2 * dim for c in cells):
        return np.frombuffer(b"".join(cells), dtype="<i2").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(c, dtype="<i2" if len(c) == 2 * dim else "<f8").astype(np.float64)
                     for c in cells])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T, as int64."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    x = np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape)
    y = np.array([[int(v) for v in r] for r in b], dtype=object).reshape(b.shape)
    return np.array([[max(-LONG - 1, min(LONG, v)) for v in r] for r in x @ y.T], dtype=np.int64).reshape(len(a), len(b))


def lift(rows: np.ndarray, norm2: float) -> np.ndarray:
    """Adds the coordinate that brings each row to the squared norm ``norm2``."""
    return np.hstack([rows, np.sqrt(np.maximum(0.0, norm2 - (rows ** 2).sum(axis=1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None] - 2 * a @ b.T))


def pick_pivots(sample: np.ndarray, pivots: int, steps: int = 6) -> np.ndarray:
    """k-means centres of the bounded sample."""
    points = np.unique(sample, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(pivots, len(points))).astype(int)]
    for _ in range(steps):
        near = distances(points, centres).argmin(axis=1)
        centres = np.stack([points[near == k].mean(axis=0) if (near == k).any() else centres[k]
                            for k in range(len(centres))])
    return centres


def pivot_count(rows: int, chunk: int = CHUNK) -> int:
    """Pivots for so many rows: cells of about 16 annuli, as far as the bounded sample can place them."""
    return max(PIVOTS, min(SAMPLE // 4, rows // (16 * chunk)))


def build_index(vectors: DataFrame, dim: int, norm2: float, centres: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Annuli (cell, annulus, near, far, ids, vecs) over every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = quantise(batch.column(1).to_pylist(), dim)
            far = distances(lift(rows, norm2), shared.value)
            cell = far.argmin(axis=1) if len(rows) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(rows)), cell]),
                 pa.array(encode(rows), pa.binary())], names=["vec_id", "cell", "dist", "vec"])

    keyed = vectors.mapInArrow(key, "vec_id long, cell int, dist double, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "cell", "dist", "vec_id", "vec") \
        .sortWithinPartitions("cell", "dist", "vec_id", "vec")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, []

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            number += 1
            rows = decode([r[3] for r in held], dim)
            out = pa.RecordBatch.from_arrays(
                [pa.array([held[0][1]], pa.int32()), pa.array([number], pa.int64()),
                 pa.array([held[0][2]], pa.float64()), pa.array([held[-1][2]], pa.float64()),
                 pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
                 pa.array([encode(rows)], pa.list_(pa.binary()))],
                names=["cell", "annulus", "near", "far", "ids", "vecs"])
            held = []
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][1] != row[1] or len(held) == chunk):
                    yield emit()
                held.append(row)
        if held:
            yield emit()

    return dealt.mapInArrow(cut, "cell int, annulus long, near double, far double, ids array<long>, vecs array<binary>")


def score_annuli(routed: DataFrame, annuli: DataFrame, dim: int, k: int, blocks: int) -> DataFrame:
    """(query, query_id, vec_id, score) of each query's k best in every annulus it is sent to, down to
    its bound.  ``routed``: (annulus, query, query_id, vec, bound)."""
    left = routed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    right = annuli.select("annulus", "ids", "vecs",
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, part: pa.Table) -> pa.Table:
        if not queries.num_rows or not part.num_rows:
            return schema.empty_table()
        ids = np.array(part.column("ids")[0].as_py(), dtype=np.int64)
        rows = decode(part.column("vecs")[0].as_py(), dim)
        by_id = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, rows = ids[by_id], rows[by_id]
        numbers, own = queries.column("query").to_numpy(), queries.column("query_id").to_numpy()
        bounds, vecs = queries.column("bound").to_pylist(), queries.column("vec").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        for at in range(0, len(own), 256):
            score = inner(decode(vecs[at:at + 256], dim), rows)
            for i, s in enumerate(score, at):
                low = bounds[i]
                hit = np.flatnonzero((ids != own[i]) & (s >= low)) if low is not None else np.flatnonzero(ids != own[i])
                best = hit[np.argsort(-s[hit].astype(object) if (s[hit] == -LONG - 1).any() else -s[hit], kind="stable")][:k]
                out += [(int(numbers[i]), int(own[i]), int(ids[x]), int(s[x])) for x in best]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=schema)

    return left.groupBy("annulus", "block").cogroup(right.groupBy("annulus", "block")).applyInArrow(
        run, "query long, query_id long, vec_id long, score long")


class Buckets:
    """Distance buckets of the cells: as many of one width as the cell has annuli.  A few numbers a cell."""

    def __init__(self, shells: DataFrame, cells: int):
        self.start, self.width, self.count = np.zeros(cells), np.ones(cells), np.zeros(cells, dtype=np.int64)
        for r in shells.groupBy("cell").agg(F.min("near").alias("start"), F.max("far").alias("end"),
                                            F.count("*").alias("n")).collect():
            self.start[r.cell], self.count[r.cell] = r.start, r.n
            self.width[r.cell] = (r.end - r.start) / r.n or 1.0

    def of(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        at = np.floor((dist - self.start[cell]) / self.width[cell])
        return np.clip(at, 0, np.maximum(0, self.count[cell] - 1)).astype(np.int64)

    def place(self, shells: DataFrame) -> DataFrame:
        """(cell, shell, near, far, first, bucket) for each bucket from an annulus's start to the next one's."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, near, until = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "near", "until"))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in ("cell", "shell", "near", "far")),
                     pa.array(self.of(cell, near)), pa.array(self.of(cell, until))],
                    names=["cell", "shell", "near", "far", "first", "last"])

        following = F.lead("near").over(Window.partitionBy("cell").orderBy("near", "far", "shell"))
        return (shells.withColumn("until", F.greatest(F.col("far"), F.coalesce(following, F.lit(math.inf))))
                .mapInArrow(run, "cell int, shell long, near double, far double, first long, last long")
                .withColumn("bucket", F.explode(F.sequence("first", "last"))).drop("last"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row for which ``is_query``
    (a condition on ``vec_id``) holds, ties to the smaller vec_id.  ``pivots``: ``pivot_count`` if not given."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & usable("embedding"))
    norm = F.aggregate(F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double")), F.lit(0.0),
                       lambda a, x: a + x * x)
    facts = rows.agg(F.max(norm).alias("norm2"), F.max(F.size("embedding")).alias("dim"),
                     F.count("*").alias("rows"), F.sum(is_query.cast("long")).alias("queries")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts.queries:
        return spark.createDataFrame([], out)
    dim, norm2 = max(1, facts.dim), facts.norm2
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    centres = pick_pivots(lift(quantise([r.embedding for r in sample], dim), norm2),
                          pivots or pivot_count(facts.rows, chunk))
    annuli = save(build_index(rows, dim, norm2, centres, chunk), "annuli")
    shells = annuli.select("cell", F.col("annulus").alias("shell"), "near", "far")
    buckets = Buckets(shells, len(centres))
    placed = save(buckets.place(shells), "shells")

    blocks = max(1, -(-facts.queries // QUERY_BLOCK))
    centre_var = spark.sparkContext.broadcast(centres)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encode(quantise(batch.column(1).to_pylist(), dim)), pa.binary())],
                names=["query_id", "vec"])

    # ``query`` tells rows with one id but different vectors apart.
    queries = save(rows.filter(is_query).mapInArrow(read, "query_id long, vec binary")
                   .groupBy("query_id", "vec").agg(F.count("*").alias("copies"))
                   .withColumn("query", F.xxhash64("query_id", "vec")), "queries")

    def route(nearest: int | None):
        """Cells of each query with the interval of pivot distances that can hold an answer; in its
        ``nearest`` cells, where given, the interval is the query's own distance."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = decode(batch.column("vec").to_pylist(), dim)
                dist = distances(np.hstack([points, np.zeros((len(points), 1))]), centre_var.value)
                bound = np.array([-math.inf if b is None else b for b in batch.column("bound").to_pylist()], dtype=float)
                reach = np.sqrt(np.maximum(0.0, (points ** 2).sum(axis=1) + norm2 - 2 * bound)) + SLACK * math.sqrt(norm2) + SLACK
                cells = np.argsort(dist, axis=1)[:, :nearest]
                q = np.repeat(np.arange(len(points)), cells.shape[1])
                cell, s = cells.ravel(), dist[q, cells.ravel()]
                low, high = (s, s) if nearest else (s - reach[q], s + reach[q])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query").take(pa.array(q)), pa.array(cell.astype(np.int32)),
                     pa.array(s), pa.array(low), pa.array(high),
                     pa.array(buckets.of(cell, low)), pa.array(buckets.of(cell, high))],
                    names=["query", "cell", "s", "low", "high", "from", "to"])
        return run

    def meet(bounded: DataFrame, nearest: int | None) -> DataFrame:
        """Queries with the annuli in their buckets; a pair stands in the first bucket that both have."""
        return (bounded.mapInArrow(route(nearest), "query long, cell int, s double, low double, high double, "
                                                   "from long, to long")
                .withColumn("bucket", F.explode(F.sequence("from", "to"))).join(placed, ["cell", "bucket"])
                .filter(F.col("bucket") == F.greatest("from", "first")))

    open_bound = queries.withColumn("bound", F.lit(None).cast("long"))
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("s"), F.col("s") - F.col("far"))
    seeds = (meet(open_bound, PROBES)
             .groupBy("query", "cell").agg(F.min_by("shell", F.struct(gap, F.col("shell"))).alias("annulus")))
    seeded = score_annuli(seeds.select("query", "annulus").join(open_bound, "query"), annuli, dim, k, blocks)
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    kth = save(seeded.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") == k)
               .select("query", F.col("score").alias("bound")), "bounds")
    bounded = save(queries.join(kth, "query", "left"), "bounded")

    sent = (meet(bounded, None).filter((F.col("far") >= F.col("low")) & (F.col("near") <= F.col("high")))
            .select("query", F.col("shell").alias("annulus")).join(bounded, "query"))
    found = score_annuli(sent, annuli, dim, k, blocks)
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    by_id = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.join(queries.select("query", F.least(F.col("copies"), F.lit(k)).alias("copies")), "query")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
