"""Approximate nearest neighbours by cross-polytope hashing.

Nearness is the inner product.  For hashing, vectors get one more coordinate that brings all of them
to the largest norm, so the largest product is the smallest angle; queries get a zero there.

* Hash.  Three rounds of random signs and a fast Hadamard transform rotate the unit vector; the
  hash is the nearest signed axis.  ``TABLES`` tables have rotations of their own.  Where the data
  need more buckets than one hash has, further hashes with as many axes as needed are appended, so
  a bucket keeps about ``OCCUPANCY`` vectors at any size of the table.
* Multiprobe.  A query looks into the buckets of each table in the order of its own coordinates along
  their axes (sums of them for several hashes).
* How many probes a table needs is fitted: at most ``SAMPLE`` query vectors (by hash) are searched
  exactly, in one pass over all vectors, and ``probes`` is the least number that finds ``TARGET`` of
  their true neighbours.  All vectors are indexed.
* Rerank.  Candidates are scored on the original vectors.  A first round opens one bucket a table; its
  k-th score bounds what the second round, all other probes, needs to report.
* A query that meets fewer than k candidates is sent to every bucket of the first table, which is
  an exact search.

Equal vectors are one *class* with its smallest k + 1 ids (no more can be among the k nearest of any
query), so a vector that fills a third of the table is one row, and its queries are answered once.
Buckets with more than ``CHUNK`` members are cut into chunks, and their queries into blocks, so a
task holds one chunk and one block.

Edge cases: vectors that are null, zero, hold null or non-finite components, have a squared norm
beyond a double, or a null id take no part; shorter vectors count as padded with zeros; rows that
share an id are rows of their own, and a query leaves out just itself; ties go to the smaller id;
fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches
from .topk import usable

TABLES = 2
OCCUPANCY = 512
CHUNK = 512
QUERY_BLOCK = 2048
SAMPLE = 256
TARGET = 0.96
#: Combined buckets that a query ranks in a table with several hashes.
POOL = 1 << 16
ROUNDS = 3
SEED = 20
#: Products are compared with a bound from another round up to rounding.
SLACK = 1e-9


# ---------------------------------------------------------------- hashing

def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row (a power of two of columns)."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """The hashes of all tables: ``axes`` lists the axes of each hash of a table."""

    def __init__(self, dim: int, axes: list[int], tables: int = TABLES, seed: int = SEED):
        self.dim, self.axes, self.tables = dim, axes, tables
        self.width = 1 << max(0, dim).bit_length()  # room for one more coordinate
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, len(axes), ROUNDS, self.width))
        self.buckets = int(np.prod([2 * a for a in axes]))

    def coordinates(self, rows: np.ndarray, table: int) -> list[np.ndarray]:
        """Along the signed axes of each hash: 2 * axes columns."""
        x = np.zeros((len(rows), self.width))
        x[:, :rows.shape[1]] = rows
        out = []
        for k, axes in enumerate(self.axes):
            y = x
            for signs in self.signs[table, k]:
                y = hadamard(y * signs)
            out.append(np.hstack([y[:, :axes], -y[:, :axes]]))
        return out

    def bucket(self, rows: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int64)
        for y in self.coordinates(rows, table):
            out = out * y.shape[1] + y.argmax(axis=1)
        return out

    def probes(self, rows: np.ndarray, table: int, n: int) -> np.ndarray:
        """The first n buckets of each row, best first."""
        score, code = np.zeros((len(rows), 1)), np.zeros((len(rows), 1), dtype=np.int64)
        for y in self.coordinates(rows, table):
            score = (score[:, :, None] + y[:, None, :]).reshape(len(rows), -1)
            code = (code[:, :, None] * y.shape[1] + np.arange(y.shape[1])).reshape(len(rows), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :max(POOL, n)]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
        return code[:, :n]


def hash_axes(rows: int, dim: int, occupancy: int = OCCUPANCY) -> list[int]:
    """Axes of each hash of a table so that a bucket has about ``occupancy`` of ``rows``; the first
    hash is a whole cross-polytope over at least the vectors' dimension."""
    full = 1 << max(0, dim - 1).bit_length()
    axes, left = [full], rows / occupancy / (2 * full)
    while left > 1:
        axes.append(min(full, 1 << max(0, int(np.ceil(np.log2(left))) - 1)))
        left /= 2 * axes[-1]
    return axes


# ---------------------------------------------------------------- vectors as bytes

def padded(lists: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float) + 0.0
    for k, v in enumerate(lists.to_pylist()):
        out[k, :len(v)] = v
    return out + 0.0  # no negative zeros


def encode(rows: np.ndarray) -> list[bytes]:
    """A row as 32-bit floats where they hold it exactly, else as doubles."""
    with np.errstate(over="ignore"):
        short = rows.astype("<f4")
    fits = (short == rows).all(axis=1)
    return [a.tobytes() if s else b.tobytes() for a, b, s in zip(short, rows.astype("<f8"), fits)]


def decode(cells: list[bytes], dim: int) -> np.ndarray:
    if not cells:
        return np.zeros((0, dim))
    if all(len(c) == 4 * dim for c in cells):
        return np.frombuffer(b"".join(cells), dtype="<f4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(c, dtype="<f4" if len(c) == 4 * dim else "<f8").astype(np.float64) for c in cells])


def lifted(rows: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.maximum(0.0, norm2 - (rows ** 2).sum(axis=1)))[:, None]])


def products(queries: np.ndarray, rows: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of chosen pairs, summed the same way wherever a pair meets."""
    return (queries[at[0]] * rows[at[1]]).sum(axis=1)


# ---------------------------------------------------------------- search

def vector_rows(vectors: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(padded(batch.column(1), dim)), pa.binary())],
                                             names=["vec_id", "vec"])

    return vectors.mapInArrow(run, "vec_id long, vec binary")


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """(class, vec, ids): equal vectors with their smallest k + 1 ids, ascending."""
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    return (rows.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
            .groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
            .withColumn("class", F.monotonically_increasing_id()))


def exact_sample(classes: DataFrame, sample: list[tuple[int, bytes]], dim: int, k: int) -> dict[int, list[bytes]]:
    """True neighbours (vectors of the k best classes besides its own) of a bounded sample, in one pass."""
    shared = classes.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = decode([v for _, v in shared.value], dim)
        score, found = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(1).to_pylist()
            new = queries @ decode(cells, dim).T
            new[np.array([c for c, _ in shared.value])[:, None] == batch.column(0).to_numpy()[None]] = -np.inf
            best = np.argsort(-new, axis=1)[:, :k]
            score = np.hstack([score, np.take_along_axis(new, best, 1)])
            found = np.hstack([found, np.array(cells, dtype=object)[best]])
            best = np.argsort(-score, axis=1)[:, :k]
            score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        n = score.shape[1]
        own = np.repeat([c for c, _ in shared.value], n)
        keep = np.isfinite(score.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[keep], pa.int64()), pa.array(score.ravel()[keep], pa.float64()),
             pa.array(list(found.ravel()[keep]), pa.binary())], names=["query", "score", "vec"])

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec")
    rows = (classes.select("class", "vec").mapInArrow(run, "query long, score double, vec binary")
            .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).collect())
    out: dict[int, list[bytes]] = {}
    for r in rows:
        out.setdefault(r.query, []).append(bytes(r.vec))
    return out


def fit_probes(hashes: CrossPolytope, sample: list[tuple[int, bytes]], truth: dict[int, list[bytes]],
               norm2: float, target: float = TARGET) -> int:
    """Probes a table that find ``target`` of the sample's true neighbours (at most all buckets)."""
    most = min(hashes.buckets, POOL)
    need: list[int] = []
    for own, vec in sample:
        near = truth.get(own, [])
        if not near:
            continue
        points = lifted(decode(near, hashes.dim), norm2)
        first = np.full(len(near), most)
        for t in range(hashes.tables):
            order = hashes.probes(decode([vec], hashes.dim), t, most)[0]
            place = np.full(hashes.buckets, most) if hashes.buckets <= POOL else None
            buckets = hashes.bucket(points, t)
            if place is not None:
                place[order] = np.arange(len(order))
                at = place[buckets]
            else:
                sorter = np.argsort(order)
                x = np.clip(np.searchsorted(order, buckets, sorter=sorter), 0, len(order) - 1)
                at = np.where(order[sorter[x]] == buckets, sorter[x], most)
            first = np.minimum(first, at)
        need += first.tolist()
    if not need:
        return 1
    need.sort()
    return min(most, need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)] + 1)


def score_cells(routed: DataFrame, points: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, class, score) of each query's best k + 1 classes in every cell it is sent to, down to its bound.

    Both sides have the columns ``cell``, ``chunk`` and ``block``; ``routed`` adds (query, vec, bound), ``points``
    (class, first_id, vec)."""
    schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("first_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, part: pa.Table) -> pa.Table:
        if not queries.num_rows or not part.num_rows:
            return schema.empty_table()
        rows = decode(part.column("vec").to_pylist(), dim)
        number, first = part.column("class").to_numpy(), part.column("first_id").to_numpy()
        own, bound = queries.column("query").to_numpy(), queries.column("bound").to_numpy()
        vecs = queries.column("vec").to_pylist()
        out = []
        for at in range(0, len(own), 256):
            q = decode(vecs[at:at + 256], dim)
            score = q @ rows.T
            low = bound[at:at + 256]
            if len(rows) > k + 1:
                low = np.maximum(low, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
            pairs = np.nonzero(score >= (low - SLACK * np.abs(low))[:, None])
            out.append((own[at + pairs[0]], number[pairs[1]], first[pairs[1]], products(q, rows, pairs)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    keys = ["cell", "chunk", "block"]
    return routed.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(
        run, "query long, class long, first_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, chunk: int = CHUNK,
            target: float = TARGET, occupancy: int = OCCUPANCY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (a condition on
    ``vec_id``) holds, among all other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & usable("embedding"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    raw = raw.withColumn("_s", squares).filter((F.col("_s") > 0) & (F.col("_s") < F.lit(float("inf"))))
    facts = raw.agg(F.max("_s").alias("norm2"), F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"),
                    F.sum(is_query.cast("long")).alias("queries")).first()
    if not facts.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, norm2 = facts.dim, facts.norm2
    rows = save(vector_rows(raw.select("vec_id", "embedding"), dim), "vectors")
    classes = save(vector_classes(rows, k), "classes")
    asking = save(rows.filter(is_query).join(classes.select("vec", "class"), "vec")
                  .select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")), "asking")
    queries = save(asking.select("query").distinct().join(classes.select(F.col("class").alias("query"), "vec"), "query"), "queries")

    hashes = CrossPolytope(dim, hash_axes(facts.n, dim, occupancy), tables)
    sample = [(r.query, bytes(r.vec)) for r in queries.orderBy(F.xxhash64("vec"), "query").limit(SAMPLE).collect()]
    probes = fit_probes(hashes, sample, exact_sample(classes, sample, dim, k), norm2, target)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class once a table, at its bucket."""
        for batch in batches:
            if batch.num_rows:
                x = lifted(decode(batch.column("vec").to_pylist(), dim), norm2)
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.bucket(x, t) * hashes.tables + t), *batch.columns], names=["cell", "class", "first_id", "vec"])

    points = save(classes.select("class", F.element_at("ids", 1).alias("first_id"), "vec")
                  .mapInArrow(bucket, "cell long, class long, first_id long, vec binary"), "points")

    def route(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = decode(batch.column("vec").to_pylist(), dim)
                    for t in range(hashes.tables):
                        cells = hashes.probes(x, t, last)[:, first:] * hashes.tables + t
                        who = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cells.ravel()), *[c.take(who) for c in batch.columns]], names=["cell", *batch.schema.names])
        return run

    def meet(routed: DataFrame) -> DataFrame:
        """Cuts hot cells on both sides, then scores."""
        held = points.groupBy("cell").agg(F.count("*").alias("p"))
        asked = routed.groupBy("cell").agg(F.count("*").alias("q"))
        cut = save(held.join(asked, "cell").select("cell", F.ceil(F.col("p") / chunk).cast("int").alias("chunks"),
                                                   F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("blocks"))
                   .filter("chunks > 1 or blocks > 1"), "cut_cells")

        def dealt(df: DataFrame, mine: str, n: str, other: str, m: str, key: str) -> DataFrame:
            every = F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1)
            return (df.join(cut, "cell", "left")
                    .withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int"))
                    .withColumn(other, F.explode(every)).drop("chunks", "blocks"))

        return score_cells(dealt(routed, "block", "blocks", "chunk", "chunks", "query"),
                           dealt(points, "chunk", "chunks", "block", "blocks", "class"), dim, k)

    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "first_id", "class")

    def best(found: DataFrame) -> DataFrame:
        """The k + 1 best distinct classes of each query."""
        return (found.groupBy("query", "class", "first_id").agg(F.max("score").alias("score"))
                .withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1))

    unbounded = queries.withColumn("bound", F.lit(float("-inf")))
    seeds = save(best(meet(save(unbounded.mapInArrow(route(0, 1), f"cell long, {_fields(unbounded)}"), "seed_routes"))), "seeds")
    limit = seeds.filter(F.col("n") == k + 1).select("query", F.col("score").alias("_b"))
    bounded = save(queries.join(limit, "query", "left")
                   .select("query", "vec", F.coalesce("_b", F.lit(float("-inf"))).alias("bound")), "bounded")
    found = seeds.drop("n")
    if probes > 1:
        routes = save(bounded.mapInArrow(route(1, probes), f"cell long, {_fields(bounded)}"), "routes")
        found = found.unionByName(meet(routes).select(*found.columns))
    found = save(best(found), "found")

    def answers(found: DataFrame) -> DataFrame:
        """(query, near): the k + 1 nearest rows of each query class."""
        members = found.select("query", "class", "score").join(classes.select("class", "ids"), "class") \
            .select("query", "score", (F.col("query") == F.col("class")).alias("own"), F.explode("ids").alias("vec_id"))
        ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc())
        return (members.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= k + 1)
                .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("near")))

    near = save(answers(found), "near")
    # Every row that could be a candidate counts, the query's own row too.
    enough = min(k + 1, facts.n)
    lacking = queries.join(near.filter(F.size("near") >= enough).select("query"), "query", "left_anti")
    lacking = save(lacking, "lacking")
    if lacking.limit(1).count():
        everywhere = lacking.withColumn("bound", F.lit(float("-inf"))).select(
            (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes.buckets - 1).cast("long"))) * hashes.tables).alias("cell"),
            "query", "vec", "bound")
        more = save(answers(best(meet(everywhere))), "near_exact")
        near = near.join(lacking.select("query"), "query", "left_anti").unionByName(more)

    mine = F.filter("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id")))
    others = F.slice(F.filter("near", lambda x: F.coalesce(x["n"] != F.get(F.col("mine"), 0)["n"], F.lit(True))), 1, k)
    return (asking.join(near, "query").withColumn("mine", mine)
            .select("query_id", F.posexplode(others).alias("rank", "hit"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.col("hit.score").alias("score")))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)
