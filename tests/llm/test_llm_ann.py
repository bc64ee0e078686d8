import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x for x in v)


def brute(rows, is_query, k):
    """(query_id, rank, vec_id, score) by the definition; rows are told apart by their place."""
    dim = max((len(v) for _, v in rows if v), default=0)
    use = [(i, np.array([float(np.float32(x)) for x in v] + [0.0] * (dim - len(v)))) for i, v in rows if i is not None and usable(v)]
    out = []
    for n, (i, q) in enumerate(use):
        if is_query(i):
            scored = sorted((-float((q * x).sum()), j) for m, (j, x) in enumerate(use) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows],
                               "vec_id long, embedding array<float>, rank int, score string, cell int")
    got = ann.nearest(df.repartition(3), F.col("vec_id") % every == 0, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12, atol=0)


def clustered(n, dim, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return [(k, (centres[k % 12] + 0.3 * rnd.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]


def test_awkward_rows_with_all_buckets_opened_equal_brute_force(spark):
    rows = clustered(150, 8)
    rows += [(500 + k, rows[7][1]) for k in range(60)]                     # a hot vector, queries among it
    rows += [(600, rows[1][1]), (600, rows[1][1]), (600, rows[2][1])]      # an id again, also with another vector
    rows += [(700, None), (701, []), (702, [1.0, 2.0]), (703, [float("nan")] * 8), (704, [float("inf")] * 8),
             (705, [None] * 8), (None, rows[2][1]), (710, [0.0] * 8), (715, [-0.0, 3.0] + [0.0] * 6)]
    same(run(spark, rows, 5, k=5, target=1.0, chunk=16), brute(rows, lambda i: i % 5 == 0, 5))


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [3.0, -1.0]), (5, [2.0, 5.0]), (7, [1.0e9, 1.0e9]), (9, [-4.0, 2.5])]
    same(run(spark, rows, 5, k=20), brute(rows, lambda i: i % 5 == 0, 20))
    assert run(spark, [(5, [1.0])], 5, k=5) == []
    assert run(spark, [], 5, k=5) == []


@pytest.mark.parametrize("occupancy", [512, 2])
def test_recall_on_random_vectors(spark, occupancy):
    """The hardest case: no clusters.  At occupancy 2 a table has several hashes."""
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(1200, 16)).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = run(spark, rows, 20, k=20, occupancy=occupancy)
    assert len(got) == len(want)
    assert len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)


def test_index_has_every_row_once_a_table_and_probes_rank_all_buckets():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(50, 6))
    hashes = ann.CrossPolytope(6, ann.hash_axes(10_000, 6, 100))
    assert hashes.buckets >= 100
    for t in range(hashes.tables):
        order = hashes.probes(x, t, hashes.buckets)
        assert all(sorted(r) == list(range(hashes.buckets)) for r in order)
        assert (order[:, 0] == hashes.bucket(x, t)).all()


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_buckets_grow_with_the_table():
    for n in (10, 10 ** 5, 10 ** 7, 10 ** 9):
        buckets = np.prod([2 * a for a in ann.hash_axes(n, 64)])
        assert buckets >= 128 and buckets * ann.OCCUPANCY >= n and (buckets == 128 or buckets * ann.OCCUPANCY < 4 * n)
