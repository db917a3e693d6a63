"""Top-k against numpy over all pairs."""

import math

import numpy as np
import pytest

from talkmill.llm.topk import top_k
from talkmill.tables import load


def plain(rows, ids, k=10):
    out = set()
    for q in ids:
        own = next(v for i, v in rows if i == q)
        scores = sorted((-int(np.dot(own, v)), i) for i, v in rows if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_whole_table(spark):
    vectors = load(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, np.array([math.floor(1024 * float(x)) for x in r.embedding])) for r in vectors.collect()]
    got = top_k(vectors, vectors.where("vec_id % 25 = 0"), block=3, blocks=2, tile=64)
    assert {tuple(r) for r in got.collect()} == plain(rows, [i for i, _ in rows if i % 25 == 0])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [], 1), (None, [9.0, 9.0], 1), (9, [-1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in top_k(vectors, vectors.where("vec_id in (0, 3, 4, 7)"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1024 * 1024 + 512 * 512), (0, 2, 2, 1024 * 1024 + 512 * 512)]
    assert top_k(vectors.limit(0), vectors).count() == 0 and top_k(vectors, vectors.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    """Scores beyond 2**53, near ties among them; what would leave 64 bits is refused."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 18), 1 << 18, 8)
    rows = [(i, (base + rng.integers(-1, 2, 8)).astype(float).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, np.array([int(1024 * x) for x in v], object)) for i, v in rows]
    got = top_k(vectors, vectors.where("vec_id % 100 = 0"), tile=64, step=4)
    want = set()
    for q in (0, 100, 200):
        scores = sorted((-int(np.dot(whole[q][1], v)), i) for i, v in whole if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert {tuple(r) for r in got.collect()} == want and max(w[3] for w in want) > 1 << 53
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), vectors.where("vec_id = 0").selectExpr("vec_id", "slice(embedding, 1, 1) embedding"))
