"""Ids of equal vectors."""

import numpy as np

from veilstone.llm import hnsw


def test_own_id_repeated_often_hides_no_equal_vector():
    own, starts = np.array([[1.0, 2.0], [2.0, 1.0]]), np.array([0, 40, 41])
    ids = np.array([*[50] * 30, *range(51, 61), 7])
    got = hnsw._best(ids, starts, np.array([0, 1, 2]), own, [0, 1], own[0], 50, 5)
    assert [i for _, i in got] == [51, 52, 53, 54, 55]
    mixed = np.array([3, 4, *[50] * 28, *range(51, 61), 7])
    assert [i for _, i in hnsw._best(mixed, starts, np.array([0, 1, 2]), own, [0, 1], own[0], 50, 5)] == [3, 4, 51, 52, 53]


def test_parallel_vectors_are_one_direction(spark):
    """600 multiples of one vector: all cosines are 1 but for rounding, and the exact order of scores and ids decides."""
    rng = np.random.default_rng(3)
    base, others = rng.normal(size=16), rng.normal(size=(800, 16))
    rows = [(i, (base * f).tolist()) for i, f in enumerate([*(2.0**e for e in range(-150, 150)), *rng.uniform(0.1, 9, 300)])] + [(1000 + i, v.tolist()) for i, v in enumerate(others)]
    found = hnsw.nearest(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")).where("query_id < 600").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for query in range(0, 600, 50):
        scores = hnsw.cosine(x, x[query])
        want = sorted(((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != query))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)] == want
