"""Neighbours among equal vectors, and vectors whose lengths differ widely."""

import numpy as np
import pytest


def test_equal_vectors_score_equally_and_come_by_id(spark):
    from briefmill.llm import neighbours

    rng = np.random.default_rng(0)
    for seed in range(3):
        same, others = rng.standard_normal(64), rng.standard_normal((40, 64))
        rows = [(i, same.tolist()) for i in range(1, 8)] + [(100 + i, v.tolist()) for i, v in enumerate(others)]
        vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
        query = spark.createDataFrame([(500, (3 * same).tolist())], "id long, vector array<double>")
        got = neighbours.search(query, vectors, 7, seed=seed).orderBy("rank").collect()
        assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, 7] and len({r["score"] for r in got}) == 1


def exact(x, q, k):
    score = x @ x[q]
    score[q] = -np.inf
    return set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())


def one_long(rng):
    x = rng.standard_normal((2000, 64))
    x[17] *= 50
    return x


CASES = {"one long": one_long, "many dimensions": lambda rng: rng.standard_normal((2500, 256)), "lengths": lambda rng: rng.standard_normal((4000, 64)) * np.exp(rng.normal(0, 0.5, (4000, 1)))}


@pytest.mark.parametrize("name", CASES)
def test_recall_whatever_the_lengths(spark, name):
    from briefmill.llm import neighbours

    x = CASES[name](np.random.default_rng(1))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = {}
    for r in neighbours.search(vectors.filter("id % 50 = 0"), vectors, 20).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(exact(x, q, 20) & ids) for q, ids in found.items())
    assert len(found) == len(x) // 50 and hits >= 0.9 * 20 * len(found)


def test_lengths_beyond_doubles(spark):
    from briefmill.llm import neighbours

    rows = [(1, [1e-200, 0.0]), (2, [1e200, 1e200]), (3, [1.0, 1.0]), (4, [-1e200, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    got = neighbours.search(vectors.filter("id = 3"), vectors, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1, 4]
