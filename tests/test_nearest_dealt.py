"""How chunks and queries are dealt to tasks, and scores whose weights aren't whole numbers."""

import random
from collections import defaultdict

from briefmill.operators import nearest, retrieval
from test_nearest import best, got


def test_large_scopes_have_blocks_of_their_own(spark):
    """Ordinals far apart, as of many documents: a block has chunks of two scopes at most, so it hands on few rows."""
    rows = [(f"s{i % 4}", i * 100_000, [1.0, float(i)]) for i in range(800)] + [(None, 7, [1.0, 1.0]), ("small", 8, [1.0, 1.0])]
    blocks = nearest.dense_blocks(spark.createDataFrame(rows, "scope string, ordinal long, dense array<double>"), 100).collect()
    assert sum(len(b["rows"]) for b in blocks) == len(rows)
    assert all(len({r["scope"] for r in b["rows"]} & {"s0", "s1", "s2", "s3"}) <= 2 for b in blocks)
    assert max(len(b["rows"]) for b in blocks) < 200


def test_meetings_are_dealt_to_tasks(spark):
    """One bundle of queries still meets the blocks in many tasks, however few bytes they have."""
    rows = [("s", i, [1.0, float(i)]) for i in range(400)]
    blocks = nearest.dense_blocks(spark.createDataFrame(rows, "scope string, ordinal long, dense array<double>"), 20)
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(5)], "query_id long, dense array<double>")
    parts = nearest._meetings(asked, blocks, 256).rdd.glom().map(len).collect()
    assert sum(parts) == 20 and sum(n > 0 for n in parts) >= 8


def test_weights_that_are_not_whole(spark):
    rng = random.Random(8)
    bags = [("ab"[i % 2], i, {f"t{rng.randint(0, 30)}": rng.randint(1, 9) / 4 for _ in range(8)}) for i in range(300)]
    weights = spark.createDataFrame([(s, o, t, w) for s, o, b in bags for t, w in b.items()], "scope string, ordinal long, token string, weight double")
    asked = {q: {f"t{rng.randint(0, 30)}": rng.randint(1, 9) / 2 for _ in range(4)} for q in range(6)}
    score = {(q, s, o): sum(w * b[t] for t, w in a.items() if t in b) for q, a in asked.items() for s, o, b in bags if set(a) & set(b)}
    queries = spark.createDataFrame([(q, t, w) for q, a in asked.items() for t, w in a.items()], "query_id long, token string, weight double")
    assert got(nearest.sparse_nearest(queries, nearest.sparse_blocks(weights, 90), 5), "sparse_score", "sparse_rank") == best(score, 5)


def test_bags_and_postings(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "ordinal long, tokens array<string>")
    bags = retrieval.bags(rows, "ordinal")
    found = {r["ordinal"]: dict(zip(r["tokens"], r["weights"], strict=True)) for r in bags.collect()}
    assert found == {1: {"a": 2.0, "b": 1.0}, 2: {"b": 1.0}}
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (8, "b"), (9, "c")], "query_id long, token string")
    assert {r["query_id"]: r["all"] for r in nearest.postings_of(asked, bags).collect()} == {7: 3, 8: 2}
    dense = defaultdict(list, {r["ordinal"]: r["dense"] for r in retrieval.hashed_vectors(rows, "ordinal").collect()})
    assert sorted(dense) == [1, 2] and sum(dense[1]) == 3.0 and len(dense[2]) == retrieval.DIMENSIONS
