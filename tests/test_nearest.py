"""The best chunks in blocks, against all pairs in plain Python."""

import math
import random
from collections import defaultdict

import pytest

from briefmill.operators import nearest


def best(scores, most):
    """{(query, scope): [(ordinal, score), ...]} from (query, scope, ordinal) -> score."""
    found = defaultdict(list)
    for (q, s, o), v in scores.items():
        found[q, s].append((-v, o))
    return {k: [(o, -v) for v, o in sorted(rows)[:most]] for k, rows in found.items()}


def got(rows, score, rank):
    found = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r[rank]):
        assert r[rank] == len(found[r["query_id"], r["scope"]])
        found[r["query_id"], r["scope"]].append((r["ordinal"], r[score]))
    return found


def scope_of(rng):
    """One scope has most chunks, many have a few, and one is null."""
    return "large" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"s{rng.randint(0, 30)}"


@pytest.mark.parametrize(("block", "bundle"), [(4096, 256), (50, 4)])
def test_dense(spark, block, bundle):
    rng = random.Random(4)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(6)]  # ties are many
    chunks = [(scope_of(rng), i, vector()) for i in range(400)] + [("large", 900, None), ("large", 901, [0.0] * 6)]
    queries = [(f"q{i}", vector()) for i in range(20)] + [("zero", [0.0] * 6), ("null", None)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cosine = lambda a, b: dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))
    want = best({(q, s, o): cosine(a, b) for q, a in queries for s, o, b in chunks if a and b and any(a) and any(b)}, 5)
    blocks = nearest.dense_blocks(spark.createDataFrame(chunks, "scope string, ordinal long, dense array<double>").repartition(3), block)
    asked = spark.createDataFrame(queries, "query_id string, dense array<double>")
    assert got(nearest.dense_nearest(asked, blocks, 5, bundle=bundle), "dense_score", "dense_rank") == want
    large = got(nearest.dense_nearest(asked, nearest.of_scope(blocks, "large"), 5, digits=12), "dense_score", "dense_rank")
    assert {k: [o for o, _ in v] for k, v in large.items()} == {k: [o for o, _ in v] for k, v in want.items() if k[1] == "large"}


@pytest.mark.parametrize(("block", "bundle", "run"), [(4096, 256, 8), (60, 4, 3), (4096, 256, 1)])
def test_sparse(spark, block, bundle, run):
    """Chunks speak one of four languages, as it were: a query in one bounds away the runs of the others."""
    rng = random.Random(6)
    words = [[f"{lang}{i}" for i in range(40)] for lang in "abcd"]
    common = lambda lang: words[lang][min(int(rng.expovariate(0.15)), 39)]
    chunks, weights = [], []
    for i in range(600):
        scope, lang, bag = scope_of(rng), rng.randint(0, 3), defaultdict(float)
        for _ in range(rng.randint(0, 30)):
            bag[common(lang)] += 1.0
        chunks.append((scope, i, dict(bag)))
        weights += [(scope, i, t, w) for t, w in bag.items()]
    weights += [("large", 0, "x", 0.0), ("large", 1, "x", -1.0)]
    queries = [(q, t, float(rng.randint(1, 3))) for q in range(25) for t in sorted({common(q % 4) for _ in range(6)})] + [(99, "nowhere", 1.0), (98, "x", 1.0)]
    bag = defaultdict(dict)
    for q, t, w in queries:
        bag[q][t] = w
    score = lambda a, b: sum(w * b[t] for t, w in a.items() if t in b)
    want = best({(q, s, o): score(a, b) for q, a in bag.items() for s, o, b in chunks if set(a) & set(b)}, 7)
    blocks = nearest.sparse_blocks(spark.createDataFrame(weights, "scope string, ordinal long, token string, weight double").repartition(3), block)
    asked = spark.createDataFrame(queries, "query_id long, token string, weight double")
    assert got(nearest.sparse_nearest(asked, blocks, 7, run, bundle), "sparse_score", "sparse_rank") == want
    read = nearest.postings_read(asked, blocks, 2, run, bundle).collect()
    every = {q: sum(t in b for t in a for _, _, b in chunks) for q, a in bag.items()}
    assert {r["query_id"]: r["all"] for r in read if r["all"]} == {q: n for q, n in every.items() if n}
    if block > 600:  # the large scope alone, where there is something to leave out
        read = nearest.postings_read(asked, nearest.of_scope(blocks, "large"), 2, run, bundle).collect()
        assert sum(r["read"] for r in read) < (0.3 if run == 1 else 0.9) * sum(r["all"] for r in read)


def test_nothing(spark):
    none = nearest.dense_blocks(spark.createDataFrame([], "scope string, ordinal long, dense array<double>"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, dense array<double>")
    assert nearest.dense_nearest(asked, none, 3).collect() == [] and nearest.dense_nearest(asked.limit(0), none, 3).collect() == []
    none = nearest.sparse_blocks(spark.createDataFrame([], "scope string, ordinal long, token string, weight double"))
    asked = spark.createDataFrame([(1, "t", 1.0)], "query_id long, token string, weight double")
    assert nearest.sparse_nearest(asked, none, 3).collect() == [] and nearest.postings_read(asked, none, 3).collect() == []
