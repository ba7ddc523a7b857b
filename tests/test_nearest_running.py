"""A task hands on the best of all the blocks that a bundle meets in it, not of each block."""

from briefmill.operators import nearest
from test_nearest import best, got


def _tables(spark, n=600):
    rows = [("ab"[i % 2] if i % 5 else None, i, [1.0, float(i % 97), float(i * i % 89)]) for i in range(n)]
    asked = [(q, [1.0, float(q * 7 % 83), float(q * q % 61)]) for q in range(40)]
    return rows, asked, spark.createDataFrame(rows, "scope string, ordinal long, dense array<double>"), spark.createDataFrame(asked, "query_id long, dense array<double>")


def test_rows_handed_on(spark, monkeypatch):
    """Three scopes in 30 blocks and four shares: before, each block handed on its own best."""
    monkeypatch.setattr(nearest, "TASKS", 1)
    _, _, chunks, asked = _tables(spark)
    meetings = nearest._meetings(asked, nearest.dense_blocks(chunks, 20), 1024)
    assert nearest._search(meetings, "dense", 3, 12, nearest.RUN, False).count() <= 40 * 3 * (3 + 4)


def test_results_when_little_is_held(spark, monkeypatch):
    rows, asked, chunks, queries = _tables(spark)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 12)
    want = best({(q, s, o): cos(v, d) for q, v in asked for s, o, d in rows}, 3)
    for held in (1 << 22, 10):
        monkeypatch.setattr(nearest, "HELD", held)
        assert got(nearest.dense_nearest(queries, nearest.dense_blocks(chunks, 20), 3, digits=12, bundle=7), "dense_score", "dense_rank") == want
