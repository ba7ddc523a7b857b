"""Connected components of an edge table by repeated star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

#: So few edges one task can hold; more go on in rounds.
ONE_TASK_EDGES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a partition, an edge from each node to the least node it is connected with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    tops = np.fromiter((root(x) for x in list(parent)), np.int64, len(parent))
    away = nodes != tops
    for i in range(0, int(away.sum()), 50_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[away][i : i + 50_000]), pa.array(tops[away][i : i + 50_000])], ["a", "b"]
        )


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # large star: each node's larger neighbours go to its least one
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    # small star: each node and its smaller neighbours go to the least of them
    ordered = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ordered.groupBy("a").agg(F.min("b").alias("m"))
    small = ordered.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, root (the least node) of every node of edges (a, b: long) but the roots themselves."""
    now = materialize(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    n = now.count()
    while n > one_task:
        nxt = materialize(_star(now), "edges")
        if nxt.count() == n and nxt.exceptAll(now).isEmpty():
            break
        now, n = nxt, nxt.count()
    else:
        now = now.coalesce(1).mapInArrow(_forest, "a long, b long")
    return materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
