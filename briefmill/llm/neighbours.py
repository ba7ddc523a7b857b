"""Approximate nearest neighbours by collision counting.

A largest inner product becomes a smallest distance once every vector has one coordinate more that brings it to the
greatest length, so blocks hold vectors of like length: few long ones would make all others look alike. The index
hashes each vector with single random projections and keeps each projection's values sorted, block by block of vectors. A query opens a window around its own value in each sorted array, and virtual
rehashing widens all windows together; a widening reads only what enters. As soon as enough vectors have collided in a
threshold of the projections, those are verified with exact inner products. Blocks of queries meet blocks of vectors by
an equality join, and only the best k of each meeting move on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

#: Projections at most, drawn as orthogonal bases, and the part of them in which a vector must collide.
PROJECTIONS, THRESHOLD = 130, 0.85
#: The first radius of virtual rehashing, in lengths of the longest vector, and how much each next one is wider.
RADIUS, WIDER = 1.7, 1.04
#: The part of a block that must have collided before vectors are first verified; 4 * k vectors at least. Windows go on
#: widening until GROW times as many verified vectors bring the best k nothing nearer.
VERIFIED, GROW = 0.03, 1.3
BLOCK, QUERY_BLOCK = 8192, 512
#: Classes of length for each doubling; vectors of a class are dealt to blocks of their own.
LENGTHS = 2


def usable(vectors: DataFrame) -> DataFrame:
    """id and vector (doubles) of the vectors that can take part: not null, not all zero, no null, infinite or NaN parts. A
    null id takes no part; of rows that repeat an id the least vector does."""
    v = F.transform("vector", lambda x: x.cast("double"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    known = vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & some)
    return known.select("id", v.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64)


def projections(dimensions: int, seed: int) -> np.ndarray:
    """A column for each projection: random orthogonal bases, each vector as long as a normal one is on average."""
    rng, bases = np.random.default_rng(seed), []
    for _ in range(-(-PROJECTIONS // dimensions)):
        q, r = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
        bases.append(q * np.sign(np.diag(r)) * np.sqrt(dimensions))
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS]


def build(vectors: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """The index: a row for each block of vectors, holding ids, vectors, and each projection's sorted values and order."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # lengths that a double can't hold are classes of their own
    kind = F.when((length > 0) & (length < float("inf")), F.floor(F.log2(length) * LENGTHS)).otherwise(F.when(length > 0, F.lit(1 << 20)).otherwise(F.lit(-(1 << 20))))
    sized = vectors.withColumn("_kind", kind.cast("int"))
    first, deal = 0, []
    for r in sorted(sized.groupBy("_kind").count().collect()):  # a few thousand classes at most, by the range of doubles
        many = max(1, -(-r["count"] // block))
        deal.append((r["_kind"], first, many))
        first += many
    deal = vectors.sparkSession.createDataFrame(deal, "_kind int, _first int, _many int")

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        x = _matrix(rows["vector"])
        scaled = x / np.abs(x).max()  # so that squares stay within doubles
        square = (scaled**2).sum(axis=1)
        last = np.sqrt(np.maximum(square.max() - square, 0.0))
        a = projections(x.shape[1] + 1, seed)
        values = (scaled @ a[:-1] + last[:, None] * a[-1]) / np.sqrt(square.max())
        order = np.argsort(values, axis=0, kind="stable").T.astype(np.uint16 if len(rows) <= 1 << 16 else np.int32)
        ranked = np.take_along_axis(values.T, order.astype(np.int64), axis=1)
        return pd.DataFrame({
            "block": [int(rows["block"].iloc[0])], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
            "ranked": [ranked.tobytes()], "places": [order.tobytes()],
        })

    block_of = F.col("_first") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("_many")).cast("int")
    dealt = sized.join(F.broadcast(deal), "_kind").select("id", "vector", block_of.alias("block"))
    return dealt.groupBy("block").applyInPandas(index, "block int, ids binary, vectors binary, ranked binary, places binary")


class Windows:
    """Windows of one block's sorted arrays around the values of queries, which widen together."""

    def __init__(self, ranked: np.ndarray, places: np.ndarray, at: np.ndarray):
        """ranked, places: each projection's values in order, and whose they are; at: each query's values."""
        self.ranked, self.places, self.at = ranked, places, at
        self.projections, self.n = ranked.shape
        self.need = int(np.ceil(THRESHOLD * self.projections))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_step(self, step: int, query: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the query's windows begin and end after so many widenings; found for all queries at once."""
        if step not in self.windows:
            radius = RADIUS * WIDER**step
            low = [np.searchsorted(r, x - radius, "left") for r, x in zip(self.ranked, self.at.T, strict=True)]
            high = [np.searchsorted(r, x + radius, "right") for r, x in zip(self.ranked, self.at.T, strict=True)]
            self.windows[step] = np.array(low, np.int32).T.copy(), np.array(high, np.int32).T.copy()
        low, high = self.windows[step]
        return low[query], high[query]

    def _count(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each vector stands in places[j][begin[j]:end[j]]."""
        parts = [p[a:b] for p, a, b in zip(self.places, begin.tolist(), end.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def collided(self, query: int, wanted: int) -> Iterator[np.ndarray]:
        """Places of the vectors whose collisions reach the threshold, at the first radius with `wanted` of them, then at the
        first with GROW times as many as there were, and so on until all have collided."""
        low, high = self.at_step(0, query)
        if 2 * int((high - low).sum()) > self.n * self.projections:  # fewer stand outside
            out = self._count(np.zeros_like(low), low) + self._count(high, np.full_like(high, self.n))
            count = self.projections - out
        else:
            count = self._count(low, high)
        step = 0
        while True:
            while len(found := np.flatnonzero(count >= self.need)) < min(wanted, self.n):
                step += 1
                below, above = self.at_step(step, query)
                count += self._count(below, low) + self._count(high, above)  # what enters
                low, high = below, above
            yield found
            if len(found) == self.n:
                return
            wanted = int(GROW * len(found)) + 1


def search(queries: DataFrame, vectors: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), id, score: for each query (id, vector) its k vectors of largest inner product found.

    A vector with the query's own id is no candidate. Ties go to the smaller id. Vectors that are null, zero or hold
    null or non-finite parts, or whose id is null, take no part on either side; rows that repeat an id are one vector, the
    least of them. Fewer than k candidates are all returned. Vectors of one call have one dimension. An empty table gives
    an empty result. Columns besides id and vector are not read.
    """
    base = materialize(usable(vectors), "vectors")
    asked = usable(queries)
    if base.isEmpty():
        return asked.limit(0).select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id"), F.lit(0.0).alias("score")
        )
    index = materialize(build(base, seed), "index")
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERY_BLOCK))
    bundle = asked.withColumn("bundle", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["id"].to_numpy(np.int64), _matrix(rows["vector"])
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        return pd.DataFrame({"q_ids": [ids.tobytes()], "q_vectors": [x.tobytes()]})

    bundles = bundle.groupBy("bundle").applyInPandas(pack, "q_ids binary, q_vectors binary")
    last = index.agg(F.max("block")).first()[0]
    meets = bundles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids, q_ids = np.frombuffer(get["ids"], np.int64), np.frombuffer(get["q_ids"], np.int64)
                x = np.frombuffer(get["vectors"], np.float64).reshape(len(ids), -1)
                q = np.frombuffer(get["q_vectors"], np.float64).reshape(len(q_ids), -1)
                ranked = np.frombuffer(get["ranked"], np.float64).reshape(PROJECTIONS, -1)
                kind = np.uint16 if len(ids) <= 1 << 16 else np.int32
                places = np.frombuffer(get["places"], kind).reshape(PROJECTIONS, -1)
                a = projections(x.shape[1] + 1, seed)
                at = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ a[:-1]
                wanted = max(4 * k, int(np.ceil(VERIFIED * len(ids))))
                out, windows = [], Windows(ranked, places, at)
                for i in range(len(q_ids)):
                    before = None
                    for near in windows.collided(i, wanted):
                        near = near[ids[near] != q_ids[i]]
                        score = (x[near] * q[i]).sum(axis=1)  # each row summed in the same order, so equal vectors have equal scores
                        best = np.lexsort((ids[near], -score))[:k]
                        if before is not None and np.array_equal(near[best], before):
                            break  # more have brought nothing nearer
                        before = near[best]
                    out.append((np.full(len(best), q_ids[i]), ids[near][best], score[best]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "score"]
                )

    found = meets.join(index, "block").drop("block", "bundle").mapInArrow(meet, "query_id long, id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
