"""Centroid clustering: plain Lloyd rounds over vectors of whole numbers.

Centroids are broadcast, tasks compare their vectors with each in integers, and only sums by cluster and component move,
so a cluster with most of the rows costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Whole numbers below this in size can be compared in 64 bits; vectors with larger ones are compared in Python's numbers.
PLAIN = 2**27
#: From this size on a component counts as not finite.
MOST = 2.0**62
LONG = 2**63


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id, v of the vectors (vec_id, embedding) with so many components that are all there and finite: floor(scale * x)
    of each as packed doubles, which hold these whole numbers exactly."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fine = (F.size("embedding") == dimensions) & F.forall("_x", lambda x: F.coalesce(F.abs(x) < MOST, F.lit(False)))  # NaN is above all
    rows = vectors.select("vec_id", "embedding").withColumn("_x", whole).filter(fine).select("vec_id", "_x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * dimensions))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "v"])

    return rows.mapInArrow(pack, f"vec_id {dict(vectors.dtypes)['vec_id']}, v binary")


def unpack(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dimensions)


def nearest(rows: np.ndarray, centers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows as whole numbers, each one's nearest center (of equally near ones the first) and the squared distance."""
    plain = not len(rows) or np.abs(rows).max() < PLAIN
    if plain and all(abs(x) < PLAIN for c in centers for x in c):
        whole, about = rows.astype(np.int64), np.asarray(centers, np.int64)
    else:
        whole = np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(rows.shape)
        about = np.array(centers, dtype=object)
    far = np.empty((len(rows), len(centers)), whole.dtype)
    for k, center in enumerate(about):
        step = whole - center
        far[:, k] = (step * step).sum(axis=1)
    to = far.argmin(axis=1) if len(rows) else np.empty(0, np.int64)
    return whole, to, far[np.arange(len(rows)), to]


def _center_sums(vectors: DataFrame, centers: list[list[int]], dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and component sums of each cluster that has any; clusters x components rows reach the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        sums = [[0] * dimensions for _ in at]
        many = [0] * len(at)
        for batch in batches:
            whole, to, _ = nearest(unpack(batch["v"], dimensions), at)
            for k in np.unique(to):
                inside = whole[to == k]
                many[k] += len(inside)
                sums[k] = [a + int(b) for a, b in zip(sums[k], inside.sum(axis=0), strict=True)]
        rows = [(k, i, str(s), many[k]) for k, each in enumerate(sums) if many[k] for i, s in enumerate(each)]
        yield pd.DataFrame(rows, columns=["cluster", "at", "total", "n"])

    parts = vectors.select("v").mapInPandas(partial, "cluster int, at int, total string, n long")
    merged = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in merged.collect():
        found.setdefault(r["cluster"], (r["n"], [0] * dimensions))[1][r["at"]] = int(r["total"])
    return found


def first_centers(vectors: DataFrame, clusters: int, seed: int, dimensions: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(order, "v").limit(clusters).collect()  # as many as there are clusters
    return [[int(x) for x in np.frombuffer(r["v"], "<f8")] for r in rows]


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of each vector after the rounds, and the centroids.

    Vectors (vec_id, embedding) that are null, of another number of components or with a component that is null, not finite
    or 2^62 and more after scaling take no part. Centroids start as the vectors whose `seed:vec_id` hashes lowest (a null
    vec_id hashes as nothing after the colon; equal ids are ordered by their vectors), and are fewer where vectors are. Of
    equally near centroids the first counts; equal rows are vectors of their own; a centroid without vectors stays. A
    distance that no long holds is null. An empty table gives no row and no centroid. Other columns are not read.
    """
    kept = materialize(whole_vectors(vectors, dimensions, scale), "whole_vectors")
    centers = first_centers(kept, clusters, seed, dimensions)
    for _ in range(rounds if centers else 0):
        for k, (n, sums) in _center_sums(kept, centers, dimensions).items():
            centers[k] = [s // n for s in sums]  # rounds down
    shared = kept.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, to, far = nearest(unpack(batch["v"], dimensions), shared.value)
            far = pd.Series([x if x < LONG else None for x in far.tolist()], dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": to.astype(np.int32), "distance": far})

    kind = dict(vectors.dtypes)["vec_id"]
    return kept.mapInPandas(place, f"vec_id {kind}, cluster int, distance long"), centers


def center_sha256(center: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that cluster() places. A sum of
    distances that no long holds, or that has a null among its parts, is null."""
    placed, centers = cluster(vectors, **options)
    placed = materialize(placed, "placed")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    sums = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(total).collect()}  # a row for each cluster
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda x: None if x is None or x >= LONG else int(x)
    rows = [(k, fits(s), fits(whole), center_sha256(centers[k])) for k, s in sums.items()]
    each = placed.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
