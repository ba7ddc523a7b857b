"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over the words of a text and their beginnings; each
model also gets the probabilities of the categories before it. In training those are out-of-fold predictions, so that
a later model doesn't rely on probabilities that are better than they will be on new texts. The models are fitted on a
bounded sample of labelled rows (MOST_ROWS); every row is scored, over its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import give_back, materialize

#: Labelled rows that the models are fitted on at most, and features that a model has at most.
MOST_ROWS, MOST_FEATURES = 8000, 6000
LEAST_ROWS_OF_FEATURE, PREFIXES, FOLDS, PENALTY = 4, (4, 5, 6), 3, 0.3
EDGES = b".,;:!?\"'()[]{}*#$%&<>-_"


def default_categories() -> dict[str, Column]:
    """The chain's categories in order, as conditions on the columns of labels; the last decides."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


class Features:
    """Hashed features of texts: words without case and punctuation around them, and their first characters."""

    #: Words whose features are held at once, each with a few numbers.
    LIMIT = 100_000

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.of = known, {}

    def _word(self, raw: bytes) -> tuple[int, ...]:
        w = raw.strip(EDGES)
        if not w:
            return ()
        names = [b"w" + w]
        text = w.decode("utf-8", "replace")
        names += [b"p" + text[:n].encode("utf-8", "replace") for n in PREFIXES if len(text) >= n]
        ids = [zlib.crc32(x) for x in names]
        return tuple(ids) if self.known is None else tuple(self.known[i] for i in ids if i in self.known)

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.of) > self.LIMIT:
            self.of.clear()
        got, of = set(), self.of
        for w in set((text or "").lower().encode("utf-8", "replace").split()):
            ids = of.get(w)
            if ids is None:
                ids = of[w] = self._word(w)
            if ids:
                got.update(ids)
        return np.fromiter(sorted(got), np.uint32, len(got))


@dataclass
class Rows:
    """Binary features of texts: the places of row i in `ids` are places[starts[i]:starts[i + 1]]."""

    ids: np.ndarray
    places: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(starts[-1], dtype=np.int32) + np.repeat(self.starts[:-1][rows] - starts[:-1], size).astype(np.int32)
        return Rows(self.ids, self.places[at], starts)

    def only(self, ids: np.ndarray) -> Rows:
        """The same rows with no features but ids (sorted)."""
        new = np.searchsorted(ids, self.ids).astype(np.int32)
        new[new == len(ids)] = 0
        known = ids[new] == self.ids if len(ids) else np.zeros(len(self.ids), bool)
        hit = known[self.places]
        before = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        return Rows(ids, new[self.places[hit]], before[self.starts].astype(np.int64))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.places])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def counts(self, of_row: np.ndarray) -> np.ndarray:
        """For each feature the sum of of_row over the rows that have it."""
        return np.bincount(self.places, weights=np.repeat(of_row, np.diff(self.starts)), minlength=len(self.ids))


def gather(hashes: np.ndarray, starts: np.ndarray) -> Rows:
    """Rows of hashed features, without those that fewer than LEAST_ROWS_OF_FEATURE rows have."""
    ids, count = np.unique(hashes, return_counts=True)
    every = ids[count >= LEAST_ROWS_OF_FEATURE]
    place = np.minimum(np.searchsorted(every, hashes), max(0, len(every) - 1)).astype(np.int32)
    hit = every[place] == hashes if len(every) else np.zeros(len(hashes), bool)
    before = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    return Rows(every, place[hit], before[starts].astype(np.int64))


@dataclass
class Linear:
    """A logistic model over binary features, by hash, and a few real inputs."""

    ids: np.ndarray
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def of_rows(self, rows: Rows, extra: np.ndarray) -> np.ndarray:
        return _sigmoid(rows.only(self.ids).sums(self.weights) + extra @ self.extra + self.bias)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: Rows, y: np.ndarray, extra: np.ndarray, steps: int = 250) -> Linear:
    """Choose the features that say most about y, then descend on the penalised log loss with per-feature step sizes."""
    n, p = len(y), float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    count, positive = rows.counts(np.ones(n)), rows.counts(y)
    rest = np.maximum(n - count, 1)
    gap = (positive - count * p) ** 2 / np.maximum(count * p * (1 - p) * (rest / max(n, 1)), 1e-9)
    gap[count < LEAST_ROWS_OF_FEATURE] = -1
    best = np.argsort(-gap, kind="stable")[:MOST_FEATURES]
    x = rows.only(rows.ids[np.sort(best[gap[best] >= 0])])
    w, v, b = np.zeros(len(x.ids)), np.zeros(extra.shape[1]), float(np.log(p / (1 - p)))
    seen_w, seen_v, seen_b = np.full(len(w), 1e-6), np.full(len(v), 1e-6), 1e-6
    for _ in range(steps if 0 < y.sum() < n else 0):
        r = _sigmoid(x.sums(w) + extra @ v + b) - y
        g = x.counts(r) + PENALTY * w
        gv, gb = extra.T @ r + PENALTY * v, r.sum()
        seen_w += g * g
        seen_v += gv * gv
        seen_b += gb * gb
        w -= 0.5 * g / np.sqrt(seen_w)
        v -= 0.5 * gv / np.sqrt(seen_v)
        b -= 0.5 * gb / np.sqrt(seen_b)
    return Linear(x.ids, w, v, b)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, rows: Rows) -> np.ndarray:
        found = np.zeros((len(rows), 0))
        for model in self.models:
            found = np.column_stack([found, model.of_rows(rows, found)])
        return found


def fit_chain(names: list[str], rows: Rows, y: np.ndarray, fold: np.ndarray) -> Chain:
    """y: a column of 0 and 1 for each category. The last category's threshold is the best by F1 out of fold."""
    chain, before = Chain(names), np.zeros((len(rows), 0))
    for k in range(len(names)):
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            kept, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = fit_linear(rows.take(kept), y[kept, k], before[kept])
            out[held] = part.of_rows(rows.take(held), before[held])
        chain.models.append(fit_linear(rows, y[:, k], before))
        before = np.column_stack([before, out])
    if len(rows) and y[:, -1].any():
        last = before[:, -1]
        tries = [0.3, 0.4, 0.5, 0.6, 0.7]
        f1 = [2 * (y[:, -1] * (last >= t)).sum() / max(1, (last >= t).sum() + y[:, -1].sum()) for t in tries]
        chain.threshold = max(zip(f1, [-abs(t - 0.5) for t in tries], tries, strict=True))[2]
    else:
        chain.threshold = 1.1  # nothing is known of the category, so nothing is in it
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, seed: int = 11) -> Chain:
    """Fit the chain on labelled documents: at most MOST_ROWS of them, those whose doc_id hashes lowest."""
    categories = categories or default_categories()
    marks = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_{i}") for i, c in enumerate(categories.values())]
    chosen = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks)
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(MOST_ROWS)
    chosen = materialize(chosen, "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # MOST_ROWS rows of a few integers
    kind = dict(docs.dtypes)["doc_id"]
    marks = [f"_{i}" for i in range(len(categories))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), *batch.columns[2:]],
                    ["doc_id", "features", *marks],
                )

    schema = f"doc_id {kind}, features binary, " + ", ".join(f"{m} int" for m in marks)
    rows = texts.select("doc_id", "text", *marks).mapInArrow(features, schema)
    # rows that repeat a doc_id count once
    rows = rows.groupBy("doc_id", *marks).agg(F.min("features").alias("features"))
    got = rows.select("doc_id", "features", *marks, F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)).alias("fold"))
    got = got.orderBy("doc_id").toArrow()  # MOST_ROWS rows
    y = np.column_stack([got.column(m).to_numpy() for m in marks]).astype(np.float64).reshape(len(got), len(marks))
    blobs = got.column("features").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs])]).astype(np.int64)
    hashes = np.frombuffer(b"".join(blobs), np.uint32)
    del blobs
    return fit_chain(list(categories), gather(hashes, starts), y, got.column("fold").to_numpy().astype(np.int64))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category and rejected (the last one's probability reaches the threshold).

    A null or empty text has no features and so the rate of the category. Columns of docs with the names of the new ones
    are replaced. Every row is scored by itself: repeated rows and ties change nothing, an empty table stays empty.
    """
    new = [f"p_{c}" for c in chain.names] + ["rejected"]
    docs = docs.drop(*new)
    every = np.unique(np.concatenate([m.ids for m in chain.models]))
    weights = np.zeros((len(every), len(chain.models)))
    for k, m in enumerate(chain.models):
        weights[np.searchsorted(every, m.ids), k] = m.weights
    known = {int(i): k for k, i in enumerate(every)}
    extra, bias, threshold, text_at = [m.extra for m in chain.models], [m.bias for m in chain.models], chain.threshold, docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(known)
        for batch in batches:
            found = np.zeros((batch.num_rows, len(bias)))
            for i in range(batch.num_rows):
                ids = of(batch.column(text_at)[i].as_py())
                z = weights[ids].sum(axis=0) if len(ids) else np.zeros(len(bias))
                for k in range(len(bias)):
                    found[i, k] = _sigmoid(z[k] + bias[k] + (found[i, :k] @ extra[k] if k else 0.0))
            columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(bias))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns, pa.array(found[:, -1] >= threshold)], [*batch.schema.names, *new]
            )
        del of
        give_back()

    from pyspark.sql import types as T

    schema = T.StructType([
        *docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new[:-1]], T.StructField("rejected", T.BooleanType())
    ])
    return docs.mapInArrow(apply, schema)
