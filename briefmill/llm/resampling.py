"""Importance resampling: documents drawn by how much likelier their word runs are in a target's texts than in the corpus.

Features are runs of consecutive words, hashed to buckets. A task holds the features of its texts in a trie of words,
whose nodes know how often they were passed and the CRC of the path to them, so that a longer run's hash goes on from
its beginning's. Totals by bucket are merged; then texts are scored along tries whose nodes have their bucket's gain.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Digits, a-z and whatever isn't ASCII, in UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Nodes after which a task's trie begins anew; totals go on, so that only memory depends on this.
MOST_NODES = 500_000


class Node(dict):
    """A run of words; its items are the runs that are one word longer."""

    __slots__ = ("trie", "crc", "count", "gain")

    def __init__(self, trie: Trie, crc: int, gain: int):
        self.trie, self.crc, self.count, self.gain = trie, crc, 0, gain

    def __missing__(self, word: bytes) -> Node:
        node = self[word] = self.trie.grow(zlib.crc32(word, zlib.crc32(b" ", self.crc)))
        return node


class _First(Node):
    """The empty run."""

    __slots__ = ()

    def __missing__(self, word: bytes) -> Node:
        node = self[word] = self.trie.grow(zlib.crc32(word))
        return node


class Trie:
    def __init__(self, run: int, buckets: int, gains: list[int] | None = None):
        self.run, self.buckets, self.gains, self.totals = run, buckets, gains, np.zeros(buckets, np.int64)
        self._begin()

    def _begin(self) -> None:
        self.nodes: list[Node] = []
        self.first = _First(self, 0, 0)

    def grow(self, crc: int) -> Node:
        node = Node(self, crc, self.gains[crc % self.buckets] if self.gains else 0)
        self.nodes.append(node)
        return node

    def passed(self, words: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of all runs of one word, then of two, and so on."""
        level = list(map(self.first.__getitem__, words))
        for k in range(1, self.run + 1):
            yield level
            level = list(map(Node.__getitem__, level, words[k:])) if k < self.run else []

    def count(self, words: list[bytes]) -> None:
        for level in self.passed(words):
            for node in level:
                node.count += 1
        if len(self.nodes) > MOST_NODES:
            self.merge()

    def merge(self) -> None:
        """Add the nodes' counts to the totals by bucket, and begin anew."""
        crc = np.fromiter((n.crc for n in self.nodes), np.int64, len(self.nodes))
        np.add.at(self.totals, crc % self.buckets, np.fromiter((n.count for n in self.nodes), np.int64, len(self.nodes)))
        self._begin()

    def weigh(self, words: list[bytes]) -> tuple[int, int]:
        """How many features, and their mean gain rounded down."""
        n = total = 0
        for level in self.passed(words):
            n += len(level)
            total += sum(map(attrgetter("gain"), level))
        if len(self.nodes) > MOST_NODES:
            self._begin()
        return n, total // n if n else 0


def split(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # bytes: A-Z only


def bucket_totals(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (text) by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(run, buckets)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                trie.count(split(text.as_py()))
        trie.merge()
        have = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(trie.totals[have], pa.int64())], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, one added to every bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    share = lambda t, s: (float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n))
    return [math.floor(1000 * math.log(share(t, s))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def weights(docs: DataFrame, gains: list[int], run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(run, len(shared.value), shared.value)
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.binary()):
                words = split(text.as_py())
                found.append((len(words), *trie.weigh(words)))
            columns = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[:, i]) for i in range(3)]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int = SEED) -> F.Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the id's hash."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(first, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, score) with rank: 1, 2, ... by falling score, ties to the smaller doc_id (null first), null beyond `most`.

    Rows are dealt by ranges of score, so no task sorts more than one range; what a range's ranks begin at is the number of
    rows in the ranges before it. Ranges that begin beyond `most` need no ranks."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    before, at = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect()):  # a row for each partition
        before.append((r["_range"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    dealt = dealt.join(F.broadcast(starts), "_range")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))
    drawn = dealt.filter(F.col("_before") < most).withColumn("rank", place.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = dealt.filter(F.col("_before") >= most).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_row", "_range", "_before")


def resample(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; those drawn have a rank.

    Of the documents (doc_id, text) with at least `least_words` words, `percent` of a hundred (rounded down) are drawn: those
    whose weight, the mean gain of their features towards the target's texts (text), plus the noise of their doc_id is
    highest; drawing by such sums is drawing without replacement by weight. A null text has no words and weight 0; words go
    by A-Z lower-cased and whole texts count, however long. Equal texts have equal weights and noise of their own; rows of
    one doc_id share its noise, and of fully equal rows any comes first. A null doc_id hashes as nothing after the colon and
    comes before others on ties. Empty tables give no row, or gains by the smoothing alone. Other columns are not read.
    """
    gains = bucket_gains(bucket_totals(docs, run, buckets), bucket_totals(target, run, buckets))
    scored = weights(docs, gains, run).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= least_words
    most = scored.filter(enough).count() * percent // 100
    out = ranked(scored.filter(enough), most).unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that resample() draws, with all their columns. doc_id must tell rows apart: of a repeated one all rows
    stay once any is drawn."""
    drawn = resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")
