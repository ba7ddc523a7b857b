"""Exact dedup against a history of distinct digests held in minimal perfect hash tables.

The history's distinct digests are sharded by their leading bits. Each shard gets a minimal perfect hash: a cascade of
bit tables in which a key takes the first level where no other key falls on its bit; the rank of that bit is its slot.
Slots hold the full digest and the winner's locator, so that a lookup ends with a comparison of all bytes. Incoming
digests that are members are repeats of the history; nonmembers are grouped among themselves. Copies are counted
before any row moves to a shard, so a digest with any part of the rows is one row there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import ascii_lower, free_names, materialize, mix64, scratch

LEVELS, GAMMA = 24, 2
#: Digests in a shard on average; a shard's table and lookups fit in a few MB.
SHARD_KEYS = 50_000


class PerfectHash:
    """Slots 0..n-1 for n distinct 32-byte digests; lookups of other digests give any slot or -1."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 4) uint64, distinct rows."""
        self.levels: list[np.ndarray] = []
        self.first: list[int] = []
        left, done = np.arange(len(digests)), 0
        slot = np.empty(len(digests), np.int64)
        for level in range(LEVELS):
            if not len(left):
                break
            bits = max(64, GAMMA * len(left))
            at = self._at(digests[left], level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1
            got = alone[at]
            slot[left[got]] = done + rank[at[got]]
            self.levels.append(alone)
            self.first.append(done)
            done += int(alone.sum())
            left = left[~got]
        # what collides in every level is told apart by its bytes
        self.rest = {digests[i].tobytes(): done + k for k, i in enumerate(left)}
        for k, i in enumerate(left):
            slot[i] = done + k
        self.slot = slot

    @staticmethod
    def _at(digests: np.ndarray, level: int, bits: int) -> np.ndarray:
        mixed = mix64(digests[:, level % 4] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))
        return (mixed % np.uint64(bits)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, (alone, first) in enumerate(zip(self.levels, self.first, strict=True)):
            at = self._at(digests[left], level, len(alone))
            got = alone[at]
            rank = np.cumsum(alone) - 1
            out[left[got]] = first + rank[at[got]]
            left = left[~got]
        for i in left:
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(-1, 4) if len(column) else np.empty((0, 4), np.uint64)


def _settle(history: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
    """One shard: the history's slots with the repeats among the incoming digests merged in, then the nonmembers."""
    held = _words(history["digest"])
    table = PerfectHash(held)
    digests = np.empty_like(held)
    digests[table.slot] = held
    winner, count = np.empty(len(held), object), np.zeros(len(held), np.int64)
    winner[table.slot] = history["winner"].to_numpy(object)
    count[table.slot] = history["n"].to_numpy()
    asked = _words(incoming["digest"])
    slot = table.lookup(asked)
    member = slot >= 0
    member[member] = (digests[slot[member]] == asked[member]).all(axis=1)
    new = incoming["winner"].to_numpy(object)
    for i in np.flatnonzero(member):
        s, w = slot[i], new[i]
        if not pd.isna(w) and (pd.isna(winner[s]) or w > winner[s]):
            winner[s] = w
    np.add.at(count, slot[member], incoming["n"].to_numpy()[member])
    rest = incoming[~member]
    out = pd.DataFrame({
        "digest": [d.tobytes() for d in digests] + list(rest["digest"]),
        "keep_id": pd.array([*winner, *rest["winner"]], dtype="Int64"),
        "group_size": np.concatenate([count, rest["n"].to_numpy(np.int64)]),
        "repeat_of_history": np.concatenate([np.ones(len(held), bool), np.zeros(len(rest), bool)]),
    })
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte SHA-256 of each text, lower-cased A-Z only; null counts as empty."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))


def classes(history: DataFrame, incoming: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """digest, keep_id, group_size of all distinct digests of both; each has digest and doc_id for every row."""
    old, new = materialize(distinct(history), "history"), materialize(distinct(incoming), "incoming")
    shards = max(1, -(-max(old.count(), new.count()) // shard_keys))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    old, new = old.withColumn("shard", shard), new.withColumn("shard", shard)
    return (
        old.groupBy("shard").cogroup(new.groupBy("shard"))
        .applyInPandas(
            lambda a, b: _settle(a, b), "digest binary, keep_id long, group_size long, repeat_of_history boolean"
        )
    )


def classify(docs: DataFrame, parts: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the row with the largest doc_id stays.

    One table is its own history: the rows whose doc_id hashes to 0 of `parts` are the history, the others come in. A
    null doc_id never wins against another; rows of equal text that repeat the winning doc_id are all marked kept
    (deduplicate() leaves one of them). An empty table gives an empty result. Columns besides doc_id and text are not
    read.
    """
    rows = materialize(digests(docs), "digests")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0
    found = classes(rows.filter(old), rows.filter(~old)).select("digest", "keep_id", "group_size")
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, and of rows repeating doc_id and text only one. All columns of docs stay,
    whatever their names."""
    copies, doc, sha, own = free_names(docs, "_copies", "_id", "_sha", "_text")
    with scratch() as keep:
        kept = classify(docs.select("doc_id", "text")).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias(copies))
        kept = keep(materialize(kept.select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha), copies), "kept"))
    text = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    rows = docs.withColumn(own, text)
    match = rows["doc_id"].eqNullSafe(kept[doc]) & (rows[own] == kept[sha])
    one = rows.join(kept, match).select(*[rows[f"`{c}`"] for c in docs.columns], own, copies)
    if kept.filter(F.col(copies) > 1).isEmpty():
        return one.drop(copies, own)
    # Repeated ids are rare: only their rows move again.
    again = one.filter(F.col(copies) > 1).dropDuplicates(["doc_id", own])
    return one.filter(F.col(copies) == 1).unionByName(again).drop(copies, own)
