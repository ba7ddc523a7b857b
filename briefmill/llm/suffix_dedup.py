"""Removal of bytes that repeat elsewhere, by blockwise suffix sorting with a difference cover.

A suffix matters up to a depth (200 bytes). The cover sample holds the suffixes at positions whose residue is in a
difference cover: any two positions have a shift of less than the period at which both are sampled, so two suffixes
that agree to the depth have sampled suffixes within them that agree to the depth less the period. The sample is ranked
first: a rank is the name of what the sampled suffix begins with, and it is known for each whether its rank occurs
twice. A suffix with no repeated rank in reach is alone and needs no sorting. The others are sorted one bucket of names
at a time, ties running over the whole depth; only names of one bucket are in memory together.

Texts stay in blocks, which are written once. A block sends each bucket its distinct names, sorted and packed, and
learns which of them other blocks hold too, so that a string with any number of copies is one entry for each block.
Names are hashes of 56 bits, by which suffixes are sorted, and ties of these are told apart by 32 bits of a second hash
(those of the sample are cut to 40 bits, which can only bring in more suffixes to sort).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.blocks import open_block, text_blocks
from briefmill.llm.common import materialize, pack_sorted, unpack_sorted
from briefmill.llm.shingles import window_names

DEPTH = 200
#: A difference cover: every residue is the difference of two of these residues.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SAMPLE_BITS, NAME_BITS = 40, 56
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000

_SENT = "bucket int, block long, names binary, checks binary, docs binary"
_ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary())])


class Block:
    """The texts of a block, with the names of its suffixes."""

    def __init__(self, ids: bytes, nulls: bytes, sizes: bytes, text: bytes, depth: int):
        self.depth = depth
        self.ids, self.nulls, self.sizes, self.raw = open_block(ids, nulls, sizes, text)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        longest = int(self.sizes.max(initial=0))
        turns = np.arange(longest // PERIOD + 1, dtype=np.int64)[:, None] * PERIOD
        self.cover = (turns + np.array(COVER)).ravel()
        self.docs = np.flatnonzero(self.sizes >= depth)
        names = np.array([int.from_bytes(hashlib.blake2b(self.text(d), digest_size=8).digest(), "little") for d in self.docs], np.uint64)
        self.doc_names, first, self.doc_of = np.unique(names, return_index=True, return_inverse=True)
        self.is_first = np.zeros(len(self.docs), bool)
        self.is_first[first] = True
        self.local_copies = np.bincount(self.doc_of, minlength=len(first)) > 1 if len(first) else np.zeros(0, bool)

    def text(self, d: int) -> bytes:
        return self.raw[self.starts[d] : self.starts[d] + self.sizes[d]]

    def _groups(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Documents that stand near each other, a MB or so at a time, and where the first begins and the last ends."""
        at = 0
        while at < len(docs):
            begin, end = self.starts[docs[at]], at + 1
            while end < len(docs) and self.starts[docs[end]] + self.sizes[docs[end]] - begin < 1_000_000:
                end += 1
            yield docs[at:end], int(begin), int(self.starts[docs[end - 1]] + self.sizes[docs[end - 1]])
            at = end

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample of all first documents, and their names."""
        reach = self.depth - PERIOD + 1
        places, names = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for docs, begin, stop in self._groups(self.docs[self.is_first]):
            at = np.concatenate([
                self.starts[d] + self.cover[: np.searchsorted(self.cover, self.sizes[d] - reach, "right")] for d in docs
            ])
            places.append(at)
            names.append(window_names(self.buf[begin:stop], at - begin, reach))
        return np.concatenate(places), np.concatenate(names)

    def candidates(self, repeated: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the suffixes of docs with a repeated sampled suffix (positions) in reach, their names and checks."""
        edge = np.zeros(len(self.buf) + 1, np.int32)
        doc = np.searchsorted(self.starts, repeated, "right") - 1
        low = np.maximum(repeated - (PERIOD - 1), self.starts[doc])
        np.add.at(edge, low, 1)
        np.add.at(edge, repeated + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        places, names, checks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, "<u4")]
        for group, begin, stop in self._groups(docs):
            at = np.concatenate([
                self.starts[d] + np.flatnonzero(near[self.starts[d] : self.starts[d] + self.sizes[d] - self.depth + 1]) for d in group
            ])
            if not len(at):
                continue
            # only the bytes within these suffixes
            edge = np.zeros(stop - begin + 1, np.int32)
            np.add.at(edge, at - begin, 1)
            np.add.at(edge, at - begin + self.depth, -1)
            read = np.cumsum(edge[:-1]) > 0
            buf, inside = self.buf[begin:stop][read], (np.cumsum(read) - 1)[at - begin]
            places.append(at)
            names.append(window_names(buf, inside, self.depth) >> np.uint64(64 - NAME_BITS))
            checks.append((window_names(buf, inside, self.depth, 2) >> np.uint64(32)).astype("<u4"))
        return np.concatenate(places), np.concatenate(names), np.concatenate(checks)


def _sorted(names: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order of names, ties by their checks."""
    order = np.argsort(names, kind="stable")
    ranked, tied = names[order], checks[order]
    same = ranked[1:] == ranked[:-1]
    return np.lexsort((checks, names)) if (same & (tied[1:] != tied[:-1])).any() else order


def _distinct(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names with their checks, for each name its place among them, and which of them occur twice here."""
    order = _sorted(names, checks)
    ranked, tied = names[order], checks[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (tied[1:] != tied[:-1])]) if len(ranked) else np.empty(0, bool)
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return ranked[begin], tied[begin], place, np.diff(np.concatenate([begin, [len(ranked)]])) > 1


def _cuts(names: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted names of so many bits."""
    bounds = [-(-(b << bits) // buckets) for b in range(buckets)]
    return np.concatenate([np.searchsorted(names, np.array(bounds, np.uint64)), [len(names)]])


def _send(block: int, names: np.ndarray, checks: np.ndarray, bits: int, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows: list[list] = [[], [], [], [], []]
    cut, cut_docs = _cuts(names, buckets, bits), _cuts(docs, buckets, 64)
    for b in range(buckets):
        part, part_docs = slice(cut[b], cut[b + 1]), docs[cut_docs[b] : cut_docs[b + 1]]
        if part.start < part.stop or len(part_docs):
            row = b, block, pack_sorted(names[part]), checks[part].tobytes(), part_docs.tobytes()
            for column, x in zip(rows, row, strict=True):
                column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ROW, strict=True)], schema=_ROW)


def _bucket(table: pa.Table) -> pa.Table:
    """Sort one bucket. Answers hold a bit for each name, set where another block has it, and a byte for each document:
    0 alone, 1 first of several, 2 a later one."""
    rows = table.to_pylist()
    own = [unpack_sorted(r["names"]) for r in rows]
    names, checks = np.concatenate(own), np.concatenate([np.frombuffer(r["checks"], "<u4") for r in rows])
    if not len(checks):  # the sample's names have none
        checks = np.zeros(len(names), "<u4")
    hit = (many := _distinct(names, checks))[3][many[2]]
    first: dict[int, list[int]] = {}
    for r in rows:
        for d in np.frombuffer(r["docs"], np.uint64).tolist():
            first.setdefault(d, []).append(r["block"])
    out, at = [], 0
    for r, part in zip(rows, own, strict=True):
        docs = [first[d] for d in np.frombuffer(r["docs"], np.uint64).tolist()]
        state = bytes(0 if len(x) == 1 else 1 if min(x) == r["block"] else 2 for x in docs)
        bits = np.packbits(hit[at : at + len(part)]).tobytes()
        at += len(part)
        out.append({"bucket": r["bucket"], "block": r["block"], "names": bits, "checks": b"", "docs": state})
    return pa.Table.from_pylist(out, schema=_ROW)


def _answers(answers: list[dict] | None, cut: np.ndarray) -> np.ndarray:
    out = np.zeros(cut[-1], bool)
    for a in answers or ():
        part = out[cut[a["bucket"]] : cut[a["bucket"] + 1]]
        part[:] = np.unpackbits(np.frombuffer(a["names"], np.uint8), count=len(part))
    return out


class _Round:
    """What a block does before and after each exchange; everything is derived anew from its texts and the answers."""

    def __init__(self, buckets: int, depth: int):
        self.buckets, self.depth = buckets, depth
        self.cut = np.uint64(64 - SAMPLE_BITS)

    def open(self, row: dict) -> Block:
        return Block(row["ids"], row["nulls"], row["sizes"], row["text"], self.depth)

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                b = self.open(row)
                names = np.unique(b.sample()[1] >> self.cut)
                yield _send(row["block"], names, np.empty(0, "<u4"), SAMPLE_BITS, b.doc_names, self.buckets)

    def _after_first(self, b: Block, answers: list[dict] | None):
        """Positions, names and checks of the suffixes to sort, and which documents are copies of another."""
        places, names = b.sample()
        own, place, many = np.unique(names >> self.cut, return_inverse=True, return_counts=True)
        twice = many > 1
        repeated = places[(twice | _answers(answers, _cuts(own, self.buckets, SAMPLE_BITS)))[place]]
        state = np.zeros(len(b.doc_names), np.uint8)
        cut = _cuts(b.doc_names, self.buckets, 64)
        for a in answers or ():
            state[cut[a["bucket"]] : cut[a["bucket"] + 1]] = np.frombuffer(a["docs"], np.uint8)
        copy = (b.local_copies | (state > 0))[b.doc_of] if len(b.docs) else np.zeros(0, bool)
        # of equal documents only one sends its suffixes; all of them are repeats
        sends = b.docs[b.is_first & (state[b.doc_of] != 2)] if len(b.docs) else b.docs
        # a document whose copy is in another block only has its ranks repeated there
        return *b.candidates(repeated, sends), b.docs[copy]

    def second(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                _, names, checks, _ = self._after_first(self.open(row), row["answers"])
                names, checks = _distinct(names, checks)[:2]
                yield _send(row["block"], names, checks, NAME_BITS, np.empty(0, np.uint64), self.buckets)

    def last(self, texts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    yield self._removed(self.open(row), row, texts)

        return run

    def _removed(self, b: Block, row: dict, texts: bool) -> pa.RecordBatch:
        places, names, checks, copies = self._after_first(b, row["answers"])
        own, _, place, twice = _distinct(names, checks)
        begin = places[(twice | _answers(row["again"], _cuts(own, self.buckets, NAME_BITS)))[place]]
        edge = np.zeros(len(b.buf) + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + self.depth, -1)
        np.add.at(edge, b.starts[copies], 1)
        np.add.at(edge, b.starts[copies] + b.sizes[copies], -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, kept, sha = [], [], [], []
        for s, n in zip(b.starts, b.sizes, strict=True):
            mask = gone[s : s + n]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            text = b.buf[s : s + n][~mask].tobytes()
            removed.append(int(mask.sum()))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in turn.reshape(-1, 2)])
            sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text if texts else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([
            pa.array(b.ids, mask=b.nulls), pa.array(b.sizes), pa.array(removed, pa.int64()), pa.array(spans, span),
            pa.array(sha, pa.string()), pa.array(kept, pa.binary()),
        ], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH, texts: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, stop), kept_sha256, kept of each row of docs (doc_id, text).

    Each byte goes that is covered by a string of `depth` bytes (UTF-8) that also starts elsewhere, in the same or another
    document; strings are those of the input and overlaps count. Spans are maximal; kept are the remaining bytes joined
    (null with texts=False). A null text is empty; texts shorter than depth lose nothing. Equal rows are distinct
    documents and repeat each other. An empty table gives an empty result. Other columns are not read.
    """
    if depth < PERIOD + 32:
        raise ValueError(f"depth must be at least {PERIOD + 32}, so that names of the sample say enough")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    step = _Round(buckets, depth)
    blocks = text_blocks(docs, BLOCK_BYTES)

    def exchange(sent: DataFrame, name: str) -> DataFrame:
        return materialize(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_bucket, _SENT), name)

    def answered(rows: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        by = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "names", "docs")).alias(name))  # one for each bucket
        return rows.join(by, "block", "left")

    first = exchange(blocks.mapInArrow(step.first, _SENT), "ranks")
    known = answered(blocks, first, "answers")
    second = exchange(known.mapInArrow(step.second, _SENT), "sorted")
    out = answered(known, second, "again").mapInArrow(
        step.last(texts),
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string, kept binary",
    )
    return out
