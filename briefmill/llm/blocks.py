"""Blocks of texts: some MB of documents as one compressed row, written once so that later passes see the same blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import materialize

_BLOCK = "block long, ids binary, nulls binary, sizes binary, text binary"


def _write(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def block():
        zipped = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        known = np.array([i or 0 for i in ids], np.int64)
        nulls = np.array([i is None for i in ids], bool)
        sizes = np.array([len(t) for t in texts], np.int64)
        row = [task << 24 | made, known.tobytes(), nulls.tobytes(), sizes.tobytes(), zipped]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]],
            ["block", "ids", "nulls", "sizes", "text"],
        )

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= block_bytes:
                yield block()
                ids, texts, size, made = [], [], 0, made + 1
    if ids:
        yield block()


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block of docs (doc_id, text): a null text is empty, a null doc_id is marked in nulls."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _write(b, block_bytes), _BLOCK)
    return materialize(rows, "blocks")


def open_block(ids: bytes, nulls: bytes, sizes: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """doc ids, which of them are null, sizes in bytes, and the texts joined."""
    n = np.frombuffer(sizes, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(n.sum())))
    return np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), n, raw
