"""Helpers shared by the operators: shared storage, text normalisation and packing of sorted keys."""

from __future__ import annotations

import ctypes
import string
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Where it is unset a local session gets
    one beside its warehouse; on a cluster that might be a machine's own disk, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/briefmill-work"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The shuffle files of the write are removed as it ends, since nothing will read them again. Options are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


#: Tables that were made inside each scratch() that is open.
_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() makes inside are removed at the end, all but those that the given function is told to keep.
    Nothing lazy that reads the others may leave."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _scratch.pop()
        if _scratch:
            _scratch[-1].extend(kept)
        discard(*[t for t in made if not any(t is k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing will read any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at).getParent()
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with _ behind it until df has no such column, however spelt."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters that have a lower case take the faster built-in."""
    plain = F.octet_length(c) == F.char_length(c)
    others = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return F.when(plain | (F.lower(others) == others), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Let the machine have what this process has freed. Spark keeps a task's Python worker for later tasks, and what it holds
    counts beside theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps freed memory and has this
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences; the upper planes, which hold little, are compressed."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    top = int(step.max()) if len(step) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    raw = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    low = max(0, planes - 3)
    head = int(keys[0]).to_bytes(8, "little") + len(step).to_bytes(8, "little") + bytes([planes])
    return head + raw[:low].tobytes() + zstandard.ZstdCompressor(level=1).compress(raw[low:].tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, planes = int.from_bytes(blob[8:16], "little"), blob[16]
    low = max(0, planes - 3)
    step = np.zeros((n + 1, 8), np.uint8)
    step[1:, :low] = np.frombuffer(blob, np.uint8, low * n, 17).reshape(low, n).T
    rest = zstandard.ZstdDecompressor().decompress(blob[17 + low * n :], max_output_size=max(1, (planes - low) * n))
    step[1:, low:planes] = np.frombuffer(rest, np.uint8).reshape(planes - low, n).T
    out = step.view("<u8").ravel()
    out[0] = int.from_bytes(blob[:8], "little")
    return np.cumsum(out, dtype=np.uint64)
