"""A document source: spark.read.format("briefmill_pages") gives the pages of a folder's files, and
spark.readStream.format("briefmill_pages") those of files that arrive or change.

Files are listed once, on the driver, and dealt to tasks by their bytes, so one task reads many small files or one large
one. A stream writes down each listing that found something new as a numbered manifest; its offset is that number, so
what belongs to a batch is known after a restart too, whatever the files' times.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from briefmill.sources.files import read_pages

SCHEMA = "doc_id string, file_path string, page_number int, text string, total_pages int, error string, modified long, content_md5 string, bytes long"
#: Bytes of files that a task reads, unless one file alone is larger.
SPLIT_BYTES = 64 << 20


@dataclass
class Split(InputPartition):
    """Files of one task: path, time of change in nanoseconds, size."""

    files: list[tuple[str, int, int]]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str) -> list[tuple[str, int, int]]:
    """The files under a folder, at any depth, by path; those in folders or of names that begin with _ or a dot are left out."""
    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = lambda f: f.path[len(root) :].strip("/").split("/")
    kept = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in inner(f))]
    return sorted((f.path, f.mtime_ns or 0, f.size or 0) for f in kept)


def splits(files: list[tuple[str, int, int]], most: int) -> list[Split]:
    """Files in order, as many to a split as hold about `most` bytes; an empty file counts as some."""
    out: list[Split] = []
    size = 0
    for f in files:
        if not out or size + f[2] > most:
            out.append(Split([]))
            size = 0
        out[-1].files.append(f)
        size += max(f[2], 4096)
    return out


def _read(path: str, split: Split) -> Iterator[pa.RecordBatch]:
    system, _ = _place(path)
    kinds = pa.schema([("doc_id", pa.string()), ("file_path", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("total_pages", pa.int32()), ("error", pa.string()), ("modified", pa.int64()), ("content_md5", pa.string()), ("bytes", pa.int64())])
    for name, modified, size in split.files:
        content, md5 = b"", None
        try:
            with system.open_input_stream(name) as f:
                content = f.read()
            md5 = hashlib.md5(content).hexdigest()
            pages, total = read_pages(name, content)
            rows = [(name, name, n, text, total, None) for n, text in pages] or [(name, name, None, None, 0, None)]
        except Exception as e:  # any fault of a file is that file's row
            rows = [(name, name, None, None, None, f"{type(e).__name__}: {e}")]
        rows = [(*r, modified, md5, len(content) if md5 else size) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


class _Batch(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> Sequence[InputPartition]:
        return splits(listing(self.path), self.most) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Manifest n holds the files that were new or changed, by time or size, when it was written."""

    def __init__(self, path: str, most: int, manifests: str):
        self.path, self.most, self.manifests = path, most, manifests

    def _held(self) -> dict[int, list[tuple[str, int, int]]]:
        system, root = _place(self.manifests)
        found = {}
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".json"):
                with system.open_input_stream(f.path) as s:
                    found[int(f.base_name[:-5])] = [tuple(x) for x in json.loads(s.read())]
        return found

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        held = self._held()
        last = max(held, default=0)
        known = {f[0]: f[1:] for n in sorted(held) for f in held[n]}
        new = [f for f in listing(self.path) if known.get(f[0]) != f[1:]]
        if not new:
            return {"manifest": last}
        system, root = _place(self.manifests)
        system.create_dir(root, recursive=True)
        draft, made = f"{root}/{last + 1}.draft", f"{root}/{last + 1}.json"
        with system.open_output_stream(draft) as s:
            s.write(json.dumps(new).encode())
        system.move(draft, made)
        return {"manifest": last + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        held = self._held()
        files = {f[0]: f for n in range(start["manifest"] + 1, end["manifest"] + 1) for f in held[n]}  # a file's last change counts
        return splits(sorted(files.values()), self.most)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class PageSource(DataSource):
    """Options: path (a folder that driver and executors reach, local or of a store that pyarrow opens), splitBytes, and for
    streams manifests (a folder; by default _manifests under the path). A row stands for each page that isn't blank; a file
    without such pages is a row without a page, one that can't be read a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "briefmill_pages"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        path = (self.options.get("path") or "").rstrip("/")
        if not path:
            raise ValueError("briefmill_pages needs a path")
        return path, int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        path, most = self._options()
        return _Stream(path, most, self.options.get("manifests") or f"{path}/_manifests")


def register(spark) -> None:
    spark.dataSource.register(PageSource)
