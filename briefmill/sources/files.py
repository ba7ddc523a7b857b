"""Reading documents from files, and tables that caches and jobs are kept in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions import fixed

SUFFIXES = (".pdf", ".docx", ".doc", ".txt")
PAGES = "doc_id string, file_path string, page_number int, text string, total_pages int, error string"


def _lines_to_pages(lines: list[str]) -> list[str]:
    n = fixed.PAGE_LINES
    return ["\n".join(lines[i : i + n]) for i in range(0, len(lines), n)]


def _docx(content: bytes) -> list[str]:
    """The text of each paragraph of a zipped word document."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]


def _pdf(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as e:
        raise RuntimeError("reading PDF needs pypdf, which isn't installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def read_pages(path: str, content: bytes) -> tuple[list[tuple[int, str]], int]:
    """(number, text) of each page that isn't blank, and how many pages there are."""
    kind = re.search(r"\.[^./]*$", path.lower())
    kind = kind[0] if kind else ""
    if kind == ".pdf":
        every = _pdf(content)
        return [(i + 1, t.strip()) for i, t in enumerate(every) if t.strip()], len(every)
    if kind == ".txt":
        pages = _lines_to_pages([x for x in content.decode("utf-8", "replace").splitlines() if x.strip()])
    elif kind in (".docx", ".doc"):
        pages = _lines_to_pages([p.strip() for p in _docx(content) if p.strip()])
    else:
        raise ValueError(f"unsupported file type: {kind or 'none'}")
    return list(enumerate(pages, 1)), len(pages)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page of the files under path (a pattern); a file that can't be read is one row with its error. doc_id is
    the whole path, so that files of one name stay apart; stem() gives the short name."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found, total = read_pages(name, content)
                    rows = [(name, name, n, text, total, None) for n, text in found]
                except Exception as e:  # any fault of a file is that file's row
                    rows = [(name, name, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["doc_id", "file_path", "page_number", "text", "total_pages", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, PAGES)


def stem(path) -> "F.Column":
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """key, text of the distinct texts that the cache (key) doesn't hold."""
    asked = texts.select(F.md5("text").alias("key"), "text").dropDuplicates(["key"])
    return asked.join(cache.select("key"), "key", "left_anti")


def through_cache(texts: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with the misses of texts computed (key, text -> the cache's columns)."""
    return cache.unionByName(compute(cache_misses(texts, cache)))


def replace_documents(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write rows partitioned by doc_id; partitions of the documents in rows are replaced, others stay, so that ingesting a
    document again changes nothing else."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)
