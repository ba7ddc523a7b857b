"""Pages, parent and child token windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.functions import fixed
from briefmill.functions.text import words


def pages(texts: DataFrame, lines: int = fixed.PAGE_LINES) -> DataFrame:
    """doc_id, page_number (from 1), text, total_pages: groups of non-blank lines of texts (doc_id, text)."""
    kept = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.rlike(x, F.lit(r"\S")))
    rows = texts.select("doc_id", kept.alias("_l")).withColumn("total_pages", F.ceil(F.size("_l") / F.lit(lines)).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.col("total_pages") - 1), lambda i: F.array_join(F.slice("_l", i * lines + 1, lines), "\n"))
    # null gives no row; a filter would be pushed below, where the text is split once more
    rows = rows.select("doc_id", "total_pages", F.posexplode(F.when(F.size("_l") > 0, groups)).alias("_i", "text"))
    return rows.select("doc_id", (F.col("_i") + 1).alias("page_number"), "text", "total_pages")


def parents(pages: DataFrame, size: int = fixed.PARENT, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """doc_id, page_number, page_parent_index, tokens of each window; windows of a page follow each other."""
    rows = pages.select("doc_id", "page_number", tokenize(F.col("text")).alias("_t"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / F.lit(size)).cast("int"))
    cut = F.transform(starts, lambda i: F.slice("_t", i * size + 1, size))
    # as in pages(): null gives no row, and the page is cut into tokens once
    rows = rows.select("doc_id", "page_number", F.posexplode(F.when(F.size("_t") > 0, cut)).alias("page_parent_index", "tokens"))
    return rows.withColumn("parent_id", F.md5(F.concat_ws("/", "doc_id", "page_number", "page_parent_index")))


def children(parents: DataFrame, size: int = fixed.CHILD, overlap: int = fixed.OVERLAP) -> DataFrame:
    """Overlapping windows of each parent; the last is the one that reaches its end. chunk_index counts through the
    document, chunk_id is a hash of the place, so that ingesting twice writes the same rows."""
    step, n = size - overlap, F.size("tokens")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("tokens", i * step + 1, size))
    rows = parents.select("doc_id", "page_number", "page_parent_index", "parent_id", F.posexplode(cut).alias("child_index", "tokens"))
    order = W.partitionBy("doc_id").orderBy("page_number", "page_parent_index", "child_index")
    return rows.select(
        "*", (F.row_number().over(order) - 1).alias("chunk_index"), F.size("tokens").alias("token_count"),
        F.md5(F.concat_ws("/", "doc_id", "page_number", "page_parent_index", "child_index")).alias("chunk_id"),
    )
