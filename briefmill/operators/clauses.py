"""Clause records: pairing documents with categories, parsing replies, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions import fixed
from briefmill.functions.text import strip_fence, trim_clause

REPLY = "found string, clause_text string, normalized_value string, confidence string"


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.CATEGORIES.items()), "clause_type string, query string")


def queries(spark: SparkSession) -> DataFrame:
    """clause_type, query_no, query: the category's own query and its alternates."""
    rows = [(c, i, q) for c, first in fixed.CATEGORIES.items() for i, q in enumerate([first, *fixed.ALTERNATES.get(c, [])])]
    return spark.createDataFrame(rows, "clause_type string, query_no int, query string")


def pair_with_categories(documents: DataFrame, categories: DataFrame, only_unprocessed: bool = False) -> DataFrame:
    """Every document with every category: the table of categories is fixed and small."""
    if only_unprocessed:
        documents = documents.filter("NOT processed")
    return documents.crossJoin(F.broadcast(categories))


def latest(clauses: DataFrame, *order: str) -> DataFrame:
    """One row for each (document_id, clause_type): the last by the order columns. A partial maximum runs before the
    shuffle, so a pair that was written often is as cheap as any other."""
    rest = [c for c in clauses.columns if c not in ("document_id", "clause_type", *order)]
    best = [F.max(F.struct(*order)).alias("_o")]
    if rest:  # the order's columns move once, not with the rest again
        best.append(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    rows = clauses.groupBy("document_id", "clause_type").agg(*best)
    return rows.select(*[f"_o.{c}" if c in order else f"_r.{c}" if c in rest else c for c in clauses.columns])


def parse_replies(rows: DataFrame, reply: str = "raw") -> DataFrame:
    """rows with found, clause_text, normalized_value, confidence and malformed, read from a model's reply.

    Anything that isn't an object with these fields is a clause that wasn't found, marked malformed; a missing reply is one
    that wasn't found. The string "false" is false.
    """
    text = strip_fence(F.col(reply))
    got = F.from_json(text, REPLY)
    number = F.coalesce(got["confidence"], F.lit("0")).try_cast("double")
    is_object = text.startswith("{") & got.isNotNull() & F.get_json_object(text, "$").isNotNull()
    good = F.coalesce(is_object & number.isNotNull(), F.lit(False))
    found = good & F.lower(F.coalesce(got["found"], F.lit("false"))).isin("true", "1")
    return (
        rows.withColumn("found", found)
        .withColumn("clause_text", F.when(good, trim_clause(got["clause_text"])))
        .withColumn("normalized_value", F.when(good, got["normalized_value"]))
        .withColumn("confidence", F.when(good, number).otherwise(0.0))
        .withColumn("malformed", F.col(reply).isNotNull() & ~good)
    )
