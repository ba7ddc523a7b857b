"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.llm.common import materialize, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain doesn't reject. A null or empty text has no features and gets the rates of the
    categories; rows are judged one by one, so repeats and ties change nothing; whole texts count, however long. Columns
    besides those of documents are dropped, so that none can clash; without labels, or rows, nothing is rejected."""
    from briefmill.llm.toxicity import score, train

    docs = docs.select(*COLUMNS)
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).filter("NOT rejected").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null counts as empty) the row with the largest doc_id, once if that repeats; a null
    doc_id stays only where no other is. An empty table stays empty; other columns than those of documents are dropped."""
    from briefmill.llm.exact_dedup import deduplicate

    return deduplicate(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity the one with the smallest doc_id. Documents without words are
    linked with nothing and stay, null texts too; all rows of the staying doc_id stay; an empty table stays empty."""
    from briefmill.llm.jaccard_join import join

    with scratch() as keep:  # the join's own tables are as large as the documents
        found = join(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
        found = keep(materialize(found, "representatives"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each kept document as many times as the mix takes it, in training order. Null and empty texts have no words and are
    never taken; a null source is a source of its own; equal rows are documents of their own; ties go by doc_id."""
    from briefmill.llm.mixing import in_training_order, mix

    return in_training_order(mix(docs.select(*COLUMNS), whole=True)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences. They are dealt to shards by hash, so the order of training isn't kept between
    sequences. A null or empty text is the end id alone; a copy is a document of its own; an empty table gives no row."""
    from briefmill.llm.packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mixing), ("packing", packing)]
#: The stages train a model, invert schedules and search: SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
