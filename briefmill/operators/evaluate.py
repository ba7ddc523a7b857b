"""Measures of retrieval and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.functions.text import contains_answer, is_hit, token_f1


def _rate(hits: Column, digits: int) -> Column:
    return F.coalesce(F.round(F.sum(hits.cast("int")) / F.nullif(F.count("*"), F.lit(0)), digits), F.lit(0.0))


def hits(candidates: DataFrame, truths: DataFrame, row: str) -> DataFrame:
    """row, first_hit: the best rank at which a candidate (row, rank, text) contains the row's truth; null for none. Rows
    whose truth is null or blank are left out."""
    asked = truths.filter(F.trim(F.col("truth")) != "")
    found = candidates.join(asked, row).filter(is_hit(F.col("text"), F.col("truth")))
    best = found.groupBy(row).agg(F.min("rank").alias("first_hit"))
    return asked.select(row).join(best, row, "left")


def recall(hits: DataFrame, *at: int) -> DataFrame:
    """One row: how many rows were asked, and the part of them hit within each rank of `at`."""
    return hits.agg(F.count("*").alias("answered"), *[_rate(F.coalesce(F.col("first_hit") <= k, F.lit(False)), 4).alias(f"recall_at_{k}") for k in at])


def recall_by(hits: DataFrame, group: str, k: int) -> DataFrame:
    """The part hit within rank k in each group, worst first."""
    hit = F.coalesce(F.col("first_hit") <= k, F.lit(False))
    out = hits.groupBy(group).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"), _rate(hit, 4).alias("recall"))
    return out.orderBy("recall", group)


def scored_answers(rows: DataFrame) -> DataFrame:
    """rows (prediction, truth, found) with f1 and substring."""
    said = F.coalesce("prediction", F.lit(""))
    return rows.withColumn("f1", token_f1(said, F.col("truth"))).withColumn("substring", contains_answer(said, F.col("truth")))


def extraction_metrics(scored: DataFrame) -> DataFrame:
    given = F.col("found") & (F.coalesce("prediction", F.lit("")) != "")
    some = F.when(given, F.col("f1"))
    z = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return scored.agg(
        F.count("*").alias("answered_rows"), _rate(F.col("found"), 4).alias("found_rate"), _rate(F.col("substring"), 4).alias("substring_rate"),
        z(F.avg("f1")).alias("f1_mean"), z(F.median("f1")).alias("f1_median"), z(F.avg(some)).alias("conditional_f1_mean"),
        z(F.median(some)).alias("conditional_f1_median"),
    )


def extraction_by_category(scored: DataFrame, group: str) -> DataFrame:
    return scored.groupBy(group).agg(
        F.count("*").alias("rows"), _rate(F.col("found"), 3).alias("found_rate"), _rate(F.col("substring"), 3).alias("substring_rate"),
        F.round(F.avg("f1"), 3).alias("f1_mean"),
    )


#: Rows that a task holds of all groups before it hands on what it has and begins anew.
HELD = 200_000


def least_of_groups(rows: DataFrame, group: str, order: list[str], most: int, held: int = HELD) -> DataFrame:
    """The first `most` rows of each group by the order columns, within each task: a task hands on that many rows of a group,
    so what is moved for the last choice is bounded by groups, tasks and `most`, not by rows. With very many groups a task
    hands on in several parts. Nulls come first; of equal rows any stays."""
    schema = rows.schema

    def first(table: pa.Table) -> pa.Table:
        coded = table.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices
        keys = [("_g", "ascending"), *((c, "ascending") for c in order)]
        table = table.append_column("_g", coded)
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        g = table.column("_g").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
        return table.filter(pa.array(place < most)).drop_columns("_g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size, limit = 0, held
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= limit:
                kept = [first(pa.concat_tables(kept))]
                size = kept[0].num_rows
                if size > held // 2:  # too many groups to go on with
                    yield from kept[0].to_batches()
                    kept, size = [], 0
        if kept:
            yield from first(pa.concat_tables(kept)).to_batches()

    return rows.mapInArrow(run, schema)


def stratified_sample(rows: DataFrame, group: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """key of max(1, ceil(size/groups)) rows of each group by hash, then the `size` smallest keys. Tasks hand on the `size` rows
    of least hash of each group, as many as could be wanted, and the groups are counted among these."""
    hashed = rows.select(group, key, F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))).alias("_hash"))
    some = least_of_groups(hashed, group, ["_hash", key], size)
    order = W.partitionBy(group).orderBy("_hash", key)
    place = some.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size)
    groups = place.filter("_n = 1").agg(F.count("*").alias("_groups"))
    each = F.least(F.greatest(F.lit(1), F.ceil(F.lit(size) / F.col("_groups"))), F.lit(size))
    picked = place.crossJoin(F.broadcast(groups)).filter(F.col("_n") <= each)  # one row
    return picked.select(group, key).orderBy(key).limit(size)


def validate_spans(spans: DataFrame) -> DataFrame:
    """spans (span_id, body: JSON) with the first fault that is found, null for none."""
    top = ("span_id", "trace_id", "retrieved_chunks", "retrieval_metadata", "llm_response")
    meta = ("query", "retrieval_method", "top_k", "retrieved_chunks", "all_ranked_chunks")
    chunk = ("chunk_id", "rank", "dense_score", "sparse_score", "rrf_score")
    lacks = lambda text, k: ~F.coalesce(F.array_contains(F.json_object_keys(text), k), F.lit(False))
    inner = F.get_json_object("body", "$.retrieval_metadata")
    ranked = F.from_json(F.get_json_object("body", "$.retrieval_metadata.all_ranked_chunks"), "array<string>")
    fault = F.coalesce(
        *[F.when(lacks(F.col("body"), k), F.lit(f"missing top-level field: {k}")) for k in top],
        *[F.when(lacks(inner, k), F.lit(f"missing retrieval_metadata.{k}")) for k in meta],
        F.when(F.coalesce(F.size(ranked), F.lit(0)) < 1, F.lit("all_ranked_chunks is empty")),
        *[F.when(F.exists(ranked, lambda c: lacks(c, k)), F.lit(f"chunk missing field: {k}")) for k in chunk],
    )
    return spans.withColumn("fault", fault)


SPAN_FIELDS = ("span_id", "trace_id", "retrieved_chunks", "retrieval_metadata", "llm_response")
META_FIELDS = ("query", "retrieval_method", "top_k", "retrieved_chunks", "all_ranked_chunks")
CHUNK_FIELDS = ("chunk_id", "rank", "dense_score", "sparse_score", "rrf_score")


def spans(ranked: DataFrame, selected: DataFrame, texts: DataFrame, method: str = "hybrid", top_k: int = 3) -> DataFrame:
    """span_id, body of each query: what a trace holds of its retrieval, as JSON. ranked: query_id, rank, chunk_id and the scores
    of every candidate; selected: query_id, rank, chunk_id of those that were handed on; texts: query_id, trace_id, query,
    response. A score that isn't there is null, not left out. A query without candidates has empty lists."""
    each = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "dense_score", "sparse_score", "rrf_score"))).alias("_all"))
    chosen = selected.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"]).alias("_chosen"))
    rows = texts.join(each, "query_id", "left").join(chosen, "query_id", "left")
    chosen = F.coalesce("_chosen", F.array().cast(rows.schema["_chosen"].dataType))
    every = F.coalesce("_all", F.array().cast(rows.schema["_all"].dataType))
    meta = F.struct("query", F.lit(method).alias("retrieval_method"), F.lit(top_k).alias("top_k"), chosen.alias("retrieved_chunks"), every.alias("all_ranked_chunks"))
    body = F.struct(F.col("query_id").cast("string").alias("span_id"), "trace_id", chosen.alias("retrieved_chunks"), meta.alias("retrieval_metadata"), F.struct(F.col("response").alias("text")).alias("llm_response"))
    return rows.select(F.col("query_id").alias("span_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def write_spans(rows: DataFrame, path: str) -> None:
    """One JSON line for each span (body)."""
    rows.select("body").write.mode("overwrite").text(path)


def read_spans(spark, path: str) -> DataFrame:
    """body, span of the lines under a path; span is a variant, null where a line isn't JSON."""
    lines = spark.read.schema("body string").text(path)
    return lines.select("body", F.try_parse_json("body").alias("span"))


def span_faults(rows: DataFrame) -> DataFrame:
    """rows (span: variant) with the first fault that is found by its paths, null for none. A field that is null is there."""
    at = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    lacks = lambda v, k: at(v, f"$.{k}").isNull()
    ranked = at(F.col("span"), "$.retrieval_metadata.all_ranked_chunks", "array<variant>")
    fault = F.coalesce(
        F.when(F.col("span").isNull(), F.lit("not JSON")), *[F.when(lacks(F.col("span"), k), F.lit(f"missing top-level field: {k}")) for k in SPAN_FIELDS],
        *[F.when(lacks(F.col("span"), f"retrieval_metadata.{k}"), F.lit(f"missing retrieval_metadata.{k}")) for k in META_FIELDS],
        F.when(F.coalesce(F.size(ranked), F.lit(0)) < 1, F.lit("all_ranked_chunks is empty")),
        *[F.when(F.exists(ranked, lambda c: lacks(c, k)), F.lit(f"chunk missing field: {k}")) for k in CHUNK_FIELDS],
    )
    return rows.withColumn("fault", fault)


def flat_spans(rows: DataFrame) -> DataFrame:
    """span_id, trace_id, query, top_k, retrieved, candidates, best_chunk, best_score as columns of spans without faults."""
    meta = lambda k, kind: F.try_variant_get("span", f"$.retrieval_metadata.{k}", kind)
    return rows.select(
        F.try_variant_get("span", "$.span_id", "string").alias("span_id"), F.try_variant_get("span", "$.trace_id", "string").alias("trace_id"), meta("query", "string").alias("query"),
        meta("top_k", "int").alias("top_k"), F.size(F.try_variant_get("span", "$.retrieved_chunks", "array<variant>")).alias("retrieved"),
        F.size(meta("all_ranked_chunks", "array<variant>")).alias("candidates"), meta("all_ranked_chunks[0].chunk_id", "string").alias("best_chunk"),
        meta("all_ranked_chunks[0].rrf_score", "double").alias("best_score"),
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """One row of verdict counts and the part that is safe: rows (verdict: SAFE, FLAGGED or null for invalid)."""
    valid = F.count_if(F.col("verdict").isNotNull())
    return rows.agg(
        F.count("*").alias("spans"), valid.alias("valid"), F.count_if(F.col("verdict") == "SAFE").alias("safe"),
        F.coalesce(F.round(F.count_if(F.col("verdict") == "SAFE") / F.nullif(valid, F.lit(0)), 3), F.lit(0.0)).alias("safe_rate"),
    )


def failure_counts(rows: DataFrame) -> DataFrame:
    """How often each criterion failed (failed: an array of names), most often first."""
    names = rows.select(F.explode("failed").alias("criterion"))
    return names.groupBy("criterion").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "criterion")


def lookup_any_case(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows with the columns of table (name, place, any more) whose name equals the key without regard to case; of names
    that are equal so the last by place counts."""
    rest = [c for c in table.columns if c not in ("name", "place")]
    last = table.groupBy(F.lower("name").alias("_k")).agg(F.max_by(F.struct(*rest), "place").alias("_v"))
    out = rows.join(last, F.lower(F.col(key)) == F.col("_k"), "left")
    return out.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in rest])


def label_category(rows: DataFrame, label: str, categories: DataFrame) -> DataFrame:
    """rows with category: the name (categories: name, place) that equals the label, else the first that does without regard
    to case, else the label itself."""
    exact = categories.select(F.col("name").alias("_exact")).distinct()
    folded = categories.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", "place").alias("_folded"))
    out = rows.join(exact, F.col(label) == F.col("_exact"), "left").join(folded, F.lower(F.col(label)) == F.col("_k"), "left")
    return out.select(*rows.columns, F.coalesce("_exact", "_folded", label).alias("category"))


def present_categories(rows: DataFrame, truths: DataFrame, category: str) -> DataFrame:
    """The rows whose category has a truth at all."""
    return rows.join(truths.select(category).distinct(), category, "left_semi")


def compare_trim(replies: DataFrame, trim) -> DataFrame:
    """Metrics of the same cached replies (prediction, truth, found) as they are and with trim() applied."""
    plain = extraction_metrics(scored_answers(replies)).withColumn("trimmed", F.lit(False))
    cut = extraction_metrics(scored_answers(replies.withColumn("prediction", trim(F.col("prediction"))))).withColumn("trimmed", F.lit(True))
    return plain.unionByName(cut)


def batches(files: DataFrame, size: int = 10, most: int = 30) -> DataFrame:
    """The first files by name (path), with the number of the batch that each is submitted in."""
    chosen = files.orderBy("path").limit(most)
    return chosen.withColumn("batch", F.expr(f"(row_number() OVER (ORDER BY path) - 1) div {size}"))  # `most` rows


def by_f1(categories: DataFrame, group: str) -> DataFrame:
    return categories.orderBy(F.desc("f1_mean"), group)
