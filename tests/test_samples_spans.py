"""Samples by groups, and spans that are written, read and checked as variants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from briefmill.operators import evaluate


@pytest.mark.parametrize("held", [200_000, 30, 1])
def test_least_of_groups_and_what_is_handed_on(spark, held):
    rng = random.Random(5)
    rows = [(rng.choice(["a"] * 20 + ["b", "c", None]), rng.randint(0, 50), i) for i in range(600)]
    table = spark.createDataFrame(rows, "g string, v long, i long").repartition(4)
    some = evaluate.least_of_groups(table, "g", ["v", "i"], 7, held).collect()
    for group in ("a", "b", "c", None):
        want = sorted((v, i) for g, v, i in rows if g == group)[:7]
        assert sorted((r["v"], r["i"]) for r in some if r["g"] == group)[:7] == want
    if held == 200_000:  # groups x tasks x 7 at most
        assert len(some) <= 4 * 4 * 7
    assert evaluate.least_of_groups(table.limit(0), "g", ["v", "i"], 7).collect() == []


def test_stratified_sample_as_by_sorting(spark):
    import hashlib

    rng = random.Random(6)
    rows = [(rng.choice(["x"] * 9 + ["y", "z", None]), i) for i in range(400)] + [("x", 7)]
    got = evaluate.stratified_sample(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", "k", 10)
    want = []
    for g in ("x", "y", "z", None):
        of = sorted((hashlib.md5(f"42/{k}".encode()).hexdigest(), k) for h, k in rows if h == g)
        want += [(g, k) for _, k in of[:3]]
    assert [(r["g"], r["k"]) for r in got.collect()] == sorted(want, key=lambda r: r[1])[:10]


def test_spans_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, "c9", 0.5, None, 0.03), (1, 2, "c4", None, 2.0, 0.02), (2, 1, "c1", 0.1, 1.0, 0.01)], "query_id long, rank int, chunk_id string, dense_score double, sparse_score double, rrf_score double")
    texts = spark.createDataFrame([(1, "t", 'a "quoted" question', "yes"), (2, "t", "b", None), (3, "t", "c", "no")], "query_id long, trace_id string, query string, response string")
    evaluate.write_spans(evaluate.spans(ranked, ranked.filter("rank = 1"), texts), str(tmp_path / "spans"))
    rows = evaluate.span_faults(evaluate.read_spans(spark, str(tmp_path / "spans")))
    bodies = {json.loads(r["body"])["span_id"]: json.loads(r["body"]) for r in rows.collect()}
    first = bodies["1"]["retrieval_metadata"]
    assert first["query"] == 'a "quoted" question' and first["all_ranked_chunks"][0] == {"rank": 1, "chunk_id": "c9", "dense_score": 0.5, "sparse_score": None, "rrf_score": 0.03}
    faults = {r["id"]: r["fault"] for r in rows.select(F.try_variant_get("span", "$.span_id", "string").alias("id"), "fault").collect()}
    assert faults == {"1": None, "2": None, "3": "all_ranked_chunks is empty"}
    flat = {r["span_id"]: r for r in evaluate.flat_spans(rows.filter("fault IS NULL")).collect()}
    assert (flat["1"]["candidates"], flat["1"]["retrieved"], flat["1"]["best_chunk"], flat["1"]["best_score"], flat["2"]["top_k"]) == (2, 1, "c9", 0.03, 3)


def test_variants_find_the_faults_that_text_does(spark):
    from briefmill.plans.catalogue import SPANS

    more = [*SPANS, "no JSON", "{}", '{"span_id": null, "trace_id": 1, "retrieved_chunks": 2, "retrieval_metadata": 3, "llm_response": 4}']
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(more)], "i int, body string").withColumn("span", F.try_parse_json("body"))
    got = [r["fault"] for r in evaluate.span_faults(rows).orderBy("i").collect()]
    want = [r["fault"] for r in evaluate.validate_spans(rows.drop("span").limit(len(SPANS))).orderBy("i").collect()]
    assert got[: len(SPANS)] == want
    assert got[len(SPANS) :] == ["not JSON", "missing top-level field: span_id", "missing retrieval_metadata.query"]
