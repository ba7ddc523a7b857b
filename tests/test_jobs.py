"""Jobs from submission to deletion, models, prompts and stores."""

import pytest
from pyspark.sql import functions as F

from briefmill.functions import prompts
from briefmill.operators import conflicts, evaluate, report, retrieval
from briefmill.plans.jobs import Conflict, Jobs, NotFound
from briefmill.plans.models import NOTHING, UNAVAILABLE, Models, embedder, replier
from briefmill.sources import stores
from briefmill.sources.stores import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_life_of_a_job(spark, store, tmp_path):
    (tmp_path / "a.txt").write_text("The governing law of this agreement is that of Delaware.\nPayment is due in thirty days.")
    (tmp_path / "b.txt").write_text("Employees may not compete for two years after the end.")
    (tmp_path / "c.xyz").write_text("?")
    jobs = Jobs(spark, store)
    job = jobs.submit(str(tmp_path / "*.*"))
    assert jobs.status(job)["state"] == "pending"
    with pytest.raises(Conflict):
        jobs.ask(job, "which law governs?")
    assert jobs.run(job)["state"] == "complete" and jobs.status(job)["documents"] == 2
    with pytest.raises(Conflict):
        jobs.run(job)
    assert "unsupported file type" in jobs.brief(job) and jobs.pages(job).count() == 3
    seen = []
    assert jobs.wait(job, look=seen.append)["state"] == "complete" and len(seen) == 1
    assert [r["state"] for r in jobs.history(job).collect()] == ["pending", "running", "running", "complete"]
    said = jobs.ask(job, "what is the governing law?")
    assert said["answer"].startswith(UNAVAILABLE) and "Delaware" in said["answer"] and said["sources"][0]["page_number"] == 1
    one = next(r["doc_id"] for r in jobs.pages(job).collect() if r["doc_id"].endswith("b.txt"))
    assert [s["document_id"] for s in jobs.ask(job, "who may compete?", one)["sources"]] == [one]
    assert jobs.ask(job, "law?", "no such document") == {"answer": NOTHING, "sources": []}
    with pytest.raises(ValueError):
        jobs.ask(job, "  ")
    assert jobs.delete(job) == {"pages": True, "briefs": True} and jobs.pages(job).count() == 0
    with pytest.raises(Conflict):
        jobs.delete(job)
    with pytest.raises(NotFound):
        jobs.status("unknown")
    with pytest.raises(ValueError):
        jobs.submit(" ")


def test_a_job_without_readable_files_fails(spark, store, tmp_path):
    (tmp_path / "c.xyz").write_text("?")
    jobs = Jobs(spark, store, Models())
    job = jobs.submit(str(tmp_path / "*.xyz"))
    assert jobs.run(job)["message"] == "no file could be read"
    waiting = jobs.submit(str(tmp_path / "*.xyz"))
    with pytest.raises(TimeoutError):
        jobs.wait(waiting, every=0.01, most=0.0)


def test_models(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, text string")
    got = embedder(lambda: lambda texts: [[float(len(t))] for t in texts], batch=1)(rows).orderBy("id").collect()
    assert [r["vector"] for r in got] == [[2.0], None, [3.0]]

    def load():
        calls = {}

        def model(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "never" or calls[prompt] < 2:
                raise OSError("busy")
            return prompt.upper()

        return model

    rows = spark.createDataFrame([("a",), ("never",), (None,)], "prompt string").coalesce(1)
    assert [r["raw"] for r in replier(load)(rows).collect()] == ["A", None, None]


def test_prompts(spark):
    row = spark.createDataFrame([("Cap", ["x", "y"], "t")], "c string, e array<string>, t string")
    text = row.select(
        prompts.extraction(F.col("c"), F.col("e"), {"Cap": "Look for sums."}).alias("a"), prompts.extraction(F.col("t"), F.col("e")).alias("b"),
        prompts.assessment(F.col("c"), F.col("t"), {"Cap": "Low caps."}).alias("d"), prompts.question(F.col("t"), F.col("e")).alias("q"),
        prompts.explanation(F.col("c"), F.lit(1), F.lit("u"), F.lit(2), F.lit("v")).alias("x"), prompts.narrative(F.col("t"), F.col("e"), F.array()).alias("n"),
    ).first()
    assert "Look for sums." in text["a"] and "Excerpt 2:\ny" in text["a"] and prompts.NO_HINT in text["b"] and "Low caps." in text["d"]
    assert text["q"].endswith("Excerpt 1:\nx\n\n---\n\nExcerpt 2:\ny") and "1: u\n2: v" in text["x"] and "x\ny" in text["n"]


def test_stores(spark, store, tmp_path):
    assert store.ensure("t", "doc_id string, n int", "doc_id") and not store.ensure("t", "doc_id string, n int", "doc_id")
    rows = spark.createDataFrame([("a/b", 1), ("c", 2)], "doc_id string, n int")
    store.replace(rows, "t")
    store.replace(rows.filter("n = 1").withColumn("n", F.lit(5)), "t")
    assert {tuple(r) for r in store.read("t", "n int, doc_id string").collect()} == {(5, "a/b"), (2, "c")}
    assert store.delete("t", "doc_id", "a/b") and not store.delete("t", "doc_id", "a/b")
    assert store.read("t", "n int, doc_id string").count() == 1 and store.drop("t") and not store.exists("t")
    asked = []

    def embed(some):
        asked.append(some.count())
        return some.withColumn("vector", F.array(F.length("text").cast("double")))

    texts = spark.createDataFrame([("x",), ("x",), ("yy",), (None,)], "text string")
    for _ in range(2):
        got = sorted((r["text"] or "", r["vector"]) for r in stores.embedded(store, texts, embed).collect())
        assert got == [("", None), ("x", [1.0]), ("x", [1.0]), ("yy", [2.0])]
    assert asked == [2, 0]
    pick = lambda: spark.createDataFrame([("7",), ("9",)], "id string")
    assert {r["id"] for r in stores.sample_ids(store, 2, pick).collect()} == {r["id"] for r in stores.sample_ids(store, 2, lambda: 1 / 0).collect()} == {"7", "9"}
    stores.save_results(spark.createDataFrame([(0.5,)], "recall double"), rows, str(tmp_path / "results"))
    assert {tuple(r) for r in stores.read_results(spark, str(tmp_path / "results")).select("doc_id", "n").collect()} == {("a/b", 1), ("c", 2)}
    examples = spark.createDataFrame([("A: b?", "text one", 1), ("A b", "other", 2), ("Z", "zed", 3), ("Y", "late", 4)], "title string, context string, place int")
    examples.write.parquet(str(tmp_path / "examples"))
    written = stores.write_samples(stores.load_examples(spark, str(tmp_path / "examples")), str(tmp_path / "samples"), 3)
    assert {tuple(r) for r in written.collect()} == {("A_b.txt", "A: b?"), ("Z.txt", "Z")}


def test_orders_and_defaults(spark):
    flags = spark.createDataFrame([(3, "high", "C"), (1, "low", "A"), (2, "high", "B"), (4, "medium", "A")], "place int, risk_level string, clause_type string")
    assert [r["place"] for r in report.first_high(flags, "place", 1).collect()] == [2]
    assert [r["place"] for r in report.narrative_conflicts(flags, "place").collect()] == [2, 3, 4, 1]
    assert report.in_order_of_sight(flags, "place").first()["names"] == ["A", "B", "C"]
    hits = spark.createDataFrame([(None, None, None), ("t", 2, "d")], "text string, page_number int, doc_id string")
    assert [tuple(r) for r in retrieval.payloads(hits, F.lit("asked")).collect()] == [("", 0, "asked"), ("t", 2, "d")]
    chosen = spark.createDataFrame([(1, "s", 2, 1, "best"), (1, "s", 1, 2, "first")], "query_id int, scope string, place int, score_rank int, chunk_id string")
    assert retrieval.source_chunk(chosen).first()["source_chunk_id"] == "first"
    files = spark.createDataFrame([(f"f{i:02}",) for i in range(40)], "path string")
    assert [r["n"] for r in evaluate.batches(files).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [10, 10, 10]
    replies = spark.createDataFrame([('```json\n{"risk_level": "high", "explanation": "So."}\n```',), ('{"risk_level": "high", "explanation": " "}',), (None,), ("no",)], "raw string")
    text, level = conflicts.explanation(F.col("raw"), F.lit("standing"))
    assert [tuple(r) for r in replies.select(text, level).collect()] == [("So.", "high")] + [("standing", "medium")] * 3
    ranked = spark.createDataFrame([(1, "s", 1, 10, 0.5), (1, "s", 2, 11, 0.4)], "query_id int, scope string, rank int, ordinal long, rrf_score double")
    stray = spark.createDataFrame([(1, "s", 12)], "query_id int, scope string, ordinal long")
    assert [retrieval.audit(ranked, x).first()["selected_are_ranked"] for x in (ranked.filter("rank = 1"), stray)] == [True, False]
    answers = spark.createDataFrame([("1. Term. two years", "two years", True), ("two years", "two years", True)], "prediction string, truth string, found boolean")
    both = evaluate.compare_trim(answers, lambda c: F.regexp_replace(c, "^1. Term. ", "")).orderBy("trimmed").collect()
    assert both[0]["f1_mean"] < both[1]["f1_mean"] == 1.0
    truths = spark.createDataFrame([("A",)], "clause_type string")
    assert evaluate.present_categories(flags, truths, "clause_type").count() == 2
