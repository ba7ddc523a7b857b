"""Review operators on the fixtures of their rules."""

import pytest
from pyspark.sql import functions as F

from briefmill.functions import fixed, text
from briefmill.operators import chunks, clauses, conflicts, evaluate, graph, report, retrieval, risk

CLAUSE = "document_id string, clause_type string, found boolean, clause_text string, normalized_value string, confidence double, source_chunk_id string"


@pytest.fixture(scope="module")
def golden(spark):
    values = {
        "Governing Law": ("Delaware", "New York"), "Liability Cap": ("12 months fees", "6 months fees"), "Confidentiality": ("5 years", "3 years"),
        "Payment Terms": ("30 days", "45 days"), "Termination for Convenience": ("30 days", None),
    }
    rows = [(d, c, v[i] is not None, v[i] and f"Acme Corp. and Beta LLC agree on {v[i]}.", v[i], 0.9, f"{d}/{c}") for c, v in values.items() for i, d in enumerate(("contract-a", "contract-b"))]
    rows.append(("contract-b", "Uncapped Liability", True, "Liability is unlimited.", "unlimited", 0.9, "x"))
    return spark.createDataFrame(rows, CLAUSE)


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "want"), [
    ("thirty (30) days", "30 days"), ("State of Delaware", "delaware"), ("New York State", "new york"), ("$1,000,000", "1000000"),
    ("one million dollars", "1000000"), ("1.5 million", "1500000"), ("500k", "500000"), ("1.9", "1"), ("twenty-five", "20-5"), ("seventy", "seventy"),
    ("12 months", "12 months"), ("1e6", "1e6"), ("", ""),
])
def test_normal_form(spark, given, want):
    assert one(spark, text.normal_form, given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("12.1 INDEMNIFICATION. The Company shall pay. 12.2", "The Company shall pay."), ("LICENSEE shall not assign", "LICENSEE shall not assign"),
    ("Article 5. Change of Control. Acme shall notify", "Acme shall notify"), ("3 months of notice", "3 months of notice"), (None, None), ("", ""), ("3. ", "3."),
])
def test_trim_clause(spark, given, want):
    assert one(spark, text.trim_clause, given) == want


def test_parties_headings_fences(spark):
    assert one(spark, text.parties, "Between Acme Corp., TechVentures Inc. and Acme Corp.; also GlobalSoft LLC.") == ["Between Acme Corp", "TechVentures Inc", "Acme Corp", "GlobalSoft LLC"]
    long = "x" * 90
    assert one(spark, text.merge_headings, f"ONE\n\nTWO\n\n{long}\n\nend") == f"ONE\n\nTWO\n\n{long}\n\nend"
    assert one(spark, text.merge_headings, "A\n\n \n\nB") == "A\n\nB"
    assert one(spark, text.strip_fence, "```json\n{}\n```") == "{}" and one(spark, text.strip_fence_loose, "```json {}\n```") == "{}"
    assert one(spark, text.file_name, "A/B (C) d-e") == "AB_C_d-e.txt"


def test_golden_conflicts(golden):
    value = {(r["clause_type"], r["value_a"], r["value_b"]) for r in conflicts.value_conflicts(golden).collect()}
    assert len(value) == 4 and ("Governing Law", "Delaware", "New York") in value
    absence = [tuple(r) for r in conflicts.absence_conflicts(golden).collect()]
    assert absence == [("Termination for Convenience", "contract-a", "contract-b", "30 days", conflicts.ABSENT)]
    assert conflicts.contradictions(golden).count() == 5


def test_risk_rules(spark):
    cases = {
        ("Governing Law", False, 0.0): "high", ("Limitation of Liability", False, 0.0): "high", ("Termination for Convenience", False, 0.0): "medium",
        ("Source Code Escrow", False, 0.0): None, ("Uncapped Liability", True, 0.9): "high", ("Governing Law", True, 0.3): "medium",
        ("Payment Terms", True, 0.95): None, ("Document Name", False, 0.0): None, ("Payment Terms", True, 0.4): None,
    }
    rows = [(str(i), c, f, None, None, p, "s") for i, (c, f, p) in enumerate(cases)]
    got = {r["document_id"]: r["risk_level"] for r in risk.flags(spark.createDataFrame(rows, CLAUSE)).collect()}
    assert got == {str(i): level for i, level in enumerate(cases.values()) if level}


def test_one_flag_at_most(golden):
    assert risk.flags(golden).groupBy("document_id", "clause_type").count().filter("count > 1").isEmpty()
    assert set(fixed.PRESENCE).isdisjoint(fixed.MISSING_LEVEL) and set(fixed.PRESENCE).isdisjoint(fixed.ASSESSED)


def test_graph(golden):
    edges = graph.edges(golden)
    assert edges.filter("edge_type = 'HAS_CLAUSE'").count() == 11
    assert {r[0] for r in edges.filter("edge_type = 'GOVERNED_BY'").select("entity").collect()} == {"Delaware", "New York"}
    assert graph.same_category_other_entity(edges).count() == 1
    gone = golden.filter("document_id = 'contract-a'").select("document_id")
    kept, orphans = graph.delete_documents(edges, gone)
    assert kept.filter("document_id = 'contract-a'").isEmpty() and ("GOVERNED_BY", "Delaware") in {tuple(r) for r in orphans.collect()}


def test_latest_wins(spark):
    rows = spark.createDataFrame([("d", "c", 1, "old"), ("d", "c", 2, None), ("e", "c", 1, "x")], "document_id string, clause_type string, seq int, v string")
    assert sorted((r["document_id"], r["v"]) for r in clauses.latest(rows, "seq").collect()) == [("d", None), ("e", "x")]


def test_replies(spark):
    raws = ['{"found": true, "clause_text": "12.1 GOVERNING LAW. Text", "normalized_value": "x", "confidence": 0.8}', "```json\n{\"found\": \"false\"}\n```", "[1]", "no json", None, '{"found": true, "confidence": null}']
    got = clauses.parse_replies(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()
    assert [r["found"] for r in got] == [True, False, False, False, False, True]
    assert [r["malformed"] for r in got] == [False, False, True, True, False, False]
    assert got[0]["clause_text"] == "Text"


def test_windows_tile_pages(spark):
    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([("d", "\n".join(" ".join(words[i : i + 100]) for i in range(0, 5000, 100)) + "\n\n"), ("e", " \n"), ("f", None)], "doc_id string, text string")
    parents = chunks.parents(chunks.pages(docs))
    got = parents.orderBy("page_number", "page_parent_index").collect()
    assert sum((r["tokens"] for r in got), []) == words and [len(r["tokens"]) for r in got] == [2048, 2048, 904]
    child = chunks.children(parents).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in child] == list(range(len(child)))
    assert len(child) == 2 * (-(-(2048 - 256) // 205) + 1) + -(-(904 - 256) // 205) + 1


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "s", 10, 0.9, 0), (1, "s", 11, 0.8, 1)], "query_id int, scope string, ordinal int, dense_score double, dense_rank int")
    sparse = spark.createDataFrame([(1, "s", 10, 3.0, 0), (1, "s", 12, 2.0, 1), (2, "s", 10, 1.0, 0)], "query_id int, scope string, ordinal int, sparse_score double, sparse_rank int")
    got = {(r["query_id"], r["ordinal"]): r["rrf_score"] for r in retrieval.fuse(dense, sparse).collect()}
    assert got == {(1, 10): 2 / 60, (1, 11): 1 / 61, (1, 12): 1 / 61}
    assert (2, 10) in {(r["query_id"], r["ordinal"]) for r in retrieval.fuse(dense, sparse, need_dense=False).collect()}
    said = {r["ordinal"]: r["reason_for_rank"] for r in retrieval.ranking_metadata(retrieval.fuse(dense, sparse)).collect()}
    assert said[10] == "Dense: 0.9000 (rank 0), Sparse: 3.0000 (rank 0) → RRF: 0.033333" and said[11] == "RRF: 0.016393 (single-signal)"


def test_spans_and_f1(spark):
    from briefmill.plans.catalogue import span_validation

    assert [r["fault"] for r in span_validation(spark, "").orderBy("span_id").collect()] == [
        None, "missing top-level field: trace_id", "missing retrieval_metadata.retrieval_method", "all_ranked_chunks is empty", "chunk missing field: dense_score"
    ]
    rows = spark.createDataFrame([("The cat, sat.", "the cat sat down", True), ("", "x", False), (None, "x", False)], "prediction string, truth string, found boolean")
    got = [(round(r["f1"], 6), r["substring"]) for r in evaluate.scored_answers(rows).collect()]
    assert got == [(round(2 * 1 * 0.75 / 1.75, 6), False), (0.0, False), (0.0, False)]


def test_job_to_brief(spark, tmp_path):
    from briefmill.plans.pipeline import run
    from briefmill.sources.files import load_pages

    (tmp_path / "a.txt").write_text("Governing law: Delaware.\n\nPayment terms net 30 days.")
    (tmp_path / "b.txt").write_text("Governing law: New York.")
    (tmp_path / "c.xyz").write_text("?")

    def extract(rows):
        law = F.col("clause_type") == "Governing Law"
        value = F.when(F.col("context").contains("Delaware"), "Delaware").otherwise("New York")
        reply = F.to_json(F.struct(F.lit(True).alias("found"), F.col("context").alias("clause_text"), value.alias("normalized_value"), F.lit(0.9).alias("confidence")))
        return rows.withColumn("raw", F.when(law, reply))

    job = run(spark, "j1", load_pages(spark, str(tmp_path)), extract, "2020-01-01 00:00 UTC")
    text = job.brief.first()["brief"]
    assert "Documents reviewed:** 2" in text and "unsupported file type" in text and "| MEDIUM | Governing Law |" in text
    assert job.clauses.count() == 92 and job.contradictions.count() == 1
    down = run(spark, "j2", load_pages(spark, str(tmp_path)), have_index=False, have_graph=False).brief.first()["brief"]
    assert "3 error(s)" in down and "No risk flags detected" in down


def test_job_sees_a_clause_outside_the_best_chunk(spark):
    """Page 2 has most words of the query, page 6 has the clause."""
    from briefmill.plans.pipeline import run

    filler = [" ".join(f"w{p}x{i}" for i in range(300)) for p in range(8)]
    filler[1] += " governing law jurisdiction choice of law state"
    filler[5] += " this agreement follows the law of Delaware"
    pages = spark.createDataFrame([("d", p + 1, t) for p, t in enumerate(filler)], "doc_id string, page_number int, text string")

    def extract(rows):
        seen = (F.col("clause_type") == "Governing Law") & F.col("context").contains("law of Delaware")
        return rows.withColumn("raw", F.when(seen, F.lit('{"found": true, "clause_text": "law of Delaware", "normalized_value": "Delaware", "confidence": 0.9}')))

    job = run(spark, "j", pages, extract)
    assert [r["found"] for r in job.clauses.filter("clause_type = 'Governing Law'").collect()] == [True]


def test_contexts_against_plain(spark):
    import hashlib
    import math
    import random
    from collections import Counter, defaultdict

    from briefmill.functions import fixed
    from briefmill.operators import chunks, clauses
    from briefmill.plans.pipeline import BETWEEN, contexts

    rng = random.Random(1)
    vocab = sorted({w for q in fixed.CATEGORIES.values() for w in q.split()}) + [f"f{i}" for i in range(200)]
    rows = [(d, p, " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 2600 if p == 2 else 400)))) for d in ("a", "b") for p in range(1, 8)]
    pages = spark.createDataFrame([*rows, ("none", 1, " ")], "doc_id string, page_number int, text string")
    window = chunks.parents(pages)
    text = {r["parent_id"]: " ".join(r["tokens"]) for r in window.collect()}
    child = defaultdict(list)
    for r in sorted(chunks.children(window).collect(), key=lambda r: r["chunk_index"]):
        child[r["doc_id"]].append((r, Counter(t.lower() for t in r["tokens"])))

    def vector(count):
        v = [0.0] * 64
        for t, n in count.items():
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += n
        return v

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True))

    got = {(r["document_id"], r["clause_type"]): r for r in contexts(pages, clauses.categories(spark)).collect()}
    assert len(got) == 3 * len(fixed.CATEGORIES) and got["none", "Parties"]["context"] is None
    for d, own in child.items():
        dense = [vector(c) for _, c in own]
        for category, query in fixed.CATEGORIES.items():
            scores, more = defaultdict(float), fixed.ALTERNATES.get(category, [])
            for q in [query, *more]:
                asked = Counter(q.lower().split())
                v = vector(asked)
                near = [dot(v, x) / (math.sqrt(dot(v, v)) * math.sqrt(dot(x, x))) for x in dense]
                for k, i in enumerate(sorted(range(len(own)), key=lambda i: (-near[i], i))[:20]):
                    scores[i] += 1 / (60 + k)
                shared = {i: sum(n * c[t] for t, n in asked.items()) for i, (_, c) in enumerate(own) if any(t in c for t in asked)}
                for k, i in enumerate(sorted(shared, key=lambda i: (-shared[i], i))[:20]):
                    scores[i] += 1 / (60 + k)
            best = {}
            for i in sorted(scores, key=lambda i: (-round(scores[i], 9), i)):
                best.setdefault(own[i][0]["parent_id"], own[i][0])
            chosen = sorted(list(best.values())[: 5 if more else 3], key=lambda r: (r["page_number"], r["page_parent_index"]))
            r = got[d, category]
            assert r["contexts"] == [text[c["parent_id"]] for c in chosen], (d, category)
            assert r["context"] == BETWEEN.join(r["contexts"]) and r["source_chunk_id"] == chosen[0]["chunk_id"]


def test_streamed_files(spark, tmp_path):
    from briefmill.streaming.ingest import ingest_texts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two three")
    query = ingest_texts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
