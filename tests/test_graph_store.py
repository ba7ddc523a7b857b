"""The kept graph against one that is made anew, through changes and failures."""

import random

import pytest
from pyspark.sql import functions as F

from briefmill.operators import graph
from briefmill.sources.graph_store import GraphStore
from briefmill.sources.stores import Store

CLAUSES = "document_id string, clause_type string, found boolean, clause_text string, normalized_value string"


def state(kept):
    return {tuple(r) for r in kept.edges().collect()}, {tuple(r) for r in kept.references().collect()}, {tuple(r) for r in kept.orphans().collect()}


def test_changes_equal_recomputation(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    kept = GraphStore(Store(spark, str(tmp_path)), buckets=4)
    held, seen = {}, set()
    clause = lambda d: [(d, c, rng.random() < 0.8, rng.choice(["", "between Acme Corp. and Beta Holdings Ltd. today"]), rng.choice("uvwxyz")) for c in ("Governing Law", "Parties", "Renewal Term")]
    for step in range(5):
        some = rng.sample([f"d{i}" for i in range(12)], 5)
        if step in (2, 4):
            kept.delete(spark.createDataFrame([(d,) for d in some], "document_id string"))
            held = {d: rows for d, rows in held.items() if d not in some}
        else:
            new = {d: clause(d) for d in some}
            held |= new
            rows = spark.createDataFrame([r for rs in new.values() for r in rs], CLAUSES)
            if step == 3:  # killed between the edges and the counts; then again, before the log says so
                real = graph.changed_references
                monkeypatch.setattr(graph, "changed_references", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    kept.upsert(rows)
                monkeypatch.setattr(graph, "changed_references", real)
                change = kept.store.records("graph/log")[-1]["change"]
                put, drop = kept.store.put, kept.store.drop
                kept.store.put = kept.store.drop = lambda *a: None
                kept.recover()
                kept.store.put, kept.store.drop = put, drop
                assert kept.store.records("graph/log")[-1] == {"change": change, "done": False}
                kept.recover()
            else:
                kept.upsert(rows)
        every = spark.createDataFrame([r for rs in held.values() for r in rs], CLAUSES)
        edges = {tuple(r) for r in graph.edges(every).select("document_id", "clause_type", "edge_type", "entity").collect()}
        refs = {tuple(r) for r in graph.references(graph.edges(every)).collect()}
        seen |= {r[:2] for r in refs}
        assert state(kept) == (edges, refs, seen - {r[:2] for r in refs}), step
    kept.forget()
    assert state(kept) == (edges, refs, set())
    kept.delete(every.select("document_id"))
    assert state(kept)[:2] == (set(), set())
    kept.delete(spark.createDataFrame([("no such",)], "document_id string"))
    kept.upsert(spark.createDataFrame([], CLAUSES))
    assert state(kept)[0] == set() and kept.store.read("graph/changes", "x int").select(F.lit(1)).count() == 0
