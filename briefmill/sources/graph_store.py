"""The entity graph kept in a store: edges by document and reference counts by entity, both in buckets by hash.

A change of some documents reads and rewrites the buckets of these documents and of the entities that they lose or gain,
not the graph. It is written down before it is applied, and every step can be done again, so a change that was killed
half way is finished by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.operators import graph
from briefmill.sources.stores import Store

EDGES = "document_id string, clause_type string, edge_type string, entity string"
REFS = "edge_type string, entity string, refs long, last string"


class GraphStore:
    """Documents' ids are kept as text. An entity without references stays in the table of counts, at 0, until forget()."""

    def __init__(self, store: Store, name: str = "graph", buckets: int = 64):
        self.store, self.name, self.buckets = store, name, buckets

    def _bucket(self, *columns: str) -> F.Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.read(f"{self.name}/{name}", f"{schema}, bucket int")

    def edges(self) -> DataFrame:
        return self._table("edges", EDGES).drop("bucket")

    def references(self) -> DataFrame:
        """edge_type, entity, refs of the entities that edges lead to."""
        return self._table("refs", REFS).filter("refs > 0").select("edge_type", "entity", "refs")

    def orphans(self) -> DataFrame:
        """edge_type, entity of those that had edges and have none."""
        return self._table("refs", REFS).filter("refs = 0").select("edge_type", "entity")

    def upsert(self, clauses: DataFrame) -> None:
        """The clauses' documents have these edges from now on, and none of those that they had."""
        rows = clauses.withColumn("document_id", F.col("document_id").cast("string"))
        self._change(rows.select("document_id").distinct(), graph.edges(rows))

    def delete(self, documents: DataFrame) -> None:
        self._change(documents.select(F.col("document_id").cast("string")).distinct(), self.edges().limit(0))

    def _change(self, documents: DataFrame, after: DataFrame) -> None:
        self.recover()
        change = uuid.uuid4().hex
        at = f"{self.name}/changes/{change}"
        self.store.append(documents.withColumn("bucket", self._bucket("document_id")), f"{at}/documents")
        documents = self._read(change, "documents", "document_id string, bucket int")
        self.store.append(after.select(*[c.split()[0] for c in EDGES.split(", ")]), f"{at}/after")
        touched = [r["bucket"] for r in documents.select("bucket").distinct().collect()]  # as many as buckets
        before = self._table("edges", EDGES).filter(F.col("bucket").isin(touched)).join(documents.select("document_id"), "document_id", "left_semi")
        changes = graph.reference_changes(before, self._read(change, "after", EDGES)).withColumn("bucket", self._bucket("edge_type", "entity"))
        self.store.append(changes, f"{at}/changes")
        self.store.put(f"{self.name}/log", {"change": change, "done": False})
        self._apply(change)

    def _read(self, change: str, part: str, schema: str) -> DataFrame:
        return self.store.read(f"{self.name}/changes/{change}/{part}", schema)

    def _apply(self, change: str) -> None:
        documents = self._read(change, "documents", "document_id string, bucket int")
        touched = [r["bucket"] for r in documents.select("bucket").distinct().collect()]
        rest = self._table("edges", EDGES).filter(F.col("bucket").isin(touched)).join(documents.select("document_id"), "document_id", "left_anti")
        rows = rest.unionByName(self._read(change, "after", EDGES).withColumn("bucket", self._bucket("document_id")))
        self._rewrite("edges", rows, touched)
        changes = self._read(change, "changes", "edge_type string, entity string, change long, bucket int")
        touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
        refs = self._table("refs", REFS).filter(F.col("bucket").isin(touched)).drop("bucket")
        self._rewrite("refs", graph.changed_references(refs, changes.drop("bucket"), change).withColumn("bucket", self._bucket("edge_type", "entity")), touched)
        self.store.put(f"{self.name}/log", {"change": change, "done": True})
        self.store.drop(f"{self.name}/changes/{change}")

    def _rewrite(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Buckets are replaced by rows; a touched one that has no rows any more goes."""
        path = f"{self.name}/{name}"
        have = {r["bucket"] for r in rows.select("bucket").distinct().collect()} if touched else set()
        if have:
            self.store.replace(rows.repartition("bucket"), path, "bucket")
        for bucket in set(touched) - have:
            self.store.delete(path, "bucket", str(bucket))

    def recover(self) -> None:
        """Finish a change that was written down but not applied to its end."""
        log = self.store.records(f"{self.name}/log")
        done = {r["change"] for r in log if r["done"]}
        for r in log:
            if r["change"] not in done:
                self._apply(r["change"])

    def forget(self) -> None:
        """Remove the entities without references from the table of counts."""
        rows = self._table("refs", REFS)
        touched = [r["bucket"] for r in rows.filter("refs = 0").select("bucket").distinct().collect()]
        self._rewrite("refs", rows.filter(F.col("bucket").isin(touched) & (F.col("refs") > 0)), touched)
