"""Ingesting files as they arrive and change: an extension, run with the same batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from briefmill.operators.chunks import children, pages, parents
from briefmill.sources.page_source import register
from briefmill.sources.stores import Buckets, Store

CHUNKS = "doc_id string, page_number int, page_parent_index int, parent_id string, child_index int, tokens array<string>, chunk_index int, token_count int, chunk_id string"
VERSIONS = "doc_id string, modified long, content_md5 string, pages int, error string"


def ingest_texts(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk each text file that appears under folder and write its chunks under out, one partition for each batch."""
    texts = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    texts = texts.selectExpr("_metadata.file_path AS doc_id", "value AS text")

    def batch(rows: DataFrame, number: int) -> None:
        children(parents(pages(rows))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Ingest:
    """Chunks and versions of a folder's documents, kept in a store by hash of the document.

    A file that arrives twice with one content changes nothing; one that changes gives way to its last version; one that
    can't be read any more loses its chunks and has its error. A batch that is run again, after a failure or a restart,
    leaves the same tables."""

    def __init__(self, store: Store, name: str = "ingested", buckets: int = 64):
        self.store = store
        self.chunks = Buckets(store, f"{name}/chunks", "doc_id", CHUNKS, buckets)
        self.versions = Buckets(store, f"{name}/versions", "doc_id", VERSIONS, buckets)

    def batch(self, rows: DataFrame, number: int = 0) -> None:
        """The pages of files (as the page source has them)."""
        found = rows.groupBy("doc_id").agg(F.max("modified").alias("modified"), F.max("content_md5").alias("content_md5"), F.coalesce(F.max("total_pages"), F.lit(0)).alias("pages"), F.max("error").alias("error"))
        held = self.versions.read().select("doc_id", F.col("modified").alias("_m"), F.col("content_md5").alias("_c"), F.col("error").alias("_e"))
        both = found.join(held, "doc_id", "left")
        newer = F.col("_m").isNull() | (F.col("modified") > F.col("_m"))
        # the version is written last, so one that is there has its chunks
        changed = both.filter(newer & ~(F.col("content_md5").eqNullSafe(F.col("_c")) & F.col("_e").isNull() & F.col("error").isNull() & F.col("_m").isNotNull()))
        changed = changed.select("doc_id", "modified", "content_md5", F.col("pages").cast("int").alias("pages"), "error")
        at = f"{self.chunks.name}-batch/{number}"
        self.store.drop(at)
        self.store.append(changed, at)  # read more than once, and after the tables have changed
        changed = self.store.read(at, VERSIONS)
        good = rows.filter("page_number IS NOT NULL").join(changed.select("doc_id"), "doc_id", "left_semi")
        made = children(parents(good.select("doc_id", "page_number", "text")))
        self.chunks.upsert(made.select(*[c.split()[0] for c in CHUNKS.split(", ")]), changed.select("doc_id"))
        self.versions.upsert(changed)
        self.store.drop(at)

    def start(self, spark: SparkSession, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a folder; by default until what is there has been read."""
        register(spark)
        stream = spark.readStream.format("briefmill_pages").option("manifests", f"{checkpoint}/manifests").load(folder)
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(**(trigger or {"availableNow": True})).start()

    def forget(self, documents: DataFrame) -> None:
        """Remove documents (doc_id) and their chunks."""
        self.chunks.delete(documents)
        self.versions.delete(documents)
