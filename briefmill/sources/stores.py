"""Tables that jobs, caches and evaluations keep, under one folder that all machines share."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions.text import file_name

RESPONSES = "model string, prompt_md5 string, raw string"
EMBEDDINGS = "key string, vector array<double>"
CHUNKS = "doc_id string, chunk_id string, parent_id string, chunk_index int, page_number int, text string, parent_text string"


#: With this, Spark removes a query's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Store:
    """Parquet tables by name under a folder. Rows of a document are a partition, so that they are replaced or deleted without
    reading others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def under(self, name: str, *keys: str) -> str:
        """The name of a table of its own for keys, so that reading one key's opens no other's files."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join([name, *map(escape, keys)])

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, name: str, record: dict) -> None:
        """Add a small record (a job's note, say) to those of a name. It appears whole or not at all."""
        at = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        draft, fs = self._files(f"{self.path(name)}/_{at}")  # names with _ are passed over
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        fs.rename(draft, self._files(f"{self.path(name)}/{at}.json")[0])

    def records(self, name: str) -> list[dict]:
        """The records of a name, in the order in which they were put."""
        folder, fs = self._files(self.path(name))
        if not fs.exists(folder):
            return []
        files = {f.getPath().getName(): f.getPath() for f in fs.listStatus(folder)}
        found = []
        for file in sorted(f for f in files if f.endswith(".json")):
            stream = fs.open(files[file])
            try:
                found.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return found

    def keys(self, name: str) -> list[str]:
        """The keys that under() has been given for a name, in order."""
        folder, fs = self._files(self.path(name))
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescape(f.getPath().getName()) for f in fs.listStatus(folder) if f.isDirectory()) if fs.exists(folder) else []

    def exists(self, name: str) -> bool:
        p, fs = self._files(self.path(name))
        return fs.exists(p)

    def ensure(self, name: str, schema: str, by: str | None = None) -> bool:
        """Make the table if it isn't there; whether it was made."""
        if self.exists(name):
            return False
        self.append(self.spark.createDataFrame([], schema), name, by)
        p, fs = self._files(self.path(name))
        fs.mkdirs(p)
        return True

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def append(self, rows: DataFrame, name: str, by: str | None = None) -> None:
        """Add rows. What was shuffled for them is removed then, as what reads them on reads the table."""
        out = rows.write.mode("append").option("compression", "zstd")
        with cleaned(self.spark):
            (out.partitionBy(by) if by else out).parquet(self.path(name))

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """keep(rows) writes rows and reads them back; at the end they are removed, so nothing lazy that reads them may leave."""
        at = self.under("scratch", uuid.uuid4().hex)

        def keep(rows: DataFrame) -> DataFrame:
            name = f"{at}/{uuid.uuid4().hex}"
            self.append(rows, name)
            return self.spark.read.schema(rows.schema).parquet(self.path(name))

        try:
            yield keep
        finally:
            self.drop(at)

    def replace(self, rows: DataFrame, name: str, by: str = "doc_id") -> None:
        """Write rows; the partitions that they are of are replaced, others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(name))

    def delete(self, name: str, by: str, value: str) -> bool:
        """Remove one partition (a document's chunks, say); whether there was one."""
        name_of = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
        p, fs = self._files(f"{self.path(name)}/{by}={name_of}")
        return bool(fs.exists(p) and fs.delete(p, True))

    def drop(self, name: str) -> bool:
        p, fs = self._files(self.path(name))
        return bool(fs.exists(p) and fs.delete(p, True))


class Buckets:
    """A table whose rows are in buckets by the hash of a key (a document's id, say): a change reads and rewrites the buckets of
    its keys, and there are no more folders than buckets, however many keys."""

    def __init__(self, store: Store, name: str, key: str, schema: str, buckets: int = 64):
        self.store, self.name, self.key, self.schema, self.buckets = store, name, key, schema, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _table(self) -> DataFrame:
        return self.store.read(self.name, f"{self.schema}, bucket int")

    def read(self) -> DataFrame:
        return self._table().drop("bucket")

    def upsert(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """rows take the place of all rows of their keys, and of those of `keys`, which may have none any more. Written anew, the
        same rows change nothing, so a change that was killed can be repeated."""
        keys = self._bucketed(rows.select(self.key) if keys is None else keys.select(self.key).unionByName(rows.select(self.key))).distinct()
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # as many as buckets
        kept = self._table().filter(F.col("bucket").isin(touched)).join(keys.select(self.key), self.key, "left_anti")
        columns = [c for c in kept.columns]
        out = kept.unionByName(self._bucketed(rows).select(*columns))
        have = {r["bucket"] for r in out.select("bucket").distinct().collect()} if touched else set()
        if have:
            self.store.replace(out.repartition("bucket"), self.name, "bucket")
        for bucket in set(touched) - have:
            self.store.delete(self.name, "bucket", str(bucket))

    def delete(self, keys: DataFrame) -> None:
        self.upsert(self.read().limit(0), keys)


def shared_store(spark: SparkSession, name: str) -> Store:
    """A store beside the session's checkpoints. Where spark.checkpoint.dir is unset a local session gets one beside its
    warehouse; on a cluster that might be a machine's own disk, so it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return Store(spark, (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/{name}")


#: Prompts that are asked before their replies are kept: what a job that is killed asks again at most.
WAVE = 5_000


def replies(
    store: Store, rows: DataFrame, model: str, ask: Callable[[DataFrame], DataFrame], table: str = "llm_responses", wave: int = WAVE,
    make: Callable[[DataFrame, DataFrame], DataFrame] | None = None, reads: DataFrame | None = None, by: str = "prompt_md5", sees: tuple[str, ...] = (),
) -> DataFrame:
    """rows (prompt) with raw: replies that the store holds for the model, and those that ask() gives now, which are kept.

    Equal prompts are asked for once, with what else stands in one of their rows. They are asked in waves, by their hash,
    and each wave's replies are kept as it ends, so that a job that is killed asks at most one wave again. A missing reply
    isn't kept, so that it is asked for again. A null prompt has no reply.

    With make, rows have prompt_md5 alone, and a wave's prompts are made when it is asked: make(some rows, their reads) adds
    prompt and what else the model sees, from the columns `sees`. Rows and reads go to waves by the column `by`, which both have."""
    keyed = rows if make else rows.withColumn("prompt_md5", F.md5("prompt"))
    held = store.read(table, RESPONSES).filter(F.col("model") == model)
    asked = keyed.select(*sees, by, "prompt_md5") if make else keyed
    asked = asked.filter("prompt_md5 IS NOT NULL").dropDuplicates(["prompt_md5"]).join(held, "prompt_md5", "left_anti")
    with cleaned(store.spark):
        many = asked.count()
    waves = -(-many // wave)
    dealt = store.under("asking", uuid.uuid4().hex)

    def deal(some: DataFrame, name: str) -> DataFrame:
        parts = some.withColumn("_wave", F.pmod(F.xxhash64(by), F.lit(waves)).cast("int"))
        store.append(parts.repartition(F.col("_wave")).sortWithinPartitions("_wave", by), f"{dealt}/{name}", "_wave")
        return store.spark.read.schema(parts.schema).parquet(store.path(f"{dealt}/{name}"))

    if waves > 1:  # each wave reads its own part; all prompts would be made and compared anew for each otherwise
        asked = deal(asked, "rows")
        reads = deal(reads, "reads") if make else None
    for i in range(waves):
        part = lambda t: t.filter(F.col("_wave") == i).drop("_wave") if waves > 1 else t  # noqa: B023, E731
        some = make(part(asked), part(reads)) if make else part(asked)
        got = ask(some).filter("raw IS NOT NULL").select(F.lit(model).alias("model"), "prompt_md5", "raw")
        store.append(got, table)
        if waves > 1:
            store.delete(f"{dealt}/rows", "_wave", str(i))
            store.delete(f"{dealt}/reads", "_wave", str(i))
    store.drop(dealt)
    held = store.read(table, RESPONSES).filter(F.col("model") == model).groupBy("prompt_md5").agg(F.min("raw").alias("raw"))
    found = keyed.join(held, "prompt_md5", "left")
    return found if make else found.drop("prompt_md5")


def embedded(store: Store, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], table: str = "embeddings") -> DataFrame:
    """rows (text) with vector, through the store's table of vectors by the text's hash."""
    keyed = rows.withColumn("key", F.md5("text"))
    held = store.read(table, EMBEDDINGS)
    asked = keyed.select("key", "text").filter("text IS NOT NULL").dropDuplicates(["key"]).join(held, "key", "left_anti")
    store.append(embed(asked).select("key", "vector"), table)
    held = store.read(table, EMBEDDINGS).groupBy("key").agg(F.min("vector").alias("vector"))
    return keyed.join(held, "key", "left").drop("key")


def save_results(metrics: DataFrame, per_row: DataFrame, path: str) -> None:
    """JSON lines of the metrics, and of all rows under per_row: as many files as there are tasks."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    per_row.write.mode("overwrite").json(f"{path}/per_row")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of results that were saved."""
    return spark.read.json(f"{path}/per_row")


def sample_ids(store: Store, size: int, pick: Callable[[], DataFrame], table: str = "sample_ids") -> DataFrame:
    """The ids (n, id) that were picked for this size before, or those that pick() gives (id), which are kept."""
    schema = "n int, id string"
    held = store.read(table, schema).filter(F.col("n") == size)
    if held.isEmpty():
        store.append(pick().select(F.lit(size).alias("n"), F.col("id").cast("string").alias("id")), table)
    return store.read(table, schema).filter(F.col("n") == size)


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation's rows from Parquet or JSON files: title, context, question, answer and whatever more there is."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def write_samples(examples: DataFrame, path: str, most: int = 30) -> DataFrame:
    """Write the context of the first titles (title, context, place of arrival) as a text file each; file, title of those
    written. Titles whose plain names are equal are one file, the first."""
    first = examples.groupBy("title").agg(F.min_by("context", "place").alias("context"), F.min("place").alias("place"))
    chosen = first.orderBy("place").limit(most).withColumn("file", file_name(F.col("title")))
    chosen = chosen.groupBy("file").agg(F.min_by(F.struct("title", "context"), "place").alias("r")).select("file", "r.*")
    chosen.select("file", F.col("context").alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    return chosen.select("file", "title")
