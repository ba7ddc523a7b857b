"""Review jobs that are submitted, watched, asked and deleted."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions import fixed, prompts
from briefmill.functions.text import cut
from briefmill.operators import nearest, retrieval
from briefmill.plans import pipeline, stages
from briefmill.plans.models import NOTHING, Models
from briefmill.sources.files import load_pages
from briefmill.sources.stores import Store

JOBS = "job_id string, at double, state string, message string, documents int"
BRIEFS = "job_id string, brief string"
PAGES = "doc_id string, file_path string, page_number int, text string, total_pages int, error string"
FINAL = ("complete", "failed", "deleted")


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    """The job isn't in a state for this."""


class Jobs:
    """Jobs whose states, pages and briefs are tables of a store. A state is appended, never changed: the latest counts."""

    def __init__(self, spark: SparkSession, store: Store, models: Models | None = None):
        self.spark, self.store, self.models = spark, store, models or Models()

    def _note(self, job_id: str, state: str, message: str = "", documents: int = 0) -> None:
        # a folder for each job: a status opens no other's notes
        self.store.put(self.store.under("jobs", job_id), {"job_id": job_id, "at": time.time(), "state": state, "message": message, "documents": documents})

    def _notes(self, job_id: str) -> list[dict]:
        return self.store.records(self.store.under("jobs", job_id))

    def submit(self, path: str, job_id: str | None = None) -> str:
        """A new job over the files of a path (a pattern); run() works on it."""
        job_id = job_id or uuid.uuid4().hex
        if not path.strip():
            raise ValueError("no files were given")
        self._note(job_id, "pending", path)
        return job_id

    def status(self, job_id: str) -> dict:
        """job_id, state, message, documents, at of the latest note."""
        notes = self._notes(job_id)
        if not notes:
            raise NotFound(job_id)
        return notes[-1]

    def history(self, job_id: str) -> DataFrame:
        """The job's states in order, with the seconds that each lasted."""
        names = ("job_id", "at", "state", "message", "documents")
        rows = self.spark.createDataFrame([tuple(n[c] for c in names) for n in self._notes(job_id)], JOBS)
        return rows.withColumn("seconds", F.expr("lead(at) OVER (PARTITION BY job_id ORDER BY at) - at")).orderBy("at")

    def jobs(self) -> DataFrame:
        """The latest note of every job that isn't deleted."""
        names = ("job_id", "at", "state", "message", "documents")
        last = [self.status(j) for j in self.store.keys("jobs")]
        return self.spark.createDataFrame([tuple(n[c] for c in names) for n in last if n["state"] != "deleted"], JOBS)

    def end_hanging(self, seconds: float) -> list[str]:
        """Jobs that run but have given no sign (a note, or a stage's row) for so long are marked as failed, and can be resumed."""
        ended = []
        for job_id in self.store.keys("jobs"):
            now = self.status(job_id)
            signs = [now["at"], *(r["at"] for r in self.store.records(self.store.under("progress", job_id)))]
            if now["state"] == "running" and time.time() - max(signs) > seconds:
                self._note(job_id, "failed", f"no sign of life for {int(time.time() - max(signs))} s", now["documents"])
                ended.append(job_id)
        return ended

    def wait(self, job_id: str, every: float = 5.0, most: float = 3600.0, look: Callable[[dict], None] | None = None) -> dict:
        """Ask for the status until the job has ended; TimeoutError after `most` seconds."""
        end = time.time() + most
        while True:
            now = self.status(job_id)
            if look:
                look(now)
            if now["state"] in FINAL:
                return now
            if time.time() + every > end:
                raise TimeoutError(f"job {job_id} is still {now['state']}")
            time.sleep(every)

    def progress(self, job_id: str) -> DataFrame:
        """A row for each stage of the job's runs: stage, state (made, kept, partial, failed, skipped), rows, seconds, message."""
        return stages.progress(self.store, job_id)

    def stage_counts(self, job_id: str) -> DataFrame:
        """stage, state, rows, runs: how far the job has come."""
        return stages.stage_counts(self.store, job_id)

    def resume(self, job_id: str) -> dict:
        """Go on with a job that was killed, failed, or ended with faults: files are read again only if no pages were kept, and
        stages and replies that the store has are not made again."""
        return self._work(job_id, ("running", "failed", "complete"))

    def run(self, job_id: str) -> dict:
        """Work on a pending job. If no file can be read it fails; files that can't are noted in the brief otherwise."""
        return self._work(job_id, ("pending",))

    def _work(self, job_id: str, states: tuple[str, ...]) -> dict:
        now = self.status(job_id)
        if now["state"] not in states:
            raise Conflict(f"job {job_id} is {now['state']}")
        first = self._notes(job_id)[0]
        self._note(job_id, "running", "reading")
        try:
            pages = self.pages(job_id)
            if now["state"] == "pending" or pages.isEmpty():
                found = load_pages(self.spark, first["message"]).select("doc_id", "file_path", "page_number", "text", "total_pages", "error")
                self.store.replace(found.withColumn("job_id", F.lit(job_id)), "pages", "job_id")
                pages = self.pages(job_id)
            good = pages.filter("error IS NULL").select("doc_id").distinct().count()
            if not good:
                self._note(job_id, "failed", "no file could be read")
                return self.status(job_id)
            self._note(job_id, "running", "reviewing", good)
            submitted = time.strftime("%Y-%m-%d %H:%M UTC", time.gmtime(first["at"]))
            job = pipeline.run(self.spark, job_id, pages, generated=submitted, store=self.store, models=self.models)
            self.store.replace(job.brief.select(F.lit(job_id).alias("job_id"), "brief"), "briefs", "job_id")
        except Exception as e:
            self._note(job_id, "failed", f"{type(e).__name__}: {e}"[:500])
            raise
        self._note(job_id, "complete", "; ".join(job.errors)[:500], good)
        return self.status(job_id)

    def _complete(self, job_id: str) -> None:
        state = self.status(job_id)["state"]
        if state != "complete":
            raise Conflict(f"job {job_id} is {state}")

    def pages(self, job_id: str) -> DataFrame:
        return self.store.read("pages", PAGES + ", job_id string").filter(F.col("job_id") == job_id).drop("job_id")

    def brief(self, job_id: str) -> str:
        self._complete(job_id)
        return self.store.read("briefs", "brief string, job_id string").filter(F.col("job_id") == job_id).first()["brief"]

    def ask(self, job_id: str, question: str, document: str | None = None) -> dict:
        """answer, and sources (document, page, excerpt) of a question to all of the job's documents or to one."""
        if not question.strip():
            raise ValueError("the question is blank")
        self._complete(job_id)
        found = [r.asDict() for r in self.sources(job_id, question, document).collect()]  # QA_TOTAL rows
        if not found:
            return {"answer": NOTHING, "sources": []}
        rows = self.spark.createDataFrame([(question, [f["text"] for f in found])], "question string, excerpts array<string>")
        rows = rows.withColumn("prompt", prompts.question(F.col("question"), F.col("excerpts")))
        answer = self.models.answer(rows).first()["raw"]
        return {"answer": answer or NOTHING, "sources": [{k: f[k] for k in ("document_id", "page_number", "excerpt")} for f in found]}

    def delete(self, job_id: str) -> dict:
        """Remove a job's pages and brief; the note that it was deleted stays. A running job isn't deleted."""
        if (state := self.status(job_id)["state"]) in ("running", "deleted"):
            raise Conflict(f"job {job_id} is {state}")
        gone = {name: self.store.delete(name, "job_id", job_id) for name in ("pages", "briefs")}
        self.store.drop(self.store.under("progress", job_id))
        self._note(job_id, "deleted")
        return gone

    def sources(self, job_id: str, question: str, document: str | None = None) -> DataFrame:
        """document_id, page_number, text, excerpt, place of the best chunks for a question: the best few of each document, then
        the best of those. Windows, vectors and weights are the ones that the job's run has kept."""
        pages = self.pages(job_id).filter("error IS NULL").select("doc_id", "page_number", "text")
        kept = stages.Stages(self.store, job_id, pipeline.index_stages(self.models, self.store), ("pages",), notes=False)
        t = kept.run({"pages": pages})
        if kept.faults:
            raise RuntimeError("; ".join(f"{name}: {message}" for name, message in kept.faults))
        window, child, dense, sparse = t["windows"], t["children"].drop("tokens"), t["dense_index"], t["sparse_index"]
        if document is not None:
            child, dense, sparse = child.filter(F.col("scope") == document), nearest.of_scope(dense, F.lit(document)), nearest.of_scope(sparse, F.lit(document))
        asked = self.spark.createDataFrame([("q", question)], "query_id string, text string")
        fused = pipeline.ranked(asked, dense, sparse, self.models, self.store)
        best = retrieval.across_documents(retrieval.best_parents(fused, child, fixed.QA_PER_DOCUMENT))
        texts = window.select(F.col("parent_id").alias("parent"), F.col("text").alias("parent_text"))
        text = retrieval.context_text(F.col("parent_text"), F.col("text"))
        rows = best.join(texts, "parent", "left").select(F.col("scope").alias("document_id"), "page_number", text.alias("text"), cut(F.trim("text"), 200).alias("excerpt"), "place")
        return rows.orderBy("place")
