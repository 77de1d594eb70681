"""An engine object over the plans: documents in, decisions out; a registry of background ingestion jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index as index_ops
from .plans import decision
from .sources.store import staged

DOCUMENT = "doc_id string, title string, text string, metadata map<string,string>"


class Engine:
    """Documents are a DataFrame; every change makes a new one, so a running query sees one state."""

    def __init__(self, spark: SparkSession, config: decision.Config | None = None):
        self.spark, self.config = spark, config or decision.Config()
        self.documents = spark.createDataFrame([], DOCUMENT)
        self._index: index_ops.Index | None = None
        self._lock = threading.Lock()
        self.jobs: dict[str, dict] = {}

    def add_documents(self, new: DataFrame) -> None:
        with self._lock:
            self.documents = staged(index_ops.added(self.documents, new))  # the plan doesn't grow with each call
            if self._index is not None:
                index_ops.release(self._index)
            self._index = None

    def add_document(self, doc_id: str, title: str, text: str, metadata: dict | None = None) -> int:
        """How many chunks the document gave."""
        new = self.spark.createDataFrame([(doc_id, title, text, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (metadata or {}).items()})], DOCUMENT)
        self.add_documents(new)
        return self.index.chunks.where(F.col("doc_id") == doc_id).count()

    @property
    def index(self) -> index_ops.Index:
        with self._lock:
            if self._index is None:
                self._index = decision.corpus(self.documents, self.config)
            return self._index

    def query_batch(self, questions: DataFrame) -> DataFrame:
        return decision.decide(questions, self.index, self.config)

    def query(self, question: str, max_evidence: int | None = None) -> dict:
        """One question's decision with the milliseconds it took; a blank question is an error."""
        if not question or not question.strip():
            raise ValueError("the question is blank")
        began = time.time()
        row = self.query_batch(self.spark.createDataFrame([("q", question.strip())], "query_id string, text string")).first().asDict(recursive=True)
        row["evidence"] = row["evidence"][:max_evidence]
        return row | {"latency_ms": round(1000 * (time.time() - began), 1)}

    def corpus(self) -> dict:
        """Totals, and the list of all documents: what the caller asks for, however many they are."""
        chunks = self.index.chunks
        listed = index_ops.corpus_documents(self.documents, chunks).orderBy("doc_id").toLocalIterator()
        return index_ops.corpus_stats(self.documents, chunks).first().asDict() | {"documents": [r.asDict() for r in listed]}

    def stats(self) -> dict:
        return index_ops.index_stats(self.index).first().asDict()

    def health(self) -> dict:
        return {"status": "ok", **self.stats()}

    def ingest(self, query: str, fetch: Callable[[str, int], tuple[DataFrame, DataFrame]], max_results: int = 10) -> str:
        """Start a background job that adds what fetch(query, max_results) gives; its id."""
        job = uuid.uuid4().hex
        self.jobs[job] = {"status": "running", "query": query, "max_results": max_results, "indexed": 0, "errors": [], "error": None, "started_at": time.time(), "finished_at": None}

        def run() -> None:
            state = self.jobs[job]
            try:
                self.spark.sparkContext.setJobGroup(job, f"ingest {query}")
                papers, errors = fetch(query, max_results)
                before = self.documents.count()
                self.add_documents(papers)
                state |= {"indexed": self.documents.count() - before, "errors": [r.asDict() for r in errors.collect()], "status": "done"}
            except Exception as e:  # the job's state is where a background failure shows
                state |= {"status": "failed", "error": str(e)[:500]}
            state["finished_at"] = time.time()

        threading.Thread(target=run, daemon=True).start()
        return job

    def ingest_status(self, job: str) -> dict:
        if job not in self.jobs:
            raise KeyError(f"no job {job}")
        state = self.jobs[job]
        return state | {"elapsed": (state["finished_at"] or time.time()) - state["started_at"]}
