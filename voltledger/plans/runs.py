"""Runs over many folders that can be watched and cancelled: the jobs of one run carry a tag in Spark.

Folders are processed one after the other and each is added to a ledger, as one version, so that a run that is cancelled or fails keeps what it has
finished, and its counters tell how far it came. A later run over the same folders adds nothing twice.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from voltledger.plans import flows
from voltledger.sources import documents
from voltledger.sources.documents import Job
from voltledger.sources.ledger import Ledger


@dataclass
class Outcome:
    """Of the folders that are finished: texts, invoices and errors; the error rows (path, id_fatura, error), and why the run ended early."""

    total: int = 0
    processed: int = 0
    errors: int = 0
    cancelled: bool = False
    failure: str | None = None
    finished: list[Job] = field(default_factory=list)
    error_rows: list[DataFrame] = field(default_factory=list)


class Run:
    """Starts at once; ``progress`` and ``cancel`` can be called from any thread, ``result`` waits."""

    def __init__(self, spark: SparkSession, jobs: list[Job], ledger: Ledger, **options):
        self.spark, self.jobs, self.ledger, self.options = spark, list(jobs), ledger, options
        self.tag = f"run-{uuid.uuid4().hex}"
        self.outcome = Outcome()
        self._stop = threading.Event()
        self._thread = InheritableThread(target=self._work, daemon=True)
        self._thread.start()

    def _work(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setJobGroup(self.tag, "folders to a ledger")
        try:
            for job in self.jobs:
                if self._stop.is_set():
                    break
                self._one(job)
        except Exception as e:  # noqa: BLE001  a failing folder ends the run; what is finished stays
            self.outcome.failure = None if self._stop.is_set() else f"{type(e).__name__}: {e}"
        finally:
            self.outcome.cancelled = self._stop.is_set() and len(self.outcome.finished) < len(self.jobs)
            context.removeJobTag(self.tag)

    def _one(self, job: Job) -> None:
        held: list[DataFrame] = []
        texts, failed = documents.texts(self.spark, [job], **self.options)
        try:
            extracted, errors = flows.extract(texts, [job.fornecedor], held)
            parsed = flows.Parsed(held[0], failed)
            counts = {r.counter: r.n for r in parsed.counters().collect()}
            if self._stop.is_set():
                return
            self.ledger.append(flows.base_sheets(extracted))
        finally:
            for frame in held:
                frame.unpersist()
        done = self.outcome
        done.total, done.processed, done.errors = done.total + counts["total"], done.processed + counts["processed"], done.errors + counts["errors"]
        done.error_rows.append(errors.unionByName(failed))
        done.finished.append(job)

    def progress(self) -> dict[str, int]:
        """Folders in all and finished, and the tasks of the stages that are running now, in all and finished."""
        tracker, tasks, over = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info and info.status == "RUNNING" else ():
                if found := tracker.getStageInfo(stage):
                    tasks, over = tasks + found.numTasks, over + found.numCompletedTasks
        return {"folders": len(self.jobs), "folders_finished": len(self.outcome.finished), "tasks": tasks, "tasks_finished": over}

    def cancel(self) -> None:
        """Stops the running jobs of this run, and no others; no further folder begins."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def result(self, timeout: float | None = None) -> Outcome:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the run has not ended")
        return self.outcome
