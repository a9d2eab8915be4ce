"""Runs registered job classes."""

from __future__ import annotations

import asyncio
import sys
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import DuplicateKey, JobStopped, PairflowError
from .compiler import Compiler, in_pool
from .config import get_config
from .nodes import SINKS
from .resolver import resolve_jobs


class Runner:
    """``Runner(cls, spark).run(*args)`` builds the class's jobs and runs them in order; ``run`` of the class may be asynchronous.

    Steps that jobs share run once. Sinks run where they stand, so that a later
    load finds what a dump wrote. A job that ends without a sink is evaluated too.
    """

    def __init__(self, job_class: type, spark: SparkSession):
        self.job_class, self.spark = job_class, spark
        self.name = get_config().name_of(job_class)
        self.stopped = False
        self.group = f"pairflow-{uuid.uuid4().hex}"

    def stop(self) -> None:
        """From any thread: cancels what runs and ends the run with ``JobStopped``."""
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def _check(self) -> None:
        if self.stopped:
            raise JobStopped(self.name)

    def run(self, *args: Any) -> list[DataFrame]:
        """The frames of the jobs, in resolved order. They are lazy: what was kept during the run is let go."""
        context = self.spark.sparkContext
        self._check()
        made = self.job_class(*args).run()
        nodes = resolve_jobs(asyncio.run(_awaited(made)) if hasattr(made, "__await__") else made)
        compiler = Compiler(self.spark, nodes)
        context.setJobGroup(self.group, self.name, interruptOnCancel=True)
        try:
            out = []
            with in_pool(self.spark, get_config().enqueuer), self._progress(nodes):
                for node in nodes:
                    self._check()
                    out.append(compiler.frame(node))
                    if node.action not in SINKS:
                        compiler.evaluate(node)
                    self._check()
            return out
        except Exception as error:
            if self.stopped:
                raise JobStopped(self.name) from error
            if "duplicate key" in str(error) and not isinstance(error, PairflowError):
                # Found by a task, which can only raise Spark's own errors.
                raise DuplicateKey(self.name) from error
            raise
        finally:
            compiler.release()
            context.setLocalProperty("spark.jobGroup.id", None)

    @contextmanager
    def _progress(self, nodes: list) -> Iterator[None]:
        """With ``show_progress``, a line a second on a terminal: Spark's tasks of this run, done and all."""
        if not (get_config().show_progress and sys.stderr.isatty()):
            yield
            return
        over = threading.Event()

        def report() -> None:
            tracker = self.spark.sparkContext.statusTracker()
            while not over.wait(1):
                stages = [s for j in tracker.getJobIdsForGroup(self.group) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))]
                print(f"\r{self.name}: {len(nodes)} jobs, {sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks", end="", file=sys.stderr, flush=True)

        watcher = threading.Thread(target=report, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
            print(file=sys.stderr)


async def _awaited(jobs: Any) -> Any:
    return await jobs
