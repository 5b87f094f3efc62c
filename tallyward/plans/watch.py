"""Watching the Spark jobs of a run: stopping them, and telling how far they are."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_LOG = logging.getLogger(__name__)
EVERY = 0.2


class Watch:
    """Within it, jobs that the thread starts carry a tag of their own.

    Once `cancel` is set, jobs with that tag are cancelled, also those that a run begins before it looks at `cancel`
    itself; other jobs of the session go on. `on_tasks` is called with (tasks done, tasks in all) of the running
    stages of these jobs, from a thread of the watch. Without both there is nothing to watch, and no thread.
    """

    def __init__(self, spark: SparkSession, cancel: threading.Event | None = None, on_tasks: Callable[[int, int], None] | None = None):
        self.context, self.cancel, self.on_tasks = spark.sparkContext, cancel, on_tasks
        self.tag = f"tallyward-{uuid.uuid4().hex}"
        self.over = threading.Event()
        self.thread: threading.Thread | None = None

    def __enter__(self) -> Watch:
        if self.cancel is not None or self.on_tasks is not None:
            self.context.addJobTag(self.tag)
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        if self.thread is not None:
            self.thread.join()
            self.context.removeJobTag(self.tag)

    def _watch(self) -> None:
        while not self.over.wait(EVERY):
            if self.cancel is not None and self.cancel.is_set():
                self.context.cancelJobsWithTag(self.tag)
            elif self.on_tasks is not None:
                try:
                    self._tell()
                except Exception as e:  # a listener's fault is not the run's
                    _LOG.warning("progress is no longer told: %s", e)
                    self.on_tasks = None

    def _tell(self) -> None:
        tracker = self.context.statusTracker()
        own = self.context._jsc.sc().statusTracker().getJobIdsForTag(self.tag)
        stages: set[int] = set()
        for job in own:
            info = tracker.getJobInfo(job)
            if info is not None and info.status == "RUNNING":
                stages.update(info.stageIds)
        found = [s for s in map(tracker.getStageInfo, stages) if s is not None]
        if found:
            self.on_tasks(sum(s.numCompletedTasks for s in found), sum(s.numTasks for s in found))
