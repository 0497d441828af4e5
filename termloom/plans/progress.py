"""Progress told by the running work: tasks of the jobs that run, rows that a job has seen, rows of a stream's batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@contextmanager
def watching(spark: SparkSession, progress: Callable[[int, int], None], every: float = 0.1) -> Iterator[None]:
    """While the block runs, ``progress`` gets (tasks done, tasks known) of this thread's jobs whenever it changes, and at the end.

    The numbers are those of Spark's own status tracker; no job is run for them.
    """
    context, group, stop, seen = spark.sparkContext, f"watched-{uuid.uuid4().hex[:12]}", threading.Event(), {}
    told: list[tuple[int, int]] = []

    def look() -> None:
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    seen[stage] = (s.numCompletedTasks, s.numTasks)
        now = (sum(a for a, _ in seen.values()), sum(b for _, b in seen.values()))
        if seen and (not told or now != told[-1]):
            told.append(now)
            progress(*now)

    def poll() -> None:
        while not stop.wait(every):
            look()

    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "watched")
    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", before)
        look()


def counting(df: DataFrame, progress: Callable[[int], None]) -> DataFrame:
    """``df``; when its first job that reads it whole has ended, ``progress`` gets its number of rows, counted by that job."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    threading.Thread(target=lambda: progress(seen.get["rows"]), daemon=True).start()
    return out


class Rows(StreamingQueryListener):
    """Rows that a stream has read so far, told after each batch as the stream reports it."""

    def __init__(self, progress: Callable[[int], None]):
        self.progress, self.rows, self.run, self.over = progress, 0, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.run in (None, str(event.progress.runId)) and event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.progress(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run in (None, str(event.runId)):
            self.over.set()


@contextmanager
def streaming(spark: SparkSession, progress: Callable[[int], None] | None) -> Iterator[Callable[[StreamingQuery], None]]:
    """Tells a stream's rows to ``progress``; the block calls what it is given with the query that it starts, and all
    that the stream reports has been told when the block ends."""
    if progress is None:
        yield lambda query: None
        return
    rows = Rows(progress)
    spark.streams.addListener(rows)
    try:
        yield lambda query: setattr(rows, "run", str(query.runId))
        rows.over.wait(30)
    finally:
        spark.streams.removeListener(rows)
