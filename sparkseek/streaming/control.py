"""Pausing, stopping and following what runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkseek.operators.shared import SharedFolder


class Pause:
    """A flag in a shared folder that holds indexing: set by one process, seen by all. Setting it twice, or lifting it where it is not set, does nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = SharedFolder(spark, folder)

    def hold(self) -> None:
        self.files.create("paused", {"at": time.time()})

    def resume(self) -> None:
        self.files.delete("paused")

    @property
    def held(self) -> bool:
        return self.files.exists("paused")

    def wait(self, poll: float = 0.5) -> None:
        """Return once the flag is not set."""
        while self.held:
            time.sleep(poll)


class Cancel:
    """A token for work that may be given up: what runs within it is cancelled, on the cluster as well, by cancel() from any thread."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"work-{uuid.uuid4().hex}", False

    @contextmanager
    def __call__(self) -> Iterator[None]:
        sc = self.spark.sparkContext
        if self.cancelled:
            raise InterruptedError(self.tag)
        sc.addJobTag(self.tag)
        try:
            yield
        finally:
            sc.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def follow(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float, every: str = "0 seconds") -> StreamingQuery:
    """Follow a stream for so many seconds, giving each micro-batch to sink, and stop; what comes later is taken up from the checkpoint."""
    query = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    if not query.awaitTermination(seconds):
        query.stop()
    return query
