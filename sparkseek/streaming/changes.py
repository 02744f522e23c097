"""Change feeds as streams: adds and deletes applied to a store in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkseek.model import CHANGE
from sparkseek.operators.store import RecordStore
from sparkseek.streaming.control import Pause

LIGHT, NAMES_ONLY, FULL = 1, 2, 3  # stages of a change


def read_changes(spark: SparkSession, folder: str, schema: StructType = CHANGE, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    """A change log folder as a stream. Files already read are known from the checkpoint; rate limits stand in for back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(folder)


def enriched(changes: DataFrame) -> DataFrame:
    """Changes of all stages of one path as one row: of each column the value of the last change that has one; a delete wipes what was before it.

    For use within a batch: the light stage brings size and times, the full stage the content, in either order.
    """
    last_delete = F.max(F.when(F.col("op") == 1, F.struct("event_time", "seq")))
    values = [c for c in changes.columns if c not in ("parent", "name", "op", "event_time", "seq")]
    events = changes.groupBy("parent", "name").agg(last_delete.alias("__cut"), F.max(F.struct("event_time", "seq", "op")).alias("__last"))
    alive = changes.join(events, ["parent", "name"]).where(F.col("__cut").isNull() | (F.struct("event_time", "seq") > F.col("__cut")) | (F.col("__last.op") == 1))
    at = F.struct("event_time", "seq")
    merged = alive.groupBy("parent", "name").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in values], F.max(F.struct("event_time", "seq", "op")).alias("__l")
    )
    return merged.select("parent", "name", *values, "__l.op", "__l.event_time", "__l.seq")


def apply_stream(changes: DataFrame, folder: str, checkpoint: str, once: bool = True, seconds: int = 10, keys: tuple[str, ...] = ("parent", "name"), query_name: str | None = None, enrich: bool = False, pause: Pause | None = None) -> StreamingQuery:
    """Apply a stream of changes to the RecordStore in folder.

    Each micro-batch is one commit under its own id, so a batch replayed after a failure is not applied twice. Changes are ordered by
    (event_time, seq) per path, within a batch and over all of them, so late batches change nothing newer. enrich joins the stages
    of a path that meet in one batch into one row. While pause is held no further batch is begun. once stops when all that is there has been read.
    """

    def apply(batch: DataFrame, n: int) -> None:
        if pause is not None:
            pause.wait()
        RecordStore(batch.sparkSession, folder, keys).apply(enriched(batch) if enrich else batch, f"stream-{n}")

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def live_feed(changes: DataFrame) -> DataFrame:
    """What a viewer is told of each change: path, what happened, when."""
    return changes.select(F.concat_ws("\\", "parent", "name").alias("path"), F.when(F.col("op") == 1, "removed").otherwise("changed").alias("what"), "event_time")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window; as a stream, what is later than `late` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key: runs of events with no pause of `gap`."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
