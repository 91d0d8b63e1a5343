"""Session files as a stream: each trigger takes the files that are new, or new and changed.

Spark's file source (``read``) remembers paths only and serves append-only
folders; with a state folder ``changes`` takes its place, which sends a file
again when its time or size changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import messages
from ..sources import sessions
from . import changes

LINE = "value string"


def read(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """path, value (a whole file) of new files."""
    found = spark.readStream.schema(LINE).format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    named = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), "value")
    return named.where(sessions.is_session(F.element_at(F.split("path", "/"), -1)))


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("value", "\n", -1)).alias("n", "value")).select("path", (F.col("n") + 1).alias("line_no"), F.trim("value").alias("value"))


def items(files: DataFrame) -> DataFrame:
    """Redacted items of the files' messages: a stateless stream."""
    name = F.element_at(F.split("path", "/"), -1)
    return messages.session_items(sessions.messages(lines(files)).withColumn("session_id", messages.session_id(name)))


def changed(spark: SparkSession, root: str, state: str, per_trigger: int = 0) -> DataFrame:
    """path, mtime, size, value of new and changed session files."""
    return changes.read(spark, root, state, per_trigger).where(sessions.is_session(F.element_at(F.split("path", "/"), -1)))


def run(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None], *, per_trigger: int = 1000, state: str | None = None, every: str | None = None) -> StreamingQuery:
    """Everything that is there now, batch by batch, or for good ``every`` interval; ``sink`` gets (files, batch id).

    A batch may be repeated after a failure, so the sink must replace sessions
    (as the managed store does) rather than append. With ``state``, a folder that
    is kept with the checkpoint, changed files come again; what is there now is then one batch.
    """
    files = read(spark, root, per_trigger) if state is None else changed(spark, root, state, per_trigger if every else 0)
    writer = files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
