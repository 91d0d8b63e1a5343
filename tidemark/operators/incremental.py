"""What changed since the last run, and the checkpoints that remember it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_files(found: DataFrame, checkpoints: DataFrame, force: bool = False) -> DataFrame:
    """Files whose path, time and size are not all as remembered (found: file_path, file_mtime, file_size)."""
    if force:
        return found
    return found.join(checkpoints.select("file_path", "file_mtime", "file_size"), ["file_path", "file_mtime", "file_size"], "left_anti")


def session_status(sessions: DataFrame, checkpoints: DataFrame, force: bool = False) -> DataFrame:
    """Store sessions with a ``status``: skip, replace (forced, new or rewound) or append.

    ``sessions``: session_id, started_at, last_activity_at, message_count,
    rewind_count. A checkpoint holds the activity time as mtime, the message
    count as size and the rewind count as offset.
    """
    active = F.coalesce("last_activity_at", "started_at")
    known = checkpoints.select(F.regexp_replace("file_path", "^store://", "").alias("session_id"), F.col("file_mtime").alias("m"), F.col("file_size").alias("n"), F.col("processed_offset").alias("r"))
    met = sessions.withColumn("active_at", active).join(known, "session_id", "left")
    same = (F.col("m") == F.col("active_at")) & (F.col("n") == F.col("message_count")) & (F.col("r") == F.col("rewind_count"))
    status = (
        F.when(F.col("active_at").isNull(), "skip")
        .when(F.lit(force), "replace")
        .when(F.coalesce(same, F.lit(False)), "skip")
        .when(F.col("m").isNull() | (F.coalesce("r", F.lit(-1)) != F.col("rewind_count")), "replace")
        .otherwise("append")
    )
    return met.withColumn("status", status).drop("m", "n", "r")


def unreadable(lines: DataFrame) -> DataFrame:
    """Files with text but without a single line of valid JSON (lines: path, value)."""
    fine = F.try_parse_json("value").isNotNull()
    return lines.where("value <> ''").groupBy("path").agg(F.count_if(fine).alias("fine"), F.count("*").alias("n")).where("fine = 0").select("path", "n")


def last_turns(chunks: DataFrame) -> DataFrame:
    """The last stored turn of each session."""
    return chunks.groupBy("session_id").agg(F.coalesce(F.max("turn_index_end"), F.lit(0)).alias("last_turn"))


def new_turns(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items after the last stored turn of their session."""
    return items.join(last_turns(chunks), "session_id", "left").where(F.col("turn_index") > F.coalesce("last_turn", F.lit(0))).drop("last_turn")


def upsert_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each path, the new one if there is one; an old row's source type stays.

    A partial row (``partial`` true) is stored with size 0, so the next run
    takes the file again.
    """
    size = F.when(F.coalesce("partial", F.lit(False)), F.lit(0)).otherwise(F.col("file_size")).cast("long")
    fresh = new.withColumn("processed_offset", F.coalesce("processed_offset", F.col("file_size"))).withColumn("file_size", size).drop("partial")
    both = old.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    w = Window.partitionBy("file_path").orderBy("_age", F.col("processed_at").desc_nulls_last())
    first = F.first(F.when(F.col("_age") == 1, F.col("source_type")), ignorenulls=True).over(Window.partitionBy("file_path"))
    return both.withColumn("source_type", F.coalesce(first, "source_type")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_age")


def replace_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """All-or-nothing replacement: a session in ``new`` loses all its old rows.

    If any new row lacks its vector, nothing of the batch is written: the gate is
    a one-row aggregate, so the plan stays lazy.
    """
    gate = new.agg(F.coalesce(F.bool_and(F.col("embedding").isNotNull()), F.lit(False)).alias("complete"))
    ready = new.join(gate, F.col("complete")).drop("complete")
    gone = ready.select("session_id").distinct()
    return old.join(gone, "session_id", "left_anti").select(old.columns).unionByName(ready.select(old.columns))


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append without deleting, under the same gate."""
    gate = new.agg(F.coalesce(F.bool_and(F.col("embedding").isNotNull()), F.lit(False)).alias("complete"))
    return old.unionByName(new.join(gate, F.col("complete")).select(old.columns))


def purge(chunks: DataFrame, empty_sessions: DataFrame) -> DataFrame:
    """Drop sessions that have no messages left."""
    return chunks.join(empty_sessions.select("session_id").distinct(), "session_id", "left_anti")


def run_counters(files: DataFrame) -> DataFrame:
    """Totals of an ingest run (files: status, chunks)."""
    states = ("found", "unchanged", "empty", "cron", "done", "partial", "error")
    counts: list[Column] = [F.count_if(F.col("status") == s).alias(s) for s in states[1:]]
    return files.agg(F.count("*").alias("found"), *counts, F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
