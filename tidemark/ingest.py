"""Ingest runs: sources to items to chunks to stored rows, with checkpoints."""

from __future__ import annotations

import contextlib
import functools
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import indexing, remote
from .config import Settings
from .embedding import embed
from .errors import IngestError
from .functions.times import fill_span
from .operators import bytepair, chunking, incremental, messages
from .sources import archive, sessions, store
from .store import Store


def to_rows(cut: DataFrame, mtimes: DataFrame, kind, channel=None) -> DataFrame:
    """Chunks as rows of the managed table (session_id, source_type and times filled)."""
    met = cut.join(mtimes, "session_id", "left")
    start, end = fill_span("timestamp_start", "timestamp_end", "mtime")
    key = F.sha2(F.concat_ws(":", "session_id", F.col("turn_index_start").cast("string"), F.col("chunk_no").cast("string"), F.sha2("content", 256)), 256)
    return met.select(
        F.substring(key, 1, 32).alias("id"), "session_id", kind.alias("source_type"), "content", start.alias("timestamp_start"), end.alias("timestamp_end"), "turn_index_start", "turn_index_end",
        (channel if channel is not None else F.lit(None).cast("string")).alias("channel"), F.lit(None).cast("string").alias("metadata"), F.current_timestamp().alias("created_at"),
    )


def _alone(method):
    """A run holds the writer's lock of its store; a dry run writes nothing and needs none."""

    @functools.wraps(method)
    def run(self, **options):
        with contextlib.nullcontext() if options.get("dry_run") else self.target.writing():
            return method(self, **options)

    return run


class Run:
    """One source into one store. Counters come back; nothing is written in a dry run."""

    def __init__(self, spark: SparkSession, target: Store, settings: Settings, stored: DataFrame | None = None, now: datetime | None = None):
        self.spark, self.target, self.settings, self.stored = spark, target, settings, stored
        self.now = now or datetime.now(UTC)
        own = settings.chunk_vocabulary
        self.cut = functools.partial(
            chunking.chunk, size=settings.chunk_tokens, overlap=settings.chunk_overlap, tokenizer=bytepair.BytePairs(own, settings.chunk_pattern) if own else chunking.tokens
        )

    def _files(self, root: str, found: DataFrame, force: bool) -> DataFrame:
        files = found.select(F.col("path").alias("file_path"), "name", F.col("mtime").alias("file_mtime"), F.col("size").cast("long").alias("file_size"))
        return incremental.changed_files(files, self.target.table("ingestion_state"), force)

    def _budget(self, lines: DataFrame) -> None:
        """Stop before anything is written when too many files hold no record."""
        most = self.settings.max_failed_files
        bad = incremental.unreadable(lines).select("path").limit(most + 1).collect()
        if len(bad) > most:
            raise IngestError(f"more than {most} files can't be read", code="ingest_too_many_errors")

    def _finish(self, rows: DataFrame, done: DataFrame, dry_run: bool, replace: bool = True, unchanged: int = 0) -> dict:
        """Store rows, then checkpoints. Sessions with a missing vector are not written and stay due.

        Rows are embedded and written once; counters, completeness, checkpoints and
        indexes read what was written. Only if a session is not complete are the
        others written again without it.
        """
        if self.settings.embedding_provider == "remote" and not dry_run:
            remote.fill(rows, self.settings)
        rows = embed(rows, self.settings, self.stored)
        if not dry_run:
            staged = self.target.write("session_chunks", rows)
            rows = self.target.read("session_chunks", [staged])
        whole = rows.groupBy("session_id").agg(F.bool_and(F.col("embedding").isNotNull()).alias("complete"), F.count("*").alias("chunks"))
        status = done.join(whole, "session_id", "left").withColumn("partial", ~F.coalesce("complete", F.lit(True)))
        status = status.withColumn("status", F.when(F.col("source_type") == "cron", "cron").when(F.coalesce("chunks", F.lit(0)) == 0, "empty").when(F.col("partial"), "partial").otherwise("done"))
        counters = incremental.run_counters(status.withColumn("chunks", F.when(F.col("status") == "done", F.col("chunks")).otherwise(0))).first().asDict() | {"unchanged": unchanged}
        if dry_run:
            return counters
        if counters["partial"]:
            staged = self.target.write("session_chunks", rows.join(whole.where("complete").select("session_id"), "session_id", "left_semi"))
            rows = self.target.read("session_chunks", [staged])
        marks = status.select(
            "file_path", "file_mtime", "file_size", F.col("offset").alias("processed_offset"), F.lit(self.now).alias("processed_at"),
            F.when(F.col("status").isin("cron", "empty"), F.col("status")).otherwise(F.col("source_type")).alias("source_type"),
            F.coalesce("chunks", F.lit(0)).cast("int").alias("chunks_created"), F.lit(0).alias("facts_created"), "partial",
        )
        keys = rows.select("session_id") if replace else None
        folders = indexing.changed(self.target, rows, keys) | {"session_chunks": self.target.placed("session_chunks", staged, keys, "session_id")}
        state = self.target.write("ingestion_state", incremental.upsert_checkpoints(self.target.table("ingestion_state"), marks))
        self.target.publish(folders | {"ingestion_state": [state]})  # rows, indexes and checkpoints at once
        return counters

    @_alone
    def sessions(self, *, force: bool = False, dry_run: bool = False) -> dict:
        root = self.settings.source("sessions")
        found = sessions.discover(self.spark, root)
        files = self._files(root, found, force)
        paths = [r.file_path for r in files.select("file_path").collect()]
        if not paths:
            return {"found": 0}
        lines = sessions.lines(self.spark, paths)
        self._budget(lines)
        kinds = messages.classify(lines)
        name = F.element_at(F.split("path", "/"), -1)
        items = messages.session_items(sessions.messages(lines).join(kinds, "path").where("source_type <> 'cron'").withColumn("session_id", messages.session_id(name)), keep=("session_id",))
        cut = self.cut(items, ["session_id"])
        done = files.join(kinds.withColumnRenamed("path", "file_path"), "file_path", "left").withColumn("session_id", messages.session_id("name")).withColumn("offset", F.col("file_size"))
        kind = done.select("session_id", "source_type", F.col("file_mtime").alias("mtime")).dropDuplicates(["session_id"])
        return self._finish(to_rows(cut, kind, F.coalesce("source_type", F.lit("main_user"))), done, dry_run, unchanged=found.count() - len(paths))

    @_alone
    def chat(self, *, force: bool = False, dry_run: bool = False, file: str | None = None) -> dict:
        """All chat files, or the one that ``file`` names."""
        root = self.settings.source("chat")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(root)
        found = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        if file is not None:
            found = found.where(F.col("name") == os.path.basename(file))
            if found.isEmpty():
                raise IngestError("no such chat file", code="chat_file_missing")
        files = self._files(root, found, force)
        paths = [r.file_path for r in files.select("file_path").collect()]
        if not paths:
            return {"found": 0}
        self._budget(sessions.lines(self.spark, paths))
        items = messages.chat_items(archive.messages(self.spark, paths))
        cut = self.cut(items.withColumn("session_id", messages.chat_session_id("channel")), ["session_id", "channel"], order=[F.col("turn_index")])
        channel = F.regexp_replace("name", r"\.jsonl$", "")
        done = files.withColumn("session_id", messages.chat_session_id(channel)).withColumn("source_type", F.lit("chat")).withColumn("offset", F.col("file_size"))
        return self._finish(to_rows(cut, done.select("session_id", F.col("file_mtime").alias("mtime")), F.lit("chat"), F.col("channel")), done, dry_run, unchanged=found.count() - len(paths))

    @_alone
    def store(self, *, force: bool = False, dry_run: bool = False) -> dict:
        path = self.settings.source("store")
        all_messages = store.read_table(self.spark, path, "messages")
        rows = store.sessions(store.read_table(self.spark, path, "sessions"), store.read_table(self.spark, path, "messages", columns=("session_id", "active", "compacted")))
        as_time = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
        rows = rows.withColumn("last_activity_at", as_time("last_activity_at")).withColumn("started_at", as_time("started_at")).withColumn("rewind_count", F.coalesce("rewind_count", F.lit(0)).cast("long"))
        state = self.target.table("ingestion_state").where(F.col("file_path").startswith("store://"))
        due = incremental.session_status(rows, state, force).where("status <> 'skip'").cache()
        visible = store.visible_messages(all_messages).join(due.select("session_id", "status"), "session_id")
        turns = visible.select("session_id", "status", "role", F.col("content").alias("text"), F.col("timestamp").cast("string").alias("timestamp"), F.col("id").alias("turn_index"))
        totals: dict = {}
        for status, replace in (("replace", True), ("append", False)):
            own = turns.where(F.col("status") == status)
            own = own if replace else incremental.new_turns(own, self.target.table("session_chunks"))
            cut = self.cut(messages.session_items(own), ["session_id"])
            done = due.where(F.col("status") == status).select("session_id", "source_type", F.concat(F.lit("store://"), "session_id").alias("file_path"), F.col("active_at").alias("file_mtime"), F.col("message_count").cast("long").alias("file_size"), F.col("rewind_count").alias("offset"))
            if done.isEmpty():
                continue
            rows_ = to_rows(cut, done.select("session_id", "source_type", F.col("file_mtime").alias("mtime")), F.col("source_type"))
            for k, v in self._finish(rows_, done, dry_run, replace).items():
                totals[k] = totals.get(k, 0) + v
        if not dry_run:
            left = store.visible_messages(all_messages).select("session_id").distinct()
            empty = store.read_table(self.spark, path, "sessions", columns=("id",)).select(F.col("id").alias("session_id")).join(left, "session_id", "left_anti")
            if not empty.isEmpty():
                self.target.publish(indexing.without(self.target, empty) | {"session_chunks": self.target.removed("session_chunks", empty, "session_id")})
        return totals or {"found": 0}
