"""Scopes, deletion, export, retention and audits of stored rows."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PrivacyError
from ..functions.text import audit_blocking, audit_matches, redact, redact_json, short_hash
from ..functions.times import days_between
from ..schema import RETENTION_DAYS

SCOPES = ("sessions", "store", "chat", "all")

#: Who sees the data, by component.
PROVIDERS = (("sessions", "local", True), ("store", "local", True), ("chat", "chat service", False), ("embedder", "configured provider", False))


def bindings(checkpoints: DataFrame) -> DataFrame:
    """scope, file_path, session_id, processed_at of every checkpoint."""
    from .messages import chat_session_id, session_id

    path = F.col("file_path")
    name = F.element_at(F.split(path, "/"), -1)
    scope = F.when(path.startswith("store://"), "store").when(F.contains(path, F.lit("/chat/")), "chat").otherwise("sessions")
    sid = F.when(scope == "store", F.regexp_replace(path, "^store://", "")).when(scope == "chat", chat_session_id(F.regexp_replace(name, r"\.jsonl$", ""))).otherwise(session_id(name))
    return checkpoints.select(scope.alias("scope"), "file_path", sid.alias("session_id"), "processed_at")


def resolve(bound: DataFrame, scope: str, roots: tuple[str, ...] = ()) -> DataFrame:
    """Bindings of a scope. Paths outside the configured roots are refused."""
    if scope not in SCOPES:
        raise PrivacyError(f"scopes are {', '.join(SCOPES)}", code="unknown_scope")
    own = bound if scope == "all" else bound.where(F.col("scope") == scope)
    if roots:
        inside = F.col("file_path").startswith("store://")
        for r in roots:
            inside = inside | F.col("file_path").startswith(r.rstrip("/") + "/")
        own = own.where(inside & ~F.contains("file_path", F.lit("/../")))
    return own


def conflicts(bound: DataFrame) -> DataFrame:
    """Sessions claimed by several scopes and paths mapped to several sessions."""
    a = bound.groupBy(F.col("session_id").alias("key")).agg(F.count_distinct("scope").alias("n")).where("n > 1").withColumn("kind", F.lit("session"))
    b = bound.groupBy(F.col("file_path").alias("key")).agg(F.count_distinct("session_id").alias("n")).where("n > 1").withColumn("kind", F.lit("path"))
    return a.unionByName(b)


def require_unclaimed(bound: DataFrame, scope: str) -> None:
    """Refuse a scope whose sessions or paths another scope claims too."""
    own = bound if scope == "all" else bound.where(F.col("scope") == scope)
    keys = own.select(F.explode(F.array("session_id", "file_path")).alias("key")).distinct()
    if not conflicts(bound).join(keys, "key", "left_semi").isEmpty():
        raise PrivacyError("a session or path belongs to several scopes", code="scope_conflict")


def old_enough(bound: DataFrame, now: Column, days: int) -> DataFrame:
    """Sessions all of whose bindings are older than ``days``; an unknown time keeps a session."""
    if isinstance(days, bool) or not isinstance(days, int) or days < 0:
        raise PrivacyError("days must be a whole number", code="invalid_older_than")
    old = F.coalesce(days_between(now, "processed_at") > days, F.lit(False))
    return bound.groupBy("session_id").agg(F.bool_and(old).alias("old")).where("old").select("session_id")


def delete(tables: dict[str, DataFrame], sessions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of each table, and the counts of what goes (a dry run uses the counts alone)."""
    own = sessions.select("session_id").distinct()
    kept = {name: t.join(own, "session_id", "left_anti") for name, t in tables.items()}
    counts = None
    for name, t in tables.items():
        c = t.join(own, "session_id", "left_semi").agg(F.count("*").alias("would_delete")).select(F.lit(name).alias("table"), "would_delete")
        counts = c if counts is None else counts.unionByName(c)
    return kept, counts


#: What an exported row of each kind holds (fixed values).
EXPORTED = {
    "chunk": ("kind", "session", "source_type", "content", "timestamp_start", "timestamp_end", "metadata"),
    "fact": ("kind", "session", "category", "content", "timestamp", "task_summary", "metadata"),
}


def export_rows(chunks: DataFrame, sessions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Rows of a scope, redacted, the session hashed, in their export order: chunks
    by session, time, content and id, then facts by session, category, time, content and id.

    A column that a kind does not have is null.
    """
    ids = sessions.select("session_id").distinct()
    plain = ("source_type", "category", "task_summary")
    columns = tuple(dict.fromkeys(c for kind in EXPORTED.values() for c in kind if c not in ("kind", "session")))

    def part(rows: DataFrame, kind: str, at: str) -> DataFrame:
        given = [c for c in EXPORTED[kind] if c in rows.columns]
        own = rows.join(ids, "session_id", "left_semi")
        values = {c: redact(c) if c in (*plain, "content") else redact_json(c) if c == "metadata" else F.col(c) for c in given}
        types = {c: "timestamp" if c.startswith("timestamp") else "string" for c in columns}
        return own.select(
            F.lit(kind).alias("kind"), short_hash("session_id").alias("session"), *(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns),
            F.struct(F.col("session_id"), (F.col("category") if kind == "fact" else F.lit(None)).cast("string").alias("category"), F.col(at).cast("timestamp").alias("at"), F.col("content"), F.col("id")).alias("_order"),
        )

    rows = part(chunks, "chunk", "timestamp_start")
    if facts is not None:
        rows = rows.unionByName(part(facts, "fact", "timestamp"))
    order = [F.col(f"_order.{c}").asc_nulls_last() for c in ("session_id", "category", "at", "content", "id")]
    return rows.orderBy("kind", *order).drop("_order")


def write_export(rows: DataFrame, dest: str, *, confirm: bool = False) -> str:
    """Write rows as one JSON document: atomic, private, never over different content.
    A row holds what its kind has.

    The result is one file on the driver by contract; rows arrive partition by
    partition.
    """
    folder = os.path.dirname(os.path.abspath(dest))
    if not os.path.isdir(folder):
        raise PrivacyError("the folder does not exist", code="export_dest_missing_parent")
    if os.path.islink(dest):
        raise PrivacyError("the target is a link", code="export_dest_content_mismatch")
    if not confirm:
        return "dry_run"
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            out.write("[")
            for n, r in enumerate(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
                row = json.loads(r.j)
                own = {k: row[k] for k in EXPORTED.get(row.get("kind"), row)}
                out.write((",\n" if n else "\n") + json.dumps(own, ensure_ascii=False, sort_keys=True))
            out.write("\n]\n")
            out.flush()
            os.fsync(out.fileno())
        if os.path.exists(dest):
            with open(dest, "rb") as a, open(temp, "rb") as b:
                if a.read() == b.read():
                    return "already_exported"
            raise PrivacyError("the target holds other content", code="export_dest_content_mismatch")
        os.chmod(temp, 0o600)
        os.replace(temp, dest)
        return "exported"
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def retention_report(bound: DataFrame, now: Column, days: dict[str, int] | None = None) -> DataFrame:
    """Ages of each scope's bindings against its policy (``RETENTION_DAYS`` where ``days`` does not say)."""
    policy = F.create_map(*(F.lit(x) for pair in (RETENTION_DAYS | (days or {})).items() for x in pair))
    age = days_between(now, "processed_at")
    rows = bound.withColumn("age", age).withColumn("days", policy[F.col("scope")])
    return rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.count_if(F.col("age") > F.col("days")).alias("expired"), F.max("age").alias("oldest_days"), F.min("age").alias("newest_days"), F.first("days").cast("int").alias("retention_days")
    )


def audit(texts: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Findings of each text: category, whether it blocks."""
    flat = texts.select(*keys, F.explode(audit_matches(text_col)).alias("f"))
    return flat.select(*keys, F.col("f.category").alias("category"), F.col("f.match").alias("match"), audit_blocking(F.col("f.category"), F.col("f.match")).alias("blocking"))


ALLOWED = "category string, source string, path string, digest string, match string"


def allow(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that a rule allows no longer block.

    ``findings``: category, match, blocking, source, path, digest. A rule names
    its category and any of source, path, digest (compared exactly) and match (a
    pattern for the whole match); what is null is any. A rule with a path is met by a join on it, so
    there may be many; those without are few, by category.
    """
    own = rules.select("category", "path", F.struct("source", "digest", "match").alias("r"))
    exact = own.where("path is not null").groupBy("category", "path").agg(F.collect_list("r").alias("_exact"))
    other = own.where("path is null").groupBy("category").agg(F.collect_list("r").alias("_other"))
    joined = findings.join(exact, ["category", "path"], "left").join(other, "category", "left")

    def met(r):
        same = lambda name: r[name].isNull() | F.coalesce(r[name] == F.col(name), F.lit(False))
        return same("source") & same("digest") & (r["match"].isNull() | F.regexp_like(F.col("match"), F.concat(F.lit("^(?:"), r["match"], F.lit(r")\z"))))

    hit = F.coalesce(F.exists("_exact", met), F.lit(False)) | F.coalesce(F.exists("_other", met), F.lit(False))
    return joined.withColumn("blocking", F.col("blocking") & ~hit).select(*findings.columns)


def audit_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"), F.count_if("blocking").alias("n_blocking"))


def disclosures(spark) -> DataFrame:
    return spark.createDataFrame(list(PROVIDERS), "component string, provider string, local_only boolean")
