"""Evaluation sets: corpora, judgments, ledgers, external collections."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvaluationError

CORPUS = "id string, lang string, content string, session string, timestamp timestamp, source_kind string, tags array<string>"
JUDGMENTS = "query_id string, class string, lang string, direction string, query_text string, canonical_query string, relevance map<string, int>, expected_no_evidence boolean, conversation_context array<string>, source_filter string"
LEDGER = "query_splits array<struct<query_id: string, split: string, bucket: string, tags: array<string>, evidence: map<string, string>>>"
HAYSTACK = "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGMENTS).json(path)


def grades(rows: DataFrame) -> DataFrame:
    """query_id, id, grade."""
    return rows.select("query_id", F.explode("relevance").alias("id", "grade"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.schema(LEDGER).option("multiLine", True).json(path)
    return whole.select(F.inline("query_splits"))


def check_pin(spark: SparkSession, path: str, size: int, sha256: str) -> None:
    """Refuse a file of another size or digest; the bytes stay on the executors."""
    r = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("d")).first()
    if r is None or (r.length, r.d) != (size, sha256):
        raise EvaluationError("another file", code="dataset_pin_mismatch")


def haystack(spark: SparkSession, path: str, *, size: int | None = None, sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A JSON array of long-memory questions: (questions, turns of their sessions)."""
    if size is not None:
        check_pin(spark, path, size, sha256)
    rows = spark.read.schema(HAYSTACK).option("multiLine", True).json(path)
    flat = rows.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_no", "s"))
    turns = flat.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "m")).select("question_id", "session_id", "date", "turn", "m.*")
    return rows.drop("haystack_sessions", "haystack_dates"), turns


def zipped_collection(spark: SparkSession, path: str, md5: str, members: dict[str, str]) -> dict[str, DataFrame]:
    """A pinned zip with corpus and queries (JSON lines) and relevance rows of three fields."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    if hashlib.md5(raw).hexdigest() != md5:
        raise EvaluationError("another archive", code="dataset_pin_mismatch")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if not set(members.values()) <= set(z.namelist()):
            raise EvaluationError("a member is missing", code="dataset_member_missing")
        text = {k: z.read(m).decode().splitlines() for k, m in members.items()}
    lines = {k: spark.createDataFrame([(x,) for x in v if x.strip()], "value string") for k, v in text.items()}
    fields = F.split(F.trim("value"), r"\s+")
    rel = lines["qrels"].where(F.size(fields) == 3).select(fields[0].alias("query_id"), fields[1].alias("corpus_id"), fields[2].try_cast("int").alias("score")).where("score is not null")
    if rel.count() < len([x for x in text["qrels"] if x.strip()]) - 1:  # all but a header
        raise EvaluationError("a relevance row has other fields", code="dataset_rows_invalid")
    docs = lines["corpus"].select(F.from_json("value", "_id string, title string, text string").alias("d")).select("d.*")
    asked = lines["queries"].select(F.from_json("value", "_id string, text string").alias("d")).select("d.*")
    return {"corpus": docs, "queries": asked, "qrels": rel}


def contract(settings: dict, required: tuple[str, ...] = ("language", "split", "revision")) -> dict:
    """A collection that is only described: its description must be complete."""
    missing = [k for k in required if not settings.get(k)]
    if missing:
        raise EvaluationError(f"missing: {', '.join(missing)}", code="dataset_contract_invalid")
    return {k: settings[k] for k in required}
