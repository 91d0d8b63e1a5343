"""Embedders as DataFrame operators: stored vectors, hashed vectors, replayed vectors."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import remote
from .config import Settings
from .errors import ConfigError, QueryError, ReplayError
from .functions import vector
from .schema import MAX_EMBED_CHARS

MANIFEST = {"schema_version": 1}


def embed(chunks: DataFrame, settings: Settings, stored: DataFrame | None = None, kind: str = "document") -> DataFrame:
    """Set ``embedding`` and ``embedding_model``; a text without a stored vector gets null."""
    text = F.substring("content", 1, MAX_EMBED_CHARS)
    rows = chunks.drop("embedding", "embedding_model")
    if settings.embedding_provider == "remote" and stored is None:
        stored = remote.known(chunks.sparkSession, settings)
    if settings.embedding_provider == "hashed":
        return rows.withColumn("embedding", vector.hashed(text, settings.embedding_dim).cast("array<float>")).withColumn("embedding_model", F.lit(settings.embedding_model))
    key = vector.replay_key(F.lit(settings.embedding_model), F.lit(settings.embedding_revision), F.lit(kind), text)
    keyed = rows.withColumn("_key", key)
    found = keyed.join(stored.select(F.col("key").alias("_key"), F.col("embedding").cast("array<float>").alias("embedding")), "_key", "left").drop("_key")
    return found.withColumn("embedding", F.when(vector.valid("embedding", settings.embedding_dim), F.col("embedding"))).withColumn("embedding_model", F.lit(settings.embedding_model))


def check_replay(manifest: dict, vectors: DataFrame, settings: Settings, digest: str | None = None) -> DataFrame:
    """Validate a replay set against its manifest; returns its vectors."""
    if not isinstance(manifest, dict) or not {"schema_version", "model", "revision", "dim"} <= set(manifest):
        raise ReplayError("a field is missing", code="replay_manifest_invalid")
    if manifest["schema_version"] != MANIFEST["schema_version"]:
        raise ReplayError("another version", code="replay_manifest_schema_mismatch")
    if (manifest["model"], manifest["revision"]) != (settings.embedding_model, settings.embedding_revision):
        raise ReplayError("another model", code="replay_model_identity_mismatch")
    if manifest["dim"] != settings.embedding_dim:
        raise ReplayError("another dimension", code="replay_dimension_mismatch")
    if digest is not None and manifest.get("vectors_sha256") not in (None, digest):
        raise ReplayError("other vectors", code="replay_manifest_hash_mismatch")
    bad = vectors.agg(F.count_if(~vector.valid("embedding", settings.embedding_dim)).alias("bad"), F.count("*").alias("n"), F.count_distinct("key").alias("d")).first()
    if bad.n != bad.d:
        raise ReplayError("a key occurs twice", code="replay_vectors_duplicate_key")
    if bad.bad:
        raise ReplayError("a vector is invalid", code="replay_vectors_invalid")
    return vectors


def read_replay(spark, manifest_path: str, vectors_path: str, settings: Settings) -> DataFrame:
    """A replay set from a manifest and a JSON-lines file of (key, embedding)."""
    try:
        manifest = json.loads("\n".join(r.value for r in spark.read.text(manifest_path).collect()))
    except ValueError as e:
        raise ReplayError("no JSON", code="replay_manifest_invalid") from e
    digest = spark.read.format("binaryFile").load(vectors_path).select(F.sha2("content", 256).alias("d")).orderBy("path").collect()
    joined = digest[0].d if len(digest) == 1 else sha256("".join(r.d for r in digest).encode()).hexdigest()
    return check_replay(manifest, spark.read.schema("key string, embedding array<float>").json(vectors_path), settings, joined)


def stored_vectors(spark, settings: Settings) -> DataFrame | None:
    """The (key, embedding) rows of the configured provider; none where vectors are computed."""
    if settings.embedding_provider == "replay":
        if not settings.replay_manifest or not settings.replay_vectors:
            raise ReplayError("no replay set is configured", code="replay_manifest_invalid")
        return read_replay(spark, settings.replay_manifest, settings.replay_vectors, settings)
    if settings.embedding_provider == "table":
        if not settings.embedding_table:
            raise ConfigError("embedding_table is not set", code="invalid_config_value")
        return spark.read.parquet(settings.embedding_table)
    return None


def query_embedder(spark, settings: Settings) -> Callable[[str], list[float]]:
    """From a query's text to its vector, by the configured provider; a text without one is an error."""

    def run(text: str) -> list[float]:
        if settings.embedding_provider == "remote":
            return remote.one(spark, settings, text)
        rows = embed(spark.createDataFrame([(text,)], "content string"), settings, stored_vectors(spark, settings), "query")
        vector = rows.select("embedding").first().embedding
        if vector is None:
            raise QueryError("no vector is stored for this text", code="embedding_unavailable")
        return [float(x) for x in vector]

    return run


def require_vectors(rows: DataFrame) -> DataFrame:
    """Fail the query at the first row without a vector."""
    return rows.where(F.when(F.col("embedding").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("replay_vector_missing")).cast("boolean")))


def call_batches(
    texts: DataFrame, call: Callable[[list[str]], list], *, batch: int = 128, retries: int = 3, per_second: float = 8.0, pause: float = 2.0, tasks: int | None = None, dim: int | None = None
) -> DataFrame:
    """id, embedding, error: vectors from a remote function, in batches, retried with growing pauses.

    ``texts``: id, content. ``call`` maps texts to vectors and may raise an error
    with ``retry_after`` seconds. The texts of a batch that keeps failing have no vector but an ``error``;
    so has a vector that is not of ``dim`` finite numbers. With ``tasks`` the
    texts are spread over so many tasks, and each starts its calls ``tasks / per_second`` seconds
    apart, so all together keep the rate (a task that Spark runs twice at once,
    by speculation, is on top). Without, the rate holds for each task.
    """
    gap = (tasks or 1) / per_second if per_second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        due = 0.0
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                own = [(t or "")[:MAX_EMBED_CHARS] for t in part.column(1).to_pylist()]
                found, error = [None] * len(own), None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + gap
                    try:
                        got = list(call(own))
                        if len(got) != len(own):
                            raise ValueError("another number of vectors")
                        found, error = got, None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        if attempt < retries:
                            wait = getattr(e, "retry_after", None)
                            time.sleep(pause * 2**attempt if wait is None else wait)
                whole = [v is not None and (dim is None or (len(v) == dim and all(math.isfinite(x) for x in v))) for v in found]
                errors = [None if ok else error or "no vector of this dimension" for ok in whole]
                vectors = pa.array([v if ok else None for v, ok in zip(found, whole, strict=True)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, pa.array(errors, pa.string())], names=["id", "embedding", "error"])

    rows = texts.select("id", "content")
    return (rows.repartition(tasks) if tasks else rows).mapInArrow(run, "id string, embedding array<float>, error string")
