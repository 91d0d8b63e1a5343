"""Vectors from an embedding service, kept in a table, fetched at one rate for all tasks.

``fill`` adds what the table lacks: each distinct text once, in slices of about
``SLICE_SECONDS`` at the configured rate. A slice that is done is in the table, so
a run that ends early goes on from there, and a lost executor costs one slice at most.
Texts that keep failing have no row; ``fill`` returns them with their errors.
What a run asked for and got stays in ``<table>.due`` until it is cleared by hand.
The texts are computed once for the list of what is due and once more for the rows that take the vectors.
"""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .errors import ConfigError, QueryError
from .functions import vector
from .schema import MAX_EMBED_CHARS

SLICE_SECONDS = 600.0
VECTORS = "key string, embedding array<float>"


def caller(settings: Settings, kind: str = "document") -> Callable[[list[str]], list]:
    """A function from texts to vectors: one POST with the texts, ``data[i].embedding`` back."""
    key = ""
    if settings.embedding_key_file:
        try:
            with open(settings.embedding_key_file) as f:
                key = f.read().strip()
        except OSError as e:
            raise ConfigError("the key file can't be read", code="invalid_config_value") from e
    url, model, timeout = settings.embedding_url, settings.embedding_model, settings.timeout_seconds

    def call(texts: list[str]) -> list:
        body = json.dumps({"model": model, "input": texts, "input_type": kind}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
                return [row["embedding"] for row in json.load(answer)["data"]]
        except urllib.error.HTTPError as e:
            if e.code == 429:
                e.retry_after = float(e.headers.get("Retry-After") or 5)
            raise

    return call


def known(spark: SparkSession, settings: Settings) -> DataFrame:
    """The table of vectors; empty before the first slice."""
    place = spark._jvm.org.apache.hadoop.fs.Path(settings.embedding_table)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(VECTORS).parquet(settings.embedding_table) if there else spark.createDataFrame([], VECTORS)


def fill(rows: DataFrame, settings: Settings, kind: str = "document", call: Callable | None = None) -> DataFrame:
    """Fetch the vectors of ``rows.content`` that the table lacks; returns key, content, error of those that failed.

    Null texts count as empty; equal texts are sent once.
    """
    from .embedding import call_batches

    spark = rows.sparkSession
    text = F.substring(F.coalesce("content", F.lit("")), 1, MAX_EMBED_CHARS)
    key = vector.replay_key(F.lit(settings.embedding_model), F.lit(settings.embedding_revision), F.lit(kind), text)
    wanted = rows.select(key.alias("key"), text.alias("content")).dropDuplicates(["key"])
    due = wanted.join(known(spark, settings), "key", "left_anti")
    place = f"{settings.embedding_table.rstrip('/')}.due/{uuid.uuid4().hex}"
    due.write.parquet(f"{place}/texts")
    due = spark.read.parquet(f"{place}/texts")
    slices = max(1, math.ceil(due.count() / (settings.batch_size * settings.requests_per_second * SLICE_SECONDS)))
    send = call or caller(settings, kind)
    for k in range(slices):
        own = due.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k).select(F.col("key").alias("id"), "content")
        got = call_batches(own, send, batch=settings.batch_size, retries=settings.max_retries - 1, per_second=settings.requests_per_second, tasks=settings.fetch_tasks, dim=settings.embedding_dim)
        got.select(F.col("id").alias("key"), "embedding", "error").write.parquet(f"{place}/got-{k}")
        kept = spark.read.parquet(f"{place}/got-{k}").where("error is null")
        kept.select("key", "embedding").coalesce(settings.fetch_tasks).write.mode("append").parquet(settings.embedding_table)
    failed = spark.read.parquet(*(f"{place}/got-{k}" for k in range(slices))).where("error is not null")
    return due.join(failed.select("key", "error"), "key")


def one(spark: SparkSession, settings: Settings, text: str) -> list[float]:
    """The vector of a query's text, by a call of its own."""
    from .embedding import call_batches

    row = call_batches(spark.createDataFrame([("q", text)], "id string, content string"), caller(settings, "query"), retries=settings.max_retries - 1, per_second=settings.requests_per_second, dim=settings.embedding_dim).first()
    if row.embedding is None:
        raise QueryError("the service gives no vector for this text", code="embedding_unavailable")
    return [float(x) for x in row.embedding]
