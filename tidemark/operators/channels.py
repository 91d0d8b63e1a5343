"""Candidate channels over a batch of queries.

Every channel takes the filtered chunks and a queries DataFrame (``query_id,
text, embedding, pool``) and returns ``query_id, id, rank, score``, at most
``pool`` rows for each query. The queries are a batch that a client sent: a
stated, small set (``MAX_QUERIES``); the chunks are never collected, and each
channel shuffles only rows that match or survive a task's own top-k.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.text import contains_fold, query_terms, trigrams, words
from ..schema import MAX_BATCH, MAX_EXACT_CHARS, TRIGRAM_THRESHOLD

MAX_QUERIES = MAX_BATCH
#: Columns that filters by query look at.
META = ("source_type", "session_id", "timestamp_start")
#: Texts that a task turns into trigrams at a time, and words whose trigrams it keeps.
SLICE, KNOWN = 256, 20_000


def top(rows: DataFrame, *order: Column) -> DataFrame:
    """Rank inside each query and keep its pool (a window group limit)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= F.col("pool")).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "score")


def collected(queries: DataFrame, *columns: str) -> list:
    rows = queries.select(*columns).limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise QueryError(f"at most {MAX_QUERIES} queries a batch", code="query_count_exceeded")
    return rows


def nearest(cos: np.ndarray, pool: int, mask: np.ndarray | None = None) -> np.ndarray:
    """The places of the ``pool`` best (ties of the last place stay) among those of the mask."""
    own = np.arange(len(cos)) if mask is None else np.flatnonzero(mask)
    if len(own) <= pool:
        return own
    return own[cos[own] >= np.partition(cos[own], len(own) - pool)[len(own) - pool]]


def _best(ids: list, matrix: np.ndarray, pools: np.ndarray, types: list[pa.DataType], masks=None):
    """Each batch's nearest rows for every query: a task's part of the top-k.

    ``masks`` (ids and ``META`` columns to masks by a query's place) tells which rows a query may meet.
    """
    size = np.sqrt((matrix * matrix).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                n = np.sqrt((x * x).sum(axis=1))[:, None] * size
                with np.errstate(invalid="ignore", divide="ignore"):
                    cos = np.where(n > 0, (x @ matrix.T) / n, 0.0)
                keys = np.array(b.column(0).to_pylist(), object)
                out: tuple[list, list, list] = [], [], []
                seen = masks(ids, *(b.column(k) for k in (2, 3, 4))) if masks else {}
                for q, pool in enumerate(pools):
                    own = nearest(cos[:, q], pool, seen.get(q))
                    out[0].extend([ids[q]] * len(own))
                    out[1].extend(keys[own])
                    out[2].extend(cos[own, q])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["query_id", "id", "score"])

    return run


def dense(chunks: DataFrame, queries: DataFrame, masks=None) -> DataFrame:
    """Cosine similarity, best first, ties by id. Exact, not approximate.

    A task multiplies blocks of chunk vectors with all query vectors and keeps
    each query's best rows, so the shuffle carries pools, not products.
    """
    rows = [r for r in collected(queries, "query_id", "embedding", "pool") if r.embedding is not None]
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, id string, score double"
    if not rows:
        return top(chunks.sparkSession.createDataFrame([], f"{schema}, pool int"), F.col("id"))
    types = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.string(), pa.float64()]
    best = _best([r.query_id for r in rows], np.array([r.embedding for r in rows], np.float64), np.array([r.pool for r in rows]), types, masks)
    found = chunks.select("id", "embedding", *(META if masks else ())).mapInArrow(best, schema)
    return top(found.join(queries.select("query_id", "pool"), "query_id"), F.col("score").desc(), F.col("id"))


def dense_native(chunks: DataFrame, vector: list[float], pool: int, query_id=0) -> DataFrame:
    """The same for one query, as column expressions only."""
    from ..functions.vector import cosine

    scored = chunks.select("id", cosine("embedding", F.array(*map(F.lit, vector))).alias("score"))
    best = scored.orderBy(F.col("score").desc(), F.col("id")).limit(pool)
    return top(best.withColumn("query_id", F.lit(query_id)).withColumn("pool", F.lit(pool)), F.col("score").desc(), F.col("id"))


def cover_density(positions: list[list[int]]) -> float:
    """Sum over minimal spans that hold every term: 0.1 / (1 + words between).

    (Clarke, Cormack and Tudhope's cover ranking with equal weights.)
    """
    if len(positions) == 1:
        return 0.1 * len(positions[0])
    marks = sorted((p, t) for t, own in enumerate(positions) for p in own)
    last: dict[int, int] = {}
    total, before = 0.0, -1
    for p, t in marks:
        last[t] = p
        if len(last) == len(positions):
            start = min(last.values())
            if start > before:  # else the span holds one that ended earlier
                total += 0.1 / (1 + (p - start + 1) - len(positions))
                before = start
    return total


def cover_scores(positions: Column, gaps: bool = False) -> Column:
    """Cover density of the terms' positions, which may be given as gaps."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        read = itertools.accumulate if gaps else iter
        return column.map(lambda terms: cover_density([list(read(p)) for p in terms]))

    return run(positions)


def lexical(chunks: DataFrame, queries: DataFrame, keep=None) -> DataFrame:
    """Rows that hold every query term, by cover density; ties by id.

    ``keep``, here and below, takes hits (query_id, id, ...) before the pool is cut to those that may be found.

    Words are joined to the batch's terms before anything is shuffled.
    """
    asked = queries.select("query_id", "pool", query_terms("text").alias("terms")).where(F.size("terms") > 0)
    wanted = asked.select("query_id", "pool", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    flat = chunks.select("id", F.posexplode(words("content")).alias("at", "term"))
    hits = flat.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    met = hits.join(wanted, "term").groupBy("query_id", "id").agg(F.first("pool").alias("pool"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("term", "positions"))).alias("found"))
    full = met.where(F.size("found") == F.col("n"))
    full = keep(full) if keep else full
    one = full.where("n = 1").withColumn("score", F.lit(0.1) * F.size(F.col("found")[0]["positions"]))
    many = full.where("n > 1").withColumn("score", cover_scores(F.col("found")["positions"]))
    scored = one.unionByName(many).select("query_id", "id", "pool", "score")
    return top(scored, F.col("score").desc(), F.col("id"))


WORD = re.compile(r"[^\W_]+")


def local_trigrams(word: str) -> set[str]:
    padded = f"  {word} "
    return {padded[k : k + 3] for k in range(len(padded) - 2)}


def _shared_trigrams(wanted: frozenset[str], limit: float):
    """The query trigrams that each text holds; texts with more than ``limit`` trigrams hold too few.

    Higher-order functions would build every text's whole set; this stops at the
    limit and keeps the trigrams of words it has seen. Texts are read in slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        shared: dict[str, str] = {}  # one object for each trigram
        for b in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            out: tuple[list, list, list] = [], [], []
            for key, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own: set[str] = set()
                for m in WORD.finditer((content.as_py() or "").lower()):
                    w = m[0]
                    if w not in known:
                        if len(known) > KNOWN:
                            known, shared = {}, {}
                        known[w] = tuple(shared.setdefault(g, g) for g in local_trigrams(w))
                    own.update(known[w])
                    if len(own) > limit:
                        break
                else:
                    for g in own & wanted:
                        out[0].append(key)
                        out[1].append(len(own))
                        out[2].append(g)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["id", "m", "gram"])

    return run


def trigram(chunks: DataFrame, queries: DataFrame, threshold: float = TRIGRAM_THRESHOLD, keep=None) -> DataFrame:
    """Rows whose trigram sets are similar enough; ties by id.

    A text similar to a query of n trigrams by t has n / t trigrams at most, so
    longer ones are given up early, and only shared trigrams are shuffled.
    """
    asked = queries.select("query_id", "pool", trigrams("text").alias("own")).where(F.size("own") > 0)
    sets = [set(r.own) for r in collected(asked, "own")]
    limit = max(map(len, sets), default=0) / threshold if threshold > 0 else float("inf")
    wanted = asked.select("query_id", "pool", F.size("own").alias("n"), F.explode("own").alias("gram"))
    flat = chunks.select("id", "content").mapInArrow(_shared_trigrams(frozenset().union(*sets), limit), "id string, m int, gram string")
    met = flat.join(wanted, "gram").groupBy("query_id", "id").agg(F.first("pool").alias("pool"), F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("c"))
    scored = met.select("query_id", "id", "pool", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score")).where(F.col("score") >= threshold)
    return top(keep(scored) if keep else scored, F.col("score").desc(), F.col("id"))


def exact(chunks: DataFrame, queries: DataFrame, keep=None) -> DataFrame:
    """Case-insensitive substring of a short query, newest first (no time last), ties by id.

    Every text meets every needle, so the needles are a bounded batch and broadcast.
    """
    collected(queries, "query_id")
    short = queries.where(F.length(F.trim("text")) <= MAX_EXACT_CHARS).select("query_id", "pool", F.trim("text").alias("needle"))
    met = chunks.select("id", "content", "timestamp_start").join(F.broadcast(short), contains_fold("content", "needle"))
    scored = met.select("query_id", "id", "pool", "timestamp_start", F.lit(1.0).alias("score"))
    return top(keep(scored) if keep else scored, F.col("timestamp_start").desc_nulls_last(), F.col("id"))
