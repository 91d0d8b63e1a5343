"""Fusion, decay, ranking, deduplication and paging of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.times import decay
from ..functions.vector import cosine, norm
from ..schema import RRF_K, SAME_CONTENT_COSINE


def fuse(channels: dict[str, DataFrame]) -> DataFrame:
    """Reciprocal-rank fusion: query_id, id, score and each channel's rank.

    An exact hit counts as rank 1 wherever it stands in its pool; the rank kept
    for explanation is the true one.
    """
    parts = []
    for name, rows in channels.items():
        worth = F.lit(1.0 / (RRF_K + 1)) if name == "exact" else F.lit(1.0) / (RRF_K + F.col("rank"))
        parts.append(rows.select("query_id", "id", F.lit(name).alias("channel"), "rank", worth.alias("worth")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ranks = [F.max(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in ("dense", "lexical", "exact")]
    return both.groupBy("query_id", "id").agg(F.sum("worth").alias("score"), *ranks)


def apply_decay(rows: DataFrame, now: Column, when: Column) -> DataFrame:
    """Multiply scores by the age factor where ``when`` holds."""
    factor = F.when(when, decay(now, "timestamp_start", "created_at")).otherwise(F.lit(1.0))
    return rows.withColumn("score", F.col("score") * factor).withColumn("decayed", when)


def rank(rows: DataFrame, name: str = "rank") -> DataFrame:
    """Position by score, ties by id, inside each query (its pools only)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))).cast("long"))


def dedup(rows: DataFrame, threshold: float = SAME_CONTENT_COSINE) -> DataFrame:
    """Add ``kept``: false where an earlier kept row has equal content, session and
    source and a cosine over the threshold.

    A row can only be dropped by one of its own group, so the walk in rank order
    is a fold over each group's rows (a pool's worth at most). Of equal vectors
    the first alone takes part: it is kept or dropped, and the others are dropped
    in either case. Rows without a vector, or with one of no length, are kept and
    drop nothing. ``threshold`` is at least 0 and under 1.
    """
    if not 0 <= threshold < 1 - 1e-9:
        raise QueryError("the threshold is from 0 to under 1", code="invalid_threshold")
    group = ["query_id", "content", "session_id", "source_type"]
    rows = rows.withColumn("_free", F.coalesce(norm("embedding") == 0, F.lit(True)))
    vectors = F.col("embedding").cast("array<double>")
    firsts = rows.where(~F.col("_free")).groupBy(*group, vectors.alias("e")).agg(F.min(F.struct("rank", "id")).alias("at"))
    listed = firsts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at.rank", "at.id", "e"))).alias("own"))
    empty = F.expr("cast(array() as array<struct<rank: bigint, id: string, e: array<double>>>)")

    def step(kept: Column, x: Column) -> Column:
        twin = F.exists(kept, lambda y: F.coalesce(cosine(x["e"], y["e"]) > threshold, F.lit(False)))
        return F.when(twin, kept).otherwise(F.concat(kept, F.array(x)))

    keep = listed.withColumn("kept_ids", F.transform(F.aggregate("own", empty, step), lambda x: x["id"]))
    flat = keep.select("query_id", F.explode("kept_ids").alias("id"), F.lit(True).alias("_kept"))
    return rows.join(flat, ["query_id", "id"], "left").withColumn("kept", F.col("_free") | F.coalesce("_kept", F.lit(False))).drop("_free", "_kept")


def cut(rows: DataFrame, window: Column | int) -> DataFrame:
    """Renumber the kept rows and keep the result window."""
    own = rows.where("kept").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return own.where(F.col("place") <= window)


def page(rows: DataFrame, limit: Column | int, offset: Column | int) -> DataFrame:
    limit, offset = (F.lit(x) if isinstance(x, int) else x for x in (limit, offset))
    return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def explain(rows: DataFrame) -> DataFrame:
    """Add the ``explain`` struct of each row."""
    def channel(name: str) -> Column:
        r = F.col(f"{name}_rank")
        return F.struct(r.isNotNull().alias("matched"), r.alias("candidate_rank")).alias(name)

    n = sum((F.col(f"{c}_rank").isNotNull().cast("int") for c in ("dense", "lexical", "exact")), F.lit(0))
    steps = F.when(F.col("decayed"), F.array(F.lit("temporal_decay"))).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.withColumn(
        "explain",
        F.struct(
            F.when(F.col("decayed"), F.lit("rrf_decayed")).otherwise(F.lit("rrf")).alias("score_kind"),
            steps.alias("adjustments"),
            F.struct(channel("dense"), channel("lexical"), channel("exact")).alias("channels"),
            n.alias("matched_channel_count"),
            (n > 1).alias("multi_channel"),
        ),
    )
