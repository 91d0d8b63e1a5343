"""Retrieval quality and latency, as aggregates over many queries and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvaluationError

FINAL_TOP_K, CANDIDATE_TOP_K = 10, 20
TRACE_STAGES = ("dense", "lexical", "exact", "fused", "temporal", "dedup", "final")


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def metrics(ranked: DataFrame, judged: DataFrame, *, keys: tuple[str, ...] = ("query_id",), recall_k: int = 5, k: int = 10) -> DataFrame:
    """Recall, reciprocal rank and nDCG of each query.

    ``ranked``: keys, id, rank; ``judged``: query_id, id, grade (> 0 is relevant).
    The ideal ranking takes all relevant rows, not only the first ``k``.
    """
    good = judged.where("grade > 0").select("query_id", "id", "grade")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id"))
    ideal = good.withColumn("p", place).groupBy("query_id").agg(F.sum(gain(F.col("grade")) / discount(F.col("p"))).alias("ideal"), F.count("*").alias("n_relevant"))
    hits = ranked.join(good, ["query_id", "id"])
    own = hits.groupBy(*keys).agg(
        F.count_if(F.col("rank") <= recall_k).alias("hits"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade")) / discount(F.col("rank")))).alias("dcg"),
    )
    asked = ranked.select(*keys).distinct().join(ideal, "query_id")
    return asked.join(own, list(keys), "left").select(
        *keys,
        "n_relevant",
        (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def grouped(rows: DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Means over each of several groupings at once (grouping sets), nulls left out."""
    name = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in by))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in by))
    return rows.groupingSets([[c] for c in by], *by).agg(name.alias("grouping"), value.alias("value"), F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values)).drop(*by)


def by_bucket(rows: DataFrame, ledger: DataFrame, values: tuple[str, ...], by: tuple[str, ...] = ("config", "bucket")) -> DataFrame:
    """Means of each configuration over the buckets that the ledger (query_id, bucket) gives the queries."""
    return rows.join(ledger.select("query_id", "bucket"), "query_id").groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, nearest-rank median and 95th percentile, mean."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.avg(value).alias("mean"),
    )


def cold_and_warm(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """The first measurement of each series is cold, the rest are warm."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return rows.withColumn("phase", F.when(first, "cold").otherwise("warm"))


def duplicate_groups(chunks: DataFrame) -> DataFrame:
    """``g, id, n, first``: the rows of contents stored more than once, the digest of
    the content, the number of its rows and the first of them.

    A group is as many rows, so none is gathered in one; contents themselves are not shuffled.
    """
    rows = chunks.select(F.coalesce(F.sha2("content", 256), F.lit("")).alias("g"), "id").distinct()
    size = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return rows.join(size, "g")


def duplicate_rate(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of each ranking that repeats a group already present (groups: g, id)."""
    per = ranked.join(groups.select("g", "id"), "id").groupBy("query_id", "g").agg(F.count("*").alias("h"))
    extra = per.groupBy("query_id").agg(F.sum(F.greatest(F.col("h") - 1, F.lit(0))).alias("extra"), F.count("*").alias("groups_hit"))
    size = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    return size.join(extra, "query_id", "left").select("query_id", "n", F.coalesce("groups_hit", F.lit(0)).alias("groups_hit"), F.coalesce("extra", F.lit(0)).alias("redundant"), (F.coalesce("extra", F.lit(0)) / F.col("n")).alias("rate"))


def leakage(final: DataFrame, rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results that break a query's rule, by configuration and tag.

    ``rules``: query_id, tag (source_filter, session_filter or time_filter),
    value, op (before, after, at). A result unknown to the corpus only breaks a
    time rule.
    """
    met = final.join(rules, "query_id").join(corpus.select("id", "source_type", "session_id", "timestamp_start"), "id", "left")
    bound = F.col("value").try_cast("timestamp")
    late = F.when(F.col("timestamp_start").isNull(), True).when(F.col("op") == "before", F.col("timestamp_start") >= bound).when(F.col("op") == "after", F.col("timestamp_start") <= bound).otherwise(F.col("timestamp_start") != bound)
    broken = F.when(F.col("tag") == "source_filter", F.col("source_type") != F.col("value")).when(F.col("tag") == "session_filter", F.col("session_id") != F.col("value")).when(F.col("tag") == "time_filter", late)
    return met.groupBy("config", "tag").agg(F.count_if(F.coalesce(broken, F.lit(False))).alias("leaked"), F.count("*").alias("n"))


def split(rows: DataFrame, holdout: dict[str, int]) -> DataFrame:
    """The first rows of each bucket tune, the last ``holdout`` ones test (``query_id`` is a key).

    Each task keeps no more of a bucket than may be held out; only those rows meet by bucket.
    """
    if not holdout:
        return rows.withColumn("split", F.lit("tune"))
    sizes = F.create_map(*(F.lit(x) for pair in holdout.items() for x in pair))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("query_id").desc()))
    last = rows.where(F.col("bucket").isin(*holdout)).select("bucket", "query_id").withColumn("turn", turn).where(F.col("turn") <= max(holdout.values()))
    held = last.where(F.col("turn") <= sizes[F.col("bucket")]).select("query_id", F.lit(True).alias("held"))
    return rows.join(held, "query_id", "left").withColumn("split", F.when(F.col("held"), "holdout").otherwise("tune")).select(*rows.columns, "split")


def apart(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """``isolated``: one row that tells whether two sets share no key."""
    return a.select(key).intersect(b.select(key)).limit(1).agg((F.count("*") == 0).alias("isolated"))


def worst_first(groups: DataFrame, by: str, *within: str) -> DataFrame:
    """Groups with their ``place`` by a mean, the worst first, those without one last."""
    order = Window.partitionBy(*within).orderBy(F.col(by).asc_nulls_last(), "value")
    return groups.withColumn("place", F.row_number().over(order).cast("long"))


def isolated(a: DataFrame, b: DataFrame, key: str = "query_id") -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()


def id_differences(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """Keys on one side only: missing or extra."""
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by each column's value; array columns count by element."""
    out = None
    kinds = dict(rows.dtypes)
    for c in columns:
        value = F.explode(c) if kinds[c].startswith("array") else F.col(c)
        part = rows.select(F.lit(c).alias("column"), value.cast("string").alias("value")).groupBy("column", "value").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How ranks moved between two configurations of one query."""
    a, b = before.select("query_id", "id", F.col("rank").alias("old_rank")), after.select("query_id", "id", F.col("rank").alias("new_rank"))
    both = a.join(b, ["query_id", "id"], "full")
    return both.select("query_id", "id", "old_rank", "new_rank", (~F.col("old_rank").eqNullSafe(F.col("new_rank"))).alias("rank_changed"), F.coalesce((F.col("new_rank") == 1) & (F.coalesce("old_rank", F.lit(0)) != 1), F.lit(False)).alias("winner_transition"), F.coalesce(F.col("new_rank") < F.col("old_rank"), F.lit(False)).alias("promoted"))


def newest_relevant(ranked: DataFrame, judged: DataFrame, times: DataFrame) -> DataFrame:
    """Rank of each query's newest relevant row (null if it was not returned)."""
    newest = judged.where("grade > 0").join(times, "id").groupBy("query_id").agg(F.max_by("id", F.struct("timestamp_start", "id")).alias("id"))
    return newest.join(ranked, ["query_id", "id"], "left").select("query_id", "id", "rank")


def drop_rate(judged: DataFrame, relevant: DataFrame) -> DataFrame:
    """Share of candidates that deduplication dropped, and of relevant ones among them."""
    met = judged.join(relevant.where("grade > 0").select("query_id", "id", F.lit(True).alias("good")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.count_if(~F.col("kept")).alias("dropped"), F.count("*").alias("n"), (F.count_if(~F.col("kept")) / F.count("*")).alias("rate"), F.bool_or(~F.col("kept") & F.coalesce("good", F.lit(False))).alias("dropped_relevant"))


def no_evidence(returned: Column, expected_none: Column) -> Column:
    """Label of a query by whether anything should and did come back."""
    return F.when(expected_none & (returned > 0), "false_return").when(expected_none, "correct_empty").when(returned == 0, "missed").otherwise("answered")


def check_trace(events: DataFrame) -> DataFrame:
    """Events that break the trace contract."""
    bad = ~F.col("stage").isin(*TRACE_STAGES) | F.col("rank").isNull() | (F.col("rank") < 1) | F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return events.where(F.coalesce(bad, F.lit(True)))


def consistent(returned: DataFrame, traced: DataFrame) -> DataFrame:
    """Places where what was returned and what was traced differ."""
    a, b = returned.select("query_id", F.col("place").alias("rank"), F.col("content").alias("returned")), traced.select("query_id", "rank", F.col("content").alias("traced"))
    return a.join(b, ["query_id", "rank"], "full").where(~F.col("returned").eqNullSafe(F.col("traced")))


def require_empty(rows: DataFrame, code: str) -> None:
    if not rows.isEmpty():
        raise EvaluationError("a check failed", code=code)


def canonical_query(kind: Column, context: Column, text: Column) -> Column:
    """A query with its conversation before it, white space squeezed."""
    from ..functions.text import squeeze

    joined = F.concat_ws(" ", F.array_join(context, " "), text)
    return squeeze(F.when((kind == "multi_turn") & (F.size(context) > 0), joined).otherwise(text))
