"""Whether an evaluation set shows what its tags claim.

Evidence is authored; these checks recompute it from the corpus and from the
queries' own judgments. The result is a DataFrame of problems, empty when the
set holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_chars

EVIDENCE = (
    "why string, reason string, docs array<string>, relevant_docs array<string>, non_relevant_docs array<string>, entity string, "
    "operator string, iso_bound string, eligible_docs array<string>, kind string, session string, groups array<array<string>>"
)
DOC_TAGS = ("hard_negative", "cross_session", "knowledge_update", "same_name")
MIN_CJK = 8


def _same(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _inside(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def problems(ledger: DataFrame, judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, tag, problem of every claim that does not hold.

    ``ledger``: query_id, tags, evidence map<tag, JSON>; ``judgments``: query_id,
    lang, query_text, relevance; ``corpus``: id, session, timestamp, source_kind.
    """
    none = F.expr("cast(array() as array<string>)")
    asked = judgments.select("query_id", "lang", "query_text", F.map_keys(F.map_filter("relevance", lambda _, g: g > 0)).alias("relevant"))
    rows = ledger.select("query_id", "evidence", F.explode("tags").alias("tag")).join(asked, "query_id", "left")
    rows = rows.withColumn("ev", F.from_json(F.col("evidence")[F.col("tag")], EVIDENCE)).withColumn("relevant", F.coalesce("relevant", none))
    docs = F.coalesce(F.when(F.size("ev.docs") > 0, F.col("ev.docs")), F.col("ev.relevant_docs"), none)
    groups = F.coalesce("ev.groups", F.expr("cast(array() as array<array<string>>)"))
    rows = rows.withColumn("docs", docs).withColumn("groups", groups)

    # What the named documents are in the corpus.
    named = rows.select("query_id", "tag", F.explode(F.array_distinct(F.concat("docs", F.coalesce("ev.non_relevant_docs", none), F.flatten("groups")))).alias("id"))
    known = named.join(corpus.select("id", "session", "timestamp", F.lit(True).alias("known")), "id", "left")
    own = rows.select("query_id", "tag", F.explode("docs").alias("id"), F.lit(True).alias("main"))
    facts = known.join(own, ["query_id", "tag", "id"], "left").groupBy("query_id", "tag").agg(
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.count_distinct(F.when(F.col("main"), F.col("session"))).alias("sessions"),
        F.count_distinct(F.when(F.col("main"), F.col("timestamp"))).alias("stamps"),
    )

    # Time rules: every listed document must satisfy the rule, and as many as satisfy it must be listed.
    bound = F.col("ev.iso_bound").try_cast("timestamp")
    rules = rows.where("tag = 'time_filter'").select("query_id", F.col("ev.operator").alias("op"), bound.alias("bound"), F.coalesce("ev.eligible_docs", none).alias("listed"))
    fits = F.when(F.col("op") == "before", F.col("timestamp") < F.col("bound")).when(F.col("op") == "after", F.col("timestamp") > F.col("bound")).when(F.col("op") == "at", F.col("timestamp") == F.col("bound"))
    met = corpus.select("id", "timestamp").where("timestamp is not null").join(F.broadcast(rules), fits)  # one row for each rule, authored by hand
    eligible = met.groupBy("query_id").agg(F.count("*").alias("eligible"), F.count_if(F.array_contains("listed", F.col("id"))).alias("eligible_listed"))

    sessions = corpus.select(F.col("session").alias("s"), F.lit(True).alias("session_known")).distinct()
    kinds = corpus.select(F.col("source_kind").alias("k"), F.lit(True).alias("kind_known")).distinct()
    full = rows.join(facts, ["query_id", "tag"], "left").join(eligible, "query_id", "left").join(sessions, F.col("ev.session") == F.col("s"), "left").join(kinds, F.col("ev.kind") == F.col("k"), "left")

    tag, rel, ev = F.col("tag"), F.col("relevant"), lambda name: F.col(f"ev.{name}")
    flat = F.flatten("groups")
    checks: list[tuple[str, Column]] = [
        ("no evidence", F.col("ev").isNull()),
        ("no reason", F.coalesce(F.nullif(ev("why"), F.lit("")), F.nullif(ev("reason"), F.lit(""))).isNull()),
        ("no documents", tag.isin(*DOC_TAGS) & (F.size("docs") == 0)),
        ("unknown document", F.coalesce("unknown", F.lit(0)) > 0),
        ("documents are not the relevant ones", (tag == "cross_session") & ~_same(F.col("docs"), rel)),
        ("one session only", (tag == "cross_session") & (F.coalesce("sessions", F.lit(0)) < 2)),
        ("documents are not relevant", tag.isin("knowledge_update", "same_name") & ~_inside(F.col("docs"), rel)),
        ("one time only", (tag == "knowledge_update") & (F.coalesce("stamps", F.lit(0)) < 2)),
        ("no negatives", (tag == "hard_negative") & (F.coalesce(F.size("ev.non_relevant_docs"), F.lit(-1)) < 1)),
        ("a negative is relevant", (tag == "hard_negative") & F.coalesce(F.arrays_overlap(ev("non_relevant_docs"), rel), F.lit(False))),
        ("relevant documents differ", (tag == "hard_negative") & ~_same(F.coalesce(ev("relevant_docs"), none), rel)),
        ("no entity", (tag == "same_name") & F.nullif(ev("entity"), F.lit("")).isNull()),
        ("not long Chinese", (tag == "long_chinese") & ~F.coalesce((F.col("lang") == "zh") & (cjk_chars("query_text") >= MIN_CJK), F.lit(False))),
        ("bad time rule", (tag == "time_filter") & ~(F.coalesce(ev("operator").isin("before", "after", "at") & ev("iso_bound").rlike(r"(Z|\+00:00)$"), F.lit(False)) & bound.isNotNull())),
        ("eligible documents differ", (tag == "time_filter") & ((F.coalesce("eligible", F.lit(0)) != F.coalesce(F.size(F.array_distinct(ev("eligible_docs"))), F.lit(-1))) | (F.coalesce("eligible", F.lit(0)) != F.coalesce("eligible_listed", F.lit(0))) | (F.coalesce("eligible", F.lit(0)) == 0))),
        ("unknown kind", (tag == "source_filter") & F.col("kind_known").isNull()),
        ("unknown session", (tag == "session_filter") & F.col("session_known").isNull()),
        ("no groups", (tag == "duplicate_groups") & (F.size("groups") == 0)),
        ("a group of one", (tag == "duplicate_groups") & F.exists("groups", lambda g: F.size(g) < 2)),
        ("groups overlap", (tag == "duplicate_groups") & (F.size(flat) != F.size(F.array_distinct(flat)))),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks)), lambda x: x.isNotNull())
    return full.select("query_id", "tag", F.explode(found).alias("problem"))


def short_tags(ledger: DataFrame, least: dict[str, int]) -> DataFrame:
    """Tags with fewer queries than they need."""
    spark = ledger.sparkSession
    want = spark.createDataFrame(list(least.items()), "tag string, least int")
    have = ledger.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return want.join(have, "tag", "left").select("tag", "least", F.coalesce("n", F.lit(0)).alias("n")).where("n < least")


def wrong_counts(ledger: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Values of a column (bucket, split) whose number of queries is not the expected one."""
    want = ledger.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected int")
    have = ledger.groupBy(column).agg(F.count("*").alias("n"))
    return want.join(have, column, "full").select(column, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n")).where("n <> expected")
