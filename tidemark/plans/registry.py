"""The engine's queries over the test tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intent, text, times, vector
from ..operators import index as indexes
from ..operators import bytepair, channels, chunking, evaluate, filters, fusion, incremental, lifecycle, messages
from ..sources import evaluation, sessions
from .corpus import BATCH, CHUNKS, DIM, MODEL, NOW, QUERIES, chunks, index, queries, scratch, table
from .search import CONFIGS, Search, Stages, search_page

QUERY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERY[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def plan(spark, d, limit=5, offset=0, text=True, **options) -> Search:
    """A search over stored chunks that reads words and trigrams from stored indexes; without ``text`` nothing is stored for it."""
    stored = index(spark, d)
    return Search(stored.rows if text else chunks(spark, d), queries(spark, d, limit, offset), MODEL, NOW, DIM, index=stored, **options)


# -- channels ---------------------------------------------------------------

POOL = 30
DENSE = f"""dense AS (
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, c.id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
    FROM chunks c, queries q WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND c.embedding_model = '{MODEL}')) WHERE rank <= {POOL})"""
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
LEXICAL = f"""terms AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS t, count(*) OVER (PARTITION BY query_id) AS n
    FROM (SELECT DISTINCT query_id, unnest({WORDS.format("text")}) AS term FROM queries)),
  flat AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT id, {WORDS.format("content")} AS w FROM chunks WHERE embedding_model = '{MODEL}')),
  marks AS (SELECT t.query_id, f.id, f.pos, t.t, t.n FROM flat f JOIN terms t USING (term)),
  lastpos AS (SELECT *, max(CASE WHEN t = 1 THEN pos END) OVER w AS p1, max(CASE WHEN t = 2 THEN pos END) OVER w AS p2, max(CASE WHEN t = 3 THEN pos END) OVER w AS p3
    FROM marks WINDOW w AS (PARTITION BY query_id, id ORDER BY pos)),
  spans AS (SELECT *, CASE WHEN n = 1 THEN p1 WHEN n = 2 AND p1 IS NOT NULL AND p2 IS NOT NULL THEN least(p1, p2)
    WHEN n = 3 AND p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL THEN least(p1, p2, p3) END AS s FROM lastpos),
  covers AS (SELECT *, lag(s) OVER (PARTITION BY query_id, id ORDER BY pos) AS before FROM spans),
  words AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT query_id, id, sum(0.1::DOUBLE / (1 + (pos - s + 1) - n)) AS score FROM covers WHERE s IS NOT NULL AND (before IS NULL OR s > before) GROUP BY query_id, id)) WHERE rank <= {POOL})"""
GRAMS = """list_distinct(flatten(list_transform(""" + WORDS + """, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
TRIGRAM = f"""tri AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, c.id, CAST(len(list_intersect(c.g, q.g)) AS DOUBLE) / len(list_distinct(list_concat(c.g, q.g))) AS score
    FROM (SELECT id, {GRAMS.format("content")} AS g FROM chunks WHERE embedding_model = '{MODEL}') c,
      (SELECT query_id, {GRAMS.format("text")} AS g FROM queries WHERE query_id NOT IN (SELECT query_id FROM words)) q) WHERE score >= 0.3) WHERE rank <= {POOL})"""
EXACT = f"""exact AS (SELECT * FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.timestamp_start DESC NULLS LAST, c.id) AS rank
    FROM chunks c JOIN queries q ON contains(lower(c.content), lower(trim(q.text))) WHERE length(trim(q.text)) <= 20 AND c.embedding_model = '{MODEL}') WHERE rank <= {POOL})"""
BASE = f"WITH {CHUNKS}, {QUERIES}"


@register(f"{BASE}, {DENSE} SELECT query_id, id, rank, round(score, 6) AS score FROM dense")
def dense_topk_batch(spark, d):
    """Exact cosine top-k for a batch."""
    return plan(spark, d, text=False).dense.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"{BASE}, {DENSE} SELECT id, rank, round(score, 6) AS score FROM dense WHERE query_id = 0")
def dense_topk(spark, d):
    """One query as column expressions."""
    first = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    found = channels.dense_native(plan(spark, d, text=False).base(True), [float(x) for x in first.embedding], POOL)
    return found.select("id", "rank", F.round("score", 6).alias("score"))


@register(f"{BASE}, {DENSE} SELECT query_id, id, rank, round(score, 6) AS score FROM dense")
def dense_cells(spark, d):
    """The same from the stored cells of vectors, with all cells probed."""
    p = plan(spark, d)
    found = index(spark, d).all_cells.dense(p.base(True), p.asked)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"{BASE}, {LEXICAL} SELECT query_id, id, rank, round(score, 6) AS score FROM words")
def lexical_rank(spark, d):
    """Every term, cover density, from the stored postings."""
    return plan(spark, d).words.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"{BASE}, {LEXICAL} SELECT query_id, id, rank, round(score, 6) AS score FROM words")
def lexical_scan(spark, d):
    """The same by a scan of the texts, for stores without postings."""
    p = plan(spark, d)
    return channels.lexical(p.base(False), p.asked).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(
    f"""WITH {CHUNKS}, flat AS (SELECT session_id, id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT session_id, id, {WORDS.format("content")} AS w FROM chunks))
    SELECT term, id, count(*) AS n, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos, sum(pos)::BIGINT AS positions FROM flat GROUP BY term, id"""
)
def posting_rows(spark, d):
    """The stored postings, read back: every word of every chunk and where it stands."""
    stored = index(spark, d)
    rows = stored.postings.select("term", F.explode("docs").alias("doc")).select("term", "doc.id", "doc.gaps")
    zero = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda s, g: F.struct((s["last"] + g).alias("last"), (s["total"] + s["last"] + g).alias("total"))
    sums = F.aggregate("gaps", zero, step)
    out = rows.select("term", "id", F.size("gaps").cast("long").alias("n"), F.element_at("gaps", 1).alias("first_pos"), sums.alias("s"))
    out = out.select("term", "id", "n", "first_pos", F.col("s.last").alias("last_pos"), F.col("s.total").alias("positions"))
    if stored.rows.groupBy("id").count().where("count > 1").isEmpty():
        return out  # a word has one row for each id: nothing to bring together
    return out.groupBy("term", "id").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("positions").alias("positions"))


@register(
    f"""{BASE}, s AS (SELECT q.query_id, c.id, CAST(len(list_intersect(c.g, q.g)) AS DOUBLE) / len(list_distinct(list_concat(c.g, q.g))) AS score
      FROM (SELECT id, {GRAMS.format("content")} AS g FROM chunks) c, (SELECT query_id, {GRAMS.format("text")} AS g FROM queries) q)
    SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= {POOL}"""
)
def trigram_topk(spark, d):
    """Trigram similarity with its threshold, from the stored trigrams."""
    p, stored = plan(spark, d), index(spark, d)
    return indexes.trigram(stored.grams, stored.order, p.chunks, p.asked, 0.1).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


ORACLE["trigram_scan"] = ORACLE["trigram_topk"]


@register()
def trigram_scan(spark, d):
    """The same by a scan of the texts, for stores without an index."""
    p = plan(spark, d)
    return channels.trigram(p.chunks, p.asked, 0.1).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"{BASE}, {EXACT} SELECT query_id, id, rank FROM exact")
def exact_substring(spark, d):
    """Short queries as substrings, newest first."""
    return plan(spark, d).exact.select("query_id", "id", "rank")


FILTER = filters.SearchFilters.of(source_types=["fr", "en"], session_ids=["src1", "src2", "src3"], time_from="2024-01-01T06:00:00Z", time_to="2024-01-03T00:00:00+00:00")
WHERE = "source_type IN ('en', 'fr') AND session_id IN ('src1', 'src2', 'src3') AND timestamp_start >= TIMESTAMP '2024-01-01 06:00:00' AND timestamp_start < TIMESTAMP '2024-01-03'"


@register(f"WITH {CHUNKS} SELECT id, session_id, source_type FROM chunks WHERE {WHERE} AND embedding_model = '{MODEL}'")
def filtered_candidates(spark, d):
    """One predicate for all channels."""
    return plan(spark, d, text=False, filters=FILTER).base(False).select("id", "session_id", "source_type")


#: A filter for each query of the batch.
EACH = {
    0: filters.SearchFilters.of(source_types=["en"]),
    1: filters.SearchFilters.of(session_ids=["src1", "src3"]),
    2: filters.SearchFilters.of(time_from="2024-01-01T06:00:00Z"),
    3: filters.SearchFilters.of(source_types=["de", "fr"], time_to="2024-01-02T00:00:00Z"),
    4: filters.SearchFilters.of(source_types=["es", "en"], session_ids=["src2", "src4"], time_from="2024-01-01T01:00:00Z", time_to="2024-01-04T00:00:00Z"),
}
MEETS = """CASE {q}.query_id WHEN 0 THEN {c}.source_type = 'en' WHEN 1 THEN {c}.session_id IN ('src1', 'src3') WHEN 2 THEN {c}.timestamp_start >= TIMESTAMP '2024-01-01 06:00:00'
  WHEN 3 THEN {c}.source_type IN ('de', 'fr') AND {c}.timestamp_start < TIMESTAMP '2024-01-02'
  ELSE {c}.source_type IN ('es', 'en') AND {c}.session_id IN ('src2', 'src4') AND {c}.timestamp_start >= TIMESTAMP '2024-01-01 01:00:00' AND {c}.timestamp_start < TIMESTAMP '2024-01-04' END"""
EACH_DENSE = DENSE.replace("AND c.embedding_model", f"AND {MEETS.format(q='q', c='c')} AND c.embedding_model")
EACH_WORDS = LEXICAL.replace("GROUP BY query_id, id)) WHERE", f"GROUP BY query_id, id) k WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.id = k.id AND {MEETS.format(q='k', c='c')})) WHERE")
EACH_EXACT = EXACT.replace("<= 20 AND", f"<= 20 AND {MEETS.format(q='q', c='c')} AND")
EACH_TRIGRAM = TRIGRAM.replace("AS score\n    FROM (SELECT id,", "AS score\n    FROM (SELECT id, source_type, session_id, timestamp_start,").replace("FROM words)) q)", f"FROM words)) q WHERE {MEETS.format(q='q', c='c')})")


@register(
    f"""{BASE}, {EACH_DENSE}, {EACH_WORDS}, {EACH_TRIGRAM}, {EACH_EXACT}
    SELECT 'dense' AS channel, query_id, id, rank FROM dense UNION ALL SELECT 'words', query_id, id, rank FROM words
    UNION ALL SELECT 'trigram', query_id, id, rank FROM tri UNION ALL SELECT 'exact', query_id, id, rank FROM exact"""
)
def filters_by_query(spark, d):
    """Five queries with five filters, in every channel."""
    asked = queries(spark, d)
    p = Search(chunks(spark, d), asked, MODEL, NOW, DIM, filters=filters.QueryFilters(EACH, asked), index=index(spark, d))
    parts = {"dense": p.dense, "words": p.words, "trigram": p.grams, "exact": p.exact}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(c).alias("channel"), "query_id", "id", "rank") for c, rows in parts.items()))


# -- fusion to page ---------------------------------------------------------

FUSED = f"""fused AS (SELECT query_id, id, sum(w) AS score, max(d) AS dense_rank, max(l) AS lexical_rank, max(e) AS exact_rank FROM (
    SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS w, rank AS d, NULL::BIGINT AS l, NULL::BIGINT AS e FROM dense
    UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), NULL, rank, NULL FROM (SELECT query_id, id, rank FROM words UNION ALL SELECT query_id, id, rank FROM tri)
    UNION ALL SELECT query_id, id, 1.0::DOUBLE / 61, NULL, NULL, rank FROM exact) GROUP BY query_id, id)"""
ALL = f"{BASE}, {DENSE}, {LEXICAL}, {TRIGRAM}, {EXACT}, {FUSED}"
AGE = "CASE WHEN coalesce(timestamp_start, created_at) IS NULL THEN 0.25 ELSE pow(2.0, -(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(coalesce(timestamp_start, created_at))) / 86400000000.0 / 30) END"
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM (
    SELECT f.query_id, f.id, f.score * (CASE WHEN f.query_id = 2 THEN {AGE} ELSE 1 END) AS score, f.query_id = 2 AS decayed, dense_rank, lexical_rank, exact_rank,
      c.content, c.session_id, c.source_type, c.embedding, c.timestamp_start FROM fused f JOIN chunks c USING (id)))"""


@register(f"{ALL} SELECT query_id, id, round(score, 9) AS score, dense_rank, lexical_rank, exact_rank FROM fused")
def rrf_fusion(spark, d):
    """Reciprocal-rank fusion of all channels, trigram where words find nothing."""
    return fusion.fuse(plan(spark, d).pools).select("query_id", "id", F.round("score", 9).alias("score"), "dense_rank", "lexical_rank", "exact_rank")


@register(f"WITH {CHUNKS} SELECT id, round({AGE}, 9) AS factor FROM chunks")
def temporal_decay(spark, d):
    """Half-life of 30 days, with both fallbacks."""
    return chunks(spark, d).select("id", F.round(times.decay(F.lit(NOW), "timestamp_start", "created_at"), 9).alias("factor"))


@register(f"{ALL}, {RANKED} SELECT query_id, id, round(score, 9) AS score, rank, decayed FROM ranked")
def fused_ranking(spark, d):
    """Intent decides on decay; ranks after it."""
    return plan(spark, d).ranked.select("query_id", "id", F.round("score", 9).alias("score"), "rank", "decayed")


@register(f"{ALL}, {RANKED} SELECT query_id, id, round(score, 9) AS score, rank AS place FROM ranked WHERE rank > 2 AND rank <= 6")
def hybrid_page(spark, d):
    """A page of the full search without deduplication."""
    found = plan(spark, d, 4, 2, stages=Stages(dedup=False))
    return found.results.select("query_id", "id", F.round("score", 9).alias("score"), "place")


@register(f"{ALL}, {RANKED} SELECT query_id, count(*) AS fetched, count(*) > 5 AS has_more, CASE WHEN count(*) > 5 THEN 5::BIGINT END AS next_offset FROM ranked WHERE rank <= 6 GROUP BY query_id")
def lookahead_page(spark, d):
    """One row more than the page answers whether there is another."""
    rows = plan(spark, d, 6, 0, stages=Stages(dedup=False)).results
    more = F.count("*") > 5
    return rows.groupBy("query_id").agg(F.count("*").alias("fetched"), more.alias("has_more"), F.when(more, F.lit(5).cast("long")).alias("next_offset"))


@register(
    f"""{ALL}, {RANKED}, wanted AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM ranked WHERE rank <= 6)
    SELECT query_id, id, CAST(rank - 2 AS INTEGER) AS place, c > 5 AS has_more, CASE WHEN c > 5 THEN 5 END AS next_offset FROM wanted WHERE rank > 2 AND rank <= 5"""
)
def search_pages(spark, d):
    """The paging call itself, once for each query: look-ahead, page, next offset."""
    stored = index(spark, d)
    rows, parts = stored.rows, []
    for q in queries(spark, d).collect():  # the batch: five queries
        page = search_page(rows, q.text, lambda t, v=q.embedding: v, 3, 2, stages=Stages(dedup=False), model=MODEL, now=NOW, dim=DIM, index=stored)
        parts += [(q.query_id, r.id, k, page.has_more, page.next_offset) for k, r in enumerate(page.results, 1)]
    return spark.createDataFrame(parts, "query_id int, id string, place int, has_more boolean, next_offset int")


def _shared(spark, d) -> DataFrame:
    """Rows whose equal contents share a vector, all of one query and one rank."""
    w = Window.partitionBy("content").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunks(spark, d).select("id", "content", F.col("source_type").alias("session_id"), F.lit("s").alias("source_type"), F.first("embedding").over(w).alias("embedding"))
    return rows.withColumn("query_id", F.lit(0)).withColumn("rank", F.lit(0).cast("long"))


@register(
    f"""WITH {CHUNKS}, shared AS (SELECT id, content, source_type AS session_id, first_value(embedding) OVER (PARTITION BY content ORDER BY id) AS e FROM chunks),
    judged AS (SELECT id, e IS NULL OR row_number() OVER (PARTITION BY content, session_id ORDER BY k, id) = 1 AS kept
      FROM (SELECT *, 0 AS k FROM shared)) SELECT id, kept FROM judged"""
)
def dedup_provenance(spark, d):
    """Equal content in one session collapses, rows without a vector stay."""
    return fusion.dedup(_shared(spark, d)).select("id", "kept")


@register(
    f"""{ALL}, {RANKED} SELECT query_id, id, dense_rank IS NOT NULL AS dense_matched, lexical_rank IS NOT NULL AS lexical_matched, exact_rank IS NOT NULL AS exact_matched,
    (dense_rank IS NOT NULL)::INT + (lexical_rank IS NOT NULL)::INT + (exact_rank IS NOT NULL)::INT AS n, decayed FROM ranked WHERE rank <= 5"""
)
def explain_channels(spark, d):
    """Where each result came from."""
    rows = plan(spark, d, stages=Stages(dedup=False)).results
    c = F.col("explain.channels")
    return rows.select("query_id", "id", c["dense"]["matched"].alias("dense_matched"), c["lexical"]["matched"].alias("lexical_matched"), c["exact"]["matched"].alias("exact_matched"), F.col("explain.matched_channel_count").alias("n"), "decayed")


def _count(name: str, rel: str) -> str:
    return f"coalesce((SELECT count(*) FROM {rel} r WHERE r.query_id = q.query_id), 0) AS {name}"


@register(
    f"""{ALL}, {RANKED}, lex AS (SELECT query_id FROM words UNION ALL SELECT query_id FROM tri)
    SELECT query_id, 30 AS pool_limit, {_count("dense_fetched", "dense")}, {_count("lexical_fetched", "lex")}, {_count("exact_fetched", "exact")}, {_count("fused_candidate_count", "fused")},
      CASE WHEN query_id IN (SELECT query_id FROM words) THEN 'ts_rank_cd' ELSE 'trigram_fallback' END AS lexical_method FROM queries q"""
)
def explain_summary(spark, d):
    """What each channel fetched."""
    s = plan(spark, d, stages=Stages(dedup=False)).summary
    return s.select("query_id", "pool_limit", "dense_fetched", "lexical_fetched", "exact_fetched", "fused_candidate_count", "lexical_method")


KEPT = """twins AS (SELECT r.query_id, r.id FROM ranked r JOIN ranked e ON e.query_id = r.query_id AND e.rank < r.rank AND e.content = r.content AND e.session_id = r.session_id AND e.source_type = r.source_type
    WHERE r.embedding IS NOT NULL AND e.embedding IS NOT NULL AND list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) > 0.85),
  kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS place FROM ranked r ANTI JOIN twins t ON t.query_id = r.query_id AND t.id = r.id)"""


@register(
    f"""{ALL}, {RANKED}, {KEPT}, lex AS (SELECT query_id, id, rank FROM words UNION ALL SELECT query_id, id, rank FROM tri),
    parts AS (SELECT query_id, id, 'd' AS ch, 1.0::DOUBLE / (60 + rank) AS w FROM dense UNION ALL SELECT query_id, id, 'l', 1.0::DOUBLE / (60 + rank) FROM lex UNION ALL SELECT query_id, id, 'e', 1.0::DOUBLE / 61 FROM exact),
    configs AS (SELECT * FROM (VALUES ('dense-only', 'd'), ('lexical-only', 'l'), ('rrf', 'dl'), ('+exact', 'dle')) c(config, chs))
    SELECT config, query_id, id, rank, round(score, 9) AS score FROM (SELECT config, query_id, id, score, row_number() OVER (PARTITION BY config, query_id ORDER BY round(score, 12) DESC, id) AS rank FROM (
      SELECT config, query_id, id, sum(w) AS score FROM parts JOIN configs ON contains(chs, ch) GROUP BY ALL)) WHERE rank <= 5
    UNION ALL SELECT '+temporal', query_id, id, rank, round(score, 9) FROM ranked WHERE rank <= 5
    UNION ALL SELECT '+dedup', query_id, id, place, round(score, 9) FROM kept WHERE place <= 5"""
)
def ablation_matrix(spark, d):
    """The six configurations side by side."""
    base = plan(spark, d)
    parts = [base.variant(stages).results.select(F.lit(c).alias("config"), "query_id", "id", F.col("place").alias("rank"), F.round("score", 9).alias("score")) for c, stages in CONFIGS.items()]
    return reduce(DataFrame.unionByName, parts)


EVENTS = " UNION ALL ".join(
    f"SELECT query_id, '{stage}' AS stage, '{reason}' AS reason, count(*) AS n FROM {rel} GROUP BY query_id"
    for stage, reason, rel in (
        ("dense", "candidate", "dense"),
        ("lexical", "candidate", "(SELECT query_id FROM words UNION ALL SELECT query_id FROM tri)"),
        ("exact", "candidate", "exact"),
        ("fused", "fused", "fused"),
        ("temporal", "ranked", "ranked"),
        ("dedup", "kept", "(SELECT query_id FROM kept)"),
        ("dedup", "duplicate", "(SELECT DISTINCT query_id, id FROM twins)"),
        ("final", "returned", "(SELECT query_id FROM kept WHERE place <= 5)"),
    )
)


@register(
    f"""{ALL}, {RANKED}, {KEPT} SELECT query_id, place, id, round(score, 9) AS score, session_id, source_type,
    (dense_rank IS NOT NULL)::INT + (lexical_rank IS NOT NULL)::INT + (exact_rank IS NOT NULL)::INT > 1 AS multi_channel FROM kept WHERE place <= 5"""
)
def hybrid_search(spark, d):
    """The whole search: every stage on."""
    return plan(spark, d).results.select("query_id", "place", "id", F.round("score", 9).alias("score"), "session_id", "source_type", F.col("explain.multi_channel").alias("multi_channel"))


@register(f"{ALL}, {RANKED}, {KEPT} {EVENTS}")
def search_trace(spark, d):
    """The events of every stage, counted."""
    return plan(spark, d).trace().groupBy("query_id", "stage", "reason").agg(F.count("*").alias("n"))


# -- ingest -----------------------------------------------------------------

def _sql_redact(column: str) -> str:
    """The redactions for an engine without lookbehind: what stands before a word is put back."""
    for pattern, mark in text.REDACTIONS:
        if text.EDGE in pattern:
            pattern, mark = pattern.replace(text.EDGE, r"(^|[^\p{L}\p{N}_])"), r"\1" + mark
        column = f"regexp_replace({column}, '{pattern}', '{mark}', 'g')"
    return column


TALK = f"""talk AS (SELECT conv_id, turn, '[' || role || '] ' || {_sql_redact("trim(text)")} AS item FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND length(trim(text)) >= 5
    AND NOT (role = 'assistant' AND starts_with(ltrim(text), '{{') AND contains(substr(text, 1, 100), '"tool_calls"')))"""


def _items(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", "text", F.lit(None).cast("string").alias("timestamp"), F.col("turn").alias("turn_index"))
    return messages.session_items(rows)


@register(f"WITH {TALK} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index, item FROM talk")
def message_items(spark, d):
    """User and assistant turns as redacted items."""
    return _items(spark, d).where(F.length("item") > 10).select("session_id", "turn_index", "item")


@register(
    f"""WITH {TALK}, placed AS (SELECT *, coalesce(sum(length(item) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM talk),
    whole AS (SELECT conv_id, regexp_extract_all(string_agg(item, chr(10) ORDER BY turn), '\\s*\\S+|\\s+') AS t FROM talk GROUP BY conv_id),
    cut AS (SELECT conv_id, t, len(t) AS n, unnest(range(0, greatest(len(t) - 80 - 1, 0) + 1, 320)) AS s FROM whole),
    win AS (SELECT *, length(coalesce(array_to_string(t[1:s], ''), '')) AS c0, array_to_string(t[s + 1:s + 400], '') AS content FROM cut)
    SELECT CAST(w.conv_id AS VARCHAR) AS session_id, CAST(w.s // 320 AS INTEGER) AS chunk_no, CAST(w.s AS INTEGER) AS token_start, CAST(least(w.s + 400, w.n) AS INTEGER) AS token_end, w.content,
      CAST(min(p.turn) AS INTEGER) AS turn_index_start, CAST(max(p.turn) AS INTEGER) AS turn_index_end
    FROM win w JOIN placed p ON p.conv_id = w.conv_id AND p.s < w.c0 + length(w.content) AND p.s + length(p.item) > w.c0 GROUP BY ALL"""
)
def conversation_chunks(spark, d):
    """Overlapping token windows and the items that they meet."""
    return chunking.chunk(_items(spark, d), ["session_id"]).select("session_id", "chunk_no", "token_start", "token_end", "content", "turn_index_start", "turn_index_end")


def _pairs(vocabulary: str | None = None) -> bytepair.BytePairs:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytepair.BytePairs(vocabulary)


BLANK = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@register(
    f"""WITH {TALK}, own AS (SELECT conv_id, turn, item, regexp_extract(item, '{BLANK}+$') AS tail FROM talk),
    cut AS (SELECT conv_id, turn, item, row_number() OVER w AS seq, coalesce(lag(tail) OVER w || chr(10), '') || CASE WHEN lead(turn) OVER w IS NULL THEN item ELSE substr(item, 1, length(item) - length(tail)) END AS piece
      FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(seq AS INTEGER) AS seq, CAST(turn AS INTEGER) AS turn_index, strlen(piece) AS n_bytes, md5(piece) AS piece_md5,
      CAST(coalesce(sum(strlen(piece)) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM cut"""
)
def bytepair_pieces(spark, d):
    """A session cut where no merge crosses; each piece's bytes, as its tokens cover them, and where it stands."""
    cut = bytepair.spans(_items(spark, d), ["session_id"], [F.col("turn_index")], _pairs())
    own = Window.partitionBy("session_id").orderBy("seq")
    size = F.element_at("ends", -1).cast("long")
    start = F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.select("session_id", "seq", "turn_index", size.alias("n_bytes"), F.md5("text").alias("piece_md5"), start.alias("start_byte"))


@register()
def bytepair_chunks(spark, d):
    """Windows of 400 byte-pair tokens, as one encoding of each whole session gives them (no SQL: tested against the library)."""
    return chunking.chunk(_items(spark, d), ["session_id"], tokenizer=_pairs(), order=[F.col("turn_index")]).select("session_id", "chunk_no", "token_start", "token_end", "content", "turn_index_start", "turn_index_end")


@register(
    """WITH lines AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    f AS (SELECT path, bool_or(contains(substr(v, 1, 200), 'Subagent')) AS sub, bool_or(contains(substr(v, 1, 200), '[cron:') OR contains(substr(v, 1, 200), 'cron job')) AS cron FROM lines WHERE n <= 20 GROUP BY path)
    SELECT path, CASE WHEN sub THEN 'subagent' WHEN cron THEN 'cron' ELSE 'main_user' END AS source_type FROM f"""
)
def session_classify(spark, d):
    """Source type from the head of a file."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("n", "value")).withColumn("line_no", F.col("n") + 1)
    return messages.classify(lines)


NAMES = """files AS (SELECT doc_id, 's' || CAST(doc_id // 4 AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.jsonl.deleted.1' WHEN 2 THEN '.jsonl.deleted.2' ELSE '.trajectory.jsonl' END AS name, n_chars AS size FROM documents)"""


def _files(spark, d) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, ".jsonl").when(k == 1, ".jsonl.deleted.1").when(k == 2, ".jsonl.deleted.2").otherwise(".trajectory.jsonl")
    return table(spark, d, "documents").select(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 4).cast("string"), tail).alias("name"), F.col("n_chars").alias("size"))


@register(
    f"""WITH {NAMES}, own AS (SELECT *, split_part(name, '.', 1) AS key, contains(name, '.deleted.') AS gone, count(*) OVER (PARTITION BY split_part(name, '.', 1)) AS c FROM files WHERE NOT contains(name, '.trajectory.jsonl')),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, gone ORDER BY size DESC, name) AS n FROM own)
    SELECT name, size, key || CASE WHEN gone THEN ':deleted' ELSE '' END AS session_id FROM r WHERE c = 1 OR NOT gone OR n = 1"""
)
def file_versions(spark, d):
    """Session files, the largest of the deleted versions."""
    from ..sources.sessions import choose

    return choose(_files(spark, d)).select("name", "size", messages.session_id("name").alias("session_id"))


@register("SELECT source, CASE source WHEN 'subagent' THEN 'subagent' WHEN 'cron' THEN 'cron' ELSE 'main_user' END AS source_type, count(*) AS n FROM documents GROUP BY ALL")
def source_map(spark, d):
    """Vocabulary with a default."""
    return table(spark, d, "documents").groupBy("source", messages.source_type("source").alias("source_type")).agg(F.count("*").alias("n"))


WIDE = "'é' || 'ghp_' || doc_id || ' Authorization' || chr(12288) || ': bearer' || chr(160) || doc_id || '.t ' || 'ghp_' || doc_id || chr(8195) || text"


@register(f"SELECT doc_id, {_sql_redact('text')} AS text, {_sql_redact(WIDE)} AS wide FROM documents")
def redact_documents(spark, d):
    """Sensitive shapes in documents, also behind white space and letters beyond ASCII."""
    wide = F.expr("concat('éghp_', doc_id, ' Authorization\u3000: bearer\u00a0', doc_id, '.t ghp_', doc_id, '\u2003', text)")
    return table(spark, d, "documents").select("doc_id", text.redact("text").alias("text"), text.redact(wide).alias("wide"))


@register(f"SELECT page_id, {_sql_redact('html')} AS html FROM pages")
def redact_pages(spark, d):
    """Sensitive shapes in pages."""
    return table(spark, d, "pages").select("page_id", text.redact("html").alias("html"))


def _sql_audit() -> str:
    parts = []
    for name, pattern in text.AUDIT.items():
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{name}' AS category, regexp_extract(text, '{p}') AS m FROM documents WHERE regexp_matches(text, '{p}')")
    sample = (
        "CASE WHEN category = 'email_in_blob' THEN regexp_matches(lower(m), '@[^@]*(\\.example|\\.invalid|\\.test)$') WHEN category = 'credential_assignment' THEN "
        "regexp_matches(lower(regexp_replace(trim(regexp_replace(regexp_replace(m, '^[^=]*=', ''), '^[^:]*:', '')), '^[\"'']+|[\"'']+$', '', 'g')), '^(password|secret|xxx|<redacted>)$|^(test-|fake-|fixture-|example-)') ELSE false END"
    )
    return f"SELECT category, count(*) AS n, count(*) FILTER (NOT {sample}) AS n_blocking FROM ({' UNION ALL '.join(parts)}) GROUP BY category"


@register(_sql_audit())
def audit_patterns(spark, d):
    """Audit categories, all and blocking."""
    return lifecycle.audit_counts(lifecycle.audit(table(spark, d, "documents"), "doc_id"))


@register(
    """WITH f AS (SELECT doc_id, 'docs/' || doc_id AS path, sha256(text) AS digest, regexp_extract(text, '[A-Za-z]*a[a-z]*e[a-z]*') AS m FROM documents WHERE regexp_matches(text, '[A-Za-z]*a[a-z]*e[a-z]*'))
    SELECT doc_id, m AS "match", NOT (doc_id % 4 = 0 OR doc_id % 8 = 1 OR (doc_id % 5 = 2 AND regexp_full_match(m, 's.*')) OR regexp_full_match(m, 'm[a-z]*')) AS blocking FROM f"""
)
def audit_allowed(spark, d):
    """Findings that rules allow by path, by digest, by match at a path and by match anywhere."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), F.regexp_substr("text", F.lit("[A-Za-z]*a[a-z]*e[a-z]*")).alias("match"))
    found = docs.where("match is not null").select("doc_id", F.lit("word").alias("category"), "match", F.lit(True).alias("blocking"), F.lit("artifact").alias("source"), "path", "digest")
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    rules = [
        docs.where(k % 4 == 0).select(F.lit("word").alias("category"), none.alias("source"), "path", none.alias("digest"), none.alias("match")),
        docs.where(k % 4 == 1).select(F.lit("word"), F.lit("artifact"), "path", F.when(k % 8 == 1, F.col("digest")).otherwise("another"), none),
        docs.where(k % 5 == 2).select(F.lit("word"), none, "path", none, F.lit("s.*")),
        docs.where(k % 5 == 3).select(F.lit("word"), F.lit("commit"), "path", none, none),
        spark.createDataFrame([("word", None, None, None, "m[a-z]*"), ("email", None, None, None, None)], lifecycle.ALLOWED),
    ]
    return lifecycle.allow(found, reduce(DataFrame.union, rules)).select("doc_id", "match", "blocking")


CHECKS = """found AS (SELECT 'f' || doc_id AS file_path, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS file_mtime, n_chars AS file_size FROM documents),
  state AS (SELECT file_path, CASE WHEN doc_id % 5 = 1 THEN file_mtime - INTERVAL 1 HOUR ELSE file_mtime END AS file_mtime, CASE WHEN doc_id % 7 = 2 THEN 0 ELSE file_size END AS file_size, source_type
    FROM (SELECT 'f' || doc_id AS file_path, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS file_mtime, n_chars AS file_size, doc_id, lang AS source_type FROM documents WHERE doc_id % 3 <> 0))"""


def _found(spark, d) -> DataFrame:
    start = F.lit(1704067200)
    return table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.timestamp_seconds(start + F.col("doc_id")).alias("file_mtime"), F.col("n_chars").alias("file_size"), "doc_id", F.col("lang").alias("source_type"))


def _state(spark, d) -> DataFrame:
    rows = _found(spark, d).where("doc_id % 3 <> 0")
    mtime = F.when(F.col("doc_id") % 5 == 1, F.col("file_mtime") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("file_mtime"))
    size = F.when(F.col("doc_id") % 7 == 2, F.lit(0)).otherwise(F.col("file_size"))
    return rows.select("file_path", mtime.alias("file_mtime"), size.cast("long").alias("file_size"), size.cast("long").alias("processed_offset"), F.lit(NOW).alias("processed_at"), "source_type", F.lit(1).alias("chunks_created"), F.lit(0).alias("facts_created"))


@register(f"WITH {CHECKS} SELECT file_path, file_size FROM found f WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.file_path = f.file_path AND s.file_mtime = f.file_mtime AND s.file_size = f.file_size)")
def checkpoint_diff(spark, d):
    """Files whose path, time and size are not all known."""
    return incremental.changed_files(_found(spark, d), _state(spark, d)).select("file_path", "file_size")


@register(
    f"""WITH {CHECKS}, new AS (SELECT file_path, CASE WHEN file_size % 2 = 0 THEN 0 ELSE file_size END AS file_size, file_size AS processed_offset, 'new' AS source_type FROM found WHERE file_size % 4 < 2)
    SELECT coalesce(n.file_path, s.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN s.file_size ELSE n.file_size END AS file_size,
      CASE WHEN n.file_path IS NULL THEN s.file_size ELSE n.processed_offset END AS processed_offset, coalesce(s.source_type, n.source_type) AS source_type FROM state s FULL JOIN new n ON n.file_path = s.file_path"""
)
def checkpoint_upsert(spark, d):
    """K3, K4: keep the new row, the old source type, size 0 for partial files."""
    new = _found(spark, d).where("file_size % 4 < 2").select("file_path", "file_mtime", "file_size", F.lit(None).cast("long").alias("processed_offset"), F.lit(NOW).alias("processed_at"), F.lit("new").alias("source_type"), F.lit(2).alias("chunks_created"), F.lit(0).alias("facts_created"), (F.col("file_size") % 2 == 0).alias("partial"))
    return incremental.upsert_checkpoints(_state(spark, d), new).select("file_path", "file_size", "processed_offset", "source_type")


STORE = """sess AS (SELECT conv_id, count(*) AS n, conv_id % 3 AS rewind, CASE WHEN conv_id % 10 = 0 THEN NULL ELSE 1000 + conv_id END AS active FROM conversations GROUP BY conv_id),
  st AS (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN n - 1 ELSE n END AS n, CASE WHEN conv_id % 5 = 2 THEN rewind + 1 ELSE rewind END AS rewind, active FROM sess WHERE conv_id % 2 = 1)"""


def _sessions(spark, d) -> DataFrame:
    c = F.col("conv_id")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"))
    return rows.select(c.cast("string").alias("session_id"), F.lit(None).cast("long").alias("started_at"), F.when(c % 10 != 0, 1000 + c).alias("last_activity_at"), "message_count", (c % 3).alias("rewind_count"), "conv_id")


@register(
    f"""WITH {STORE} SELECT CAST(a.conv_id AS VARCHAR) AS session_id, CASE WHEN a.active IS NULL THEN 'skip' WHEN b.conv_id IS NULL THEN 'replace' WHEN a.n = b.n AND a.rewind = b.rewind THEN 'skip'
      WHEN a.rewind <> b.rewind THEN 'replace' ELSE 'append' END AS status FROM sess a LEFT JOIN st b ON a.conv_id = b.conv_id"""
)
def store_incremental(spark, d):
    """Skip, append or rebuild each store session."""
    rows = _sessions(spark, d)
    known = rows.where("conv_id % 2 = 1").select(
        F.concat(F.lit("store://"), "session_id").alias("file_path"),
        F.col("last_activity_at").alias("file_mtime"),
        F.when(F.col("conv_id") % 4 == 1, F.col("message_count") - 1).otherwise(F.col("message_count")).alias("file_size"),
        F.when(F.col("conv_id") % 5 == 2, F.col("rewind_count") + 1).otherwise(F.col("rewind_count")).alias("processed_offset"),
    )
    return incremental.session_status(rows, known).select("session_id", "status")


@register(
    """WITH m AS (SELECT conv_id, coalesce(max(turn), 0) AS t FROM conversations WHERE turn < 3 AND conv_id % 2 = 0 GROUP BY conv_id)
    SELECT CAST(c.conv_id AS VARCHAR) AS session_id, count(*) AS n, min(c.turn) AS first_new FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id WHERE c.turn > coalesce(m.t, 0) GROUP BY c.conv_id"""
)
def grown_sessions(spark, d):
    """Turns after the last stored one."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), "conv_id")
    stored = rows.where("turn_index < 3 and conv_id % 2 = 0").withColumn("turn_index_end", F.col("turn_index"))
    return incremental.new_turns(rows, stored).groupBy("session_id").agg(F.count("*").alias("n"), F.min("turn_index").alias("first_new"))


@register(
    """SELECT conv_id, turn, text FROM conversations c WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND length(text) > 0 AND (turn % 4 <> 3 OR conv_id % 2 = 0)
    AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn % 4 = 3)"""
)
def store_messages(spark, d):
    """Visible messages of sessions that were rewound once."""
    from ..sources.store import rewound, visible_messages

    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("content"), F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), (F.col("turn") % 4 != 3).cast("int").alias("active"), (F.col("conv_id") % 2 == 0).cast("int").alias("compacted"))
    gone = rows.where("turn % 4 = 3").select("session_id").distinct()
    sessions = rewound(rows.select("session_id").distinct(), gone).where("rewound").select("session_id")
    return visible_messages(rows).join(sessions, "session_id", "left_semi").select("conv_id", "turn", F.col("content").alias("text"))


@register(
    f"""WITH m AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS g, event_type AS u, props, event_id % 5 AS k FROM events)
    SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || coalesce(nullif(g, ''), u) || ': ' || {_sql_redact("trim(props || CASE WHEN k = 1 THEN ' [attachment: a.txt]' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' [embed: t]' ELSE '' END)")} AS item FROM m WHERE k < 4"""
)
def chat_messages(spark, d):
    """Chat records as items."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    rows = e.select(
        "event_id",
        F.when(k < 4, F.lit(0)).otherwise(F.lit(7)).alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("props").alias("content"),
        F.struct(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("global_name"), F.col("event_type").alias("username")).alias("author"),
        F.when(k == 1, F.array(F.struct(F.lit("a.txt").alias("filename")))).alias("attachments"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("t").alias("title")))).alias("embeds"),
        F.col("event_id").alias("turn_index"),
    )
    return messages.chat_items(rows, keep=("event_id",)).select("event_id", "item")


# -- lifecycle --------------------------------------------------------------


def _bound(spark, d) -> DataFrame:
    c = chunks(spark, d)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("store://"), F.col("session_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/chat/"), F.col("session_id"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/data/sessions/"), F.col("session_id"), F.lit(".jsonl")))
    return lifecycle.bindings(c.select(path.alias("file_path"), F.col("timestamp_start").alias("processed_at")))


BOUND = f"""{CHUNKS}, bound AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'chat' ELSE 'sessions' END AS scope, CASE WHEN doc_id % 3 = 1 THEN 'chat-' ELSE '' END || session_id AS session_id, timestamp_start AS processed_at FROM chunks)"""
DAYS = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(processed_at)) / 86400000000.0"


@register(f"WITH {CHUNKS} SELECT session_id FROM (SELECT CAST(doc_id // 7 AS VARCHAR) AS session_id, bool_and(coalesce((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(timestamp_start)) / 86400000000.0 > 29, false)) AS old FROM chunks GROUP BY 1) WHERE old")
def retention_eligible(spark, d):
    """Sessions that are old in every binding."""
    own = F.floor(F.col("doc_id") / 7).cast("string")
    return lifecycle.old_enough(chunks(spark, d).select(own.alias("session_id"), F.col("timestamp_start").alias("processed_at")), F.lit(NOW), 29)


@register(
    f"""WITH {BOUND} SELECT scope, count(*) AS n, count(*) FILTER ({DAYS} > CASE scope WHEN 'chat' THEN 30 ELSE 90 END) AS expired, round(max({DAYS}), 6) AS oldest_days, round(min({DAYS}), 6) AS newest_days,
      CASE scope WHEN 'chat' THEN 30 ELSE 90 END AS retention_days FROM bound GROUP BY scope"""
)
def retention_report(spark, d):
    """Ages by scope."""
    r = lifecycle.retention_report(_bound(spark, d), F.lit(NOW))
    return r.select("scope", "n", "expired", F.round("oldest_days", 6).alias("oldest_days"), F.round("newest_days", 6).alias("newest_days"), "retention_days")


@register(f"WITH {BOUND} SELECT session_id AS key, count(DISTINCT scope) AS n FROM bound GROUP BY session_id HAVING count(DISTINCT scope) > 1")
def scope_conflicts(spark, d):
    """Sessions claimed by several scopes."""
    return lifecycle.conflicts(_bound(spark, d)).where("kind = 'session'").select("key", "n")


@register(f"WITH {CHUNKS} SELECT id FROM chunks WHERE session_id NOT IN (SELECT session_id FROM chunks WHERE doc_id % 97 = 5)")
def scope_delete(spark, d):
    """What stays after a deletion."""
    c = chunks(spark, d)
    kept, _ = lifecycle.delete({"session_chunks": c}, c.where("doc_id % 97 = 5"))
    return kept["session_chunks"].select("id")


@register(f"WITH {CHUNKS} SELECT substr(sha256(session_id), 1, 16) AS session, source_type, {_sql_redact('content')} AS content FROM chunks WHERE session_id IN ('src1', 'src2')")
def scope_export_rows(spark, d):
    """Redacted rows of a scope."""
    c = chunks(spark, d).withColumn("metadata", F.lit(None).cast("string"))
    own = spark.createDataFrame([("src1",), ("src2",)], "session_id string")
    return lifecycle.export_rows(c, own).select("session", "source_type", "content")


@register(
    f"""WITH {CHUNKS}, own AS (
      SELECT 'chunk' AS kind, session_id, source_type, NULL AS category, content, timestamp_start AS t0, id FROM chunks WHERE doc_id % 3 = 0 AND session_id <> 'src0'
      UNION ALL SELECT 'fact', session_id, NULL, source_type, content, timestamp_start, id FROM chunks WHERE doc_id % 3 = 1 AND session_id <> 'src0')
    SELECT kind, substr(sha256(session_id), 1, 16) AS session, source_type, category, {_sql_redact('content')} AS content,
      CASE WHEN kind = 'chunk' THEN t0 END AS timestamp_start, CASE WHEN kind = 'fact' THEN t0 END AS "timestamp" FROM own"""
)
def scope_export_facts(spark, d):
    """K7: chunks and facts of a scope, each with what its kind holds."""
    c = chunks(spark, d).withColumn("metadata", F.lit(None).cast("string"))
    facts = c.where("doc_id % 3 = 1").select("id", "session_id", F.col("source_type").alias("category"), "content", F.col("timestamp_start").alias("timestamp"), F.lit(None).cast("string").alias("task_summary"), "metadata")
    own = c.select("session_id").distinct().where("session_id <> 'src0'")
    rows = lifecycle.export_rows(c.where("doc_id % 3 = 0"), own, facts)
    return rows.select("kind", "session", "source_type", "category", "content", "timestamp_start", "timestamp")


@register(
    f"""WITH {CHUNKS}, late AS (SELECT bool_and(embedding IS NOT NULL) AS complete FROM chunks WHERE session_id = 'src3')
    SELECT id, CASE WHEN session_id IN ('src1', 'src2') THEN 'new ' || content WHEN session_id = 'src3' AND complete THEN 'late ' || content ELSE content END AS content FROM chunks, late"""
)
def replace_by_session(spark, d):
    """K1, T5: sessions replaced as a whole, again with the same result, and not at all if a vector is missing."""
    old = chunks(spark, d).select("id", "session_id", "content", "embedding")
    new = old.where("session_id in ('src1', 'src2')").withColumn("content", F.concat(F.lit("new "), "content")).withColumn("embedding", F.coalesce("embedding", F.array(F.lit(0.5).cast("float"))))
    late = old.where("session_id = 'src3'").withColumn("content", F.concat(F.lit("late "), "content"))
    once = incremental.replace_sessions(old, new)
    return incremental.replace_sessions(incremental.replace_sessions(once, new), late).select("id", "content")


@register(
    f"""WITH {CHUNKS}, old AS (SELECT * FROM chunks WHERE doc_id % 4 <> 0), whole AS (SELECT * FROM chunks WHERE doc_id % 4 = 0 AND embedding IS NOT NULL)
    SELECT 'complete' AS batch, id FROM old UNION ALL SELECT 'complete', id FROM whole UNION ALL SELECT 'partial', id FROM old
    UNION ALL SELECT 'partial', id FROM chunks WHERE doc_id % 4 = 0 AND (SELECT bool_and(embedding IS NOT NULL) FROM chunks WHERE doc_id % 4 = 0)"""
)
def append_mode(spark, d):
    """K2: rows appended without deleting, all of a batch or none."""
    c = chunks(spark, d).select("id", "embedding", "doc_id")
    old, new = c.where("doc_id % 4 <> 0"), c.where("doc_id % 4 = 0")
    parts = [incremental.append_rows(old, rows).select(F.lit(name).alias("batch"), "id") for name, rows in (("complete", new.where("embedding is not null")), ("partial", new))]
    return parts[0].unionByName(parts[1])


@register(
    """WITH gone AS (SELECT conv_id FROM conversations EXCEPT SELECT conv_id FROM conversations WHERE role = 'user' AND length(text) > 40)
    SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.conv_id = c.conv_id)"""
)
def purge_sessions(spark, d):
    """K5: sessions without a message left lose their rows."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("session_id"), "role", "text")
    left = rows.where("role = 'user' and length(text) > 40").select("session_id").distinct()
    return incremental.purge(rows, rows.select("session_id").distinct().join(left, "session_id", "left_anti")).select("conv_id", "turn")


@register(
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS s, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 HOUR END AS e, ts - INTERVAL 1 DAY AS f FROM events)
    SELECT event_id, epoch_us(coalesce(s, f)) AS span_start, epoch_us(CASE WHEN s IS NULL THEN f ELSE coalesce(e, s) END) AS span_end FROM s"""
)
def chunk_spans(spark, d):
    """A missing end is the start, a missing start the file's time."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id")
    start, end = times.fill_span(F.when(k % 3 != 0, t), F.when(k % 4 != 0, t + F.expr("INTERVAL 1 HOUR")), t - F.expr("INTERVAL 1 DAY"))
    return table(spark, d, "events").select("event_id", F.unix_micros(start).alias("span_start"), F.unix_micros(end).alias("span_end"))


@register(f"SELECT doc_id, {_sql_redact('text')} AS plain, {_sql_redact('text')} AS nested FROM documents")
def redact_metadata(spark, d):
    """Strings redacted at any depth of JSON."""
    packed = F.to_json(F.struct(F.col("text").alias("plain"), F.array(F.struct(F.col("text").alias("x"))).alias("deep")))
    rows = table(spark, d, "documents").select("doc_id", text.redact_json(packed).alias("m"))
    return rows.select("doc_id", F.get_json_object("m", "$.plain").alias("plain"), F.get_json_object("m", "$.deep[0].x").alias("nested"))


# -- evaluation -------------------------------------------------------------

JUDGED = "judged AS (SELECT q.query_id, lpad(CAST(l.doc_id AS VARCHAR), 12, '0') AS id, (l.doc_id * 7 + q.query_id) % 4 AS grade FROM labels l, queries q)"


def _judged(spark, d) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id")
    asked = spark.createDataFrame([(q,) for q, *_ in BATCH], "query_id int")
    return rows.join(F.broadcast(asked)).select("query_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), ((F.col("doc_id") * 7 + F.col("query_id")) % 4).alias("grade"))


METRICS = """good AS (SELECT * FROM judged WHERE grade > 0), ideal AS (SELECT query_id, count(*) AS n_relevant, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM good) GROUP BY query_id),
  hit AS (SELECT d.query_id, d.rank, g.grade FROM dense d JOIN good g ON g.query_id = d.query_id AND g.id = d.id),
  own AS (SELECT query_id, count(*) FILTER (rank <= 5) AS hits, min(rank) FILTER (rank <= 10) AS f, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM hit GROUP BY query_id),
  m AS (SELECT i.query_id, n_relevant, coalesce(hits, 0) / n_relevant::DOUBLE AS recall, coalesce(1.0::DOUBLE / f, 0) AS reciprocal_rank, coalesce(dcg, 0) / ideal AS ndcg FROM ideal i LEFT JOIN own o ON o.query_id = i.query_id WHERE i.query_id IN (SELECT query_id FROM dense))"""


@register(f"{BASE}, {DENSE}, {JUDGED}, {METRICS} SELECT query_id, n_relevant, round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg FROM m")
def retrieval_metrics(spark, d):
    """Recall, reciprocal rank and nDCG."""
    m = evaluate.metrics(plan(spark, d).dense, _judged(spark, d))
    return m.select("query_id", "n_relevant", *(F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@register(
    f"""{BASE}, {DENSE}, {JUDGED}, {METRICS}, tagged AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'paraphrase' END AS class, CASE WHEN query_id < 3 THEN 'en' END AS lang FROM m)
    SELECT CASE WHEN grouping(class) = 0 THEN 'class' ELSE 'lang' END AS grouping, CASE WHEN grouping(class) = 0 THEN class ELSE coalesce(lang, 'none') END AS value, count(*) AS n, round(avg(recall), 9) AS recall, round(avg(ndcg), 9) AS ndcg
    FROM tagged GROUP BY GROUPING SETS ((class), (lang))"""
)
def metric_groups(spark, d):
    """Means over independent groupings."""
    m = evaluate.metrics(plan(spark, d).dense, _judged(spark, d))
    tagged = m.withColumn("class", F.when(F.col("query_id") % 2 == 0, "exact").otherwise("paraphrase")).withColumn("lang", F.when(F.col("query_id") < 3, "en"))
    g = evaluate.grouped(tagged, ("class", "lang"), ("recall", "ndcg"))
    return g.select("grouping", "value", "n", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


@register(
    """WITH p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 THEN 'cold' ELSE 'warm' END AS phase FROM events)
    SELECT event_type, phase, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM p GROUP BY ALL"""
)
def latency_percentiles(spark, d):
    """Nearest-rank percentiles, first measurement apart."""
    rows = evaluate.cold_and_warm(table(spark, d, "events"), "event_id", "event_type")
    return evaluate.percentiles(rows, "value", "event_type", "phase").withColumn("mean", F.round("mean", 6))


@register(f"WITH {CHUNKS} SELECT content, count(*) AS n, min(id) AS first FROM chunks GROUP BY content HAVING count(DISTINCT id) > 1")
def duplicate_groups(spark, d):
    """Contents stored several times."""
    c = chunks(spark, d).select("id", "content")
    return c.join(evaluate.duplicate_groups(c).where("id = first").select("id", "n", "first"), "id").select("content", "n", "first")


@register(
    f"""WITH {CHUNKS}, g AS (SELECT content, unnest(list(id)) AS id FROM chunks GROUP BY content HAVING count(*) > 1), r AS (SELECT doc_id % 50 AS query_id, id FROM chunks),
    per AS (SELECT query_id, content, count(*) AS h FROM r JOIN g USING (id) GROUP BY ALL), x AS (SELECT query_id, sum(greatest(h - 1, 0)) AS extra, count(*) AS hit FROM per GROUP BY query_id)
    SELECT s.query_id, s.n, coalesce(hit, 0) AS groups_hit, CAST(coalesce(extra, 0) AS BIGINT) AS redundant, round(coalesce(extra, 0) / s.n::DOUBLE, 9) AS rate FROM (SELECT query_id, count(*) AS n FROM r GROUP BY query_id) s LEFT JOIN x ON x.query_id = s.query_id"""
)
def duplicate_rate(spark, d):
    """Repeated groups in rankings."""
    c = chunks(spark, d)
    return evaluate.duplicate_rate(c.select((F.col("doc_id") % 50).alias("query_id"), "id"), evaluate.duplicate_groups(c)).withColumn("rate", F.round("rate", 9))


@register(
    f"""{BASE}, {DENSE}, rules AS (SELECT * FROM (VALUES (0, 'source_filter', 'en', NULL), (1, 'session_filter', 'src1', NULL), (2, 'time_filter', '2024-01-15', 'before'), (3, 'time_filter', '2024-01-15', 'after')) r(query_id, tag, value, op))
    SELECT 'dense-only' AS config, tag, count(*) FILTER (CASE tag WHEN 'source_filter' THEN source_type <> value WHEN 'session_filter' THEN session_id <> value ELSE timestamp_start IS NULL OR CASE op WHEN 'before' THEN timestamp_start >= try_cast(value AS TIMESTAMP) ELSE timestamp_start <= try_cast(value AS TIMESTAMP) END END) AS leaked, count(*) AS n
    FROM dense d JOIN rules USING (query_id) JOIN chunks c ON c.id = d.id GROUP BY tag"""
)
def filter_leakage(spark, d):
    """Results that break a rule."""
    rules = spark.createDataFrame([(0, "source_filter", "en", None), (1, "session_filter", "src1", None), (2, "time_filter", "2024-01-15", "before"), (3, "time_filter", "2024-01-15", "after")], "query_id int, tag string, value string, op string")
    return evaluate.leakage(plan(spark, d, text=False).dense.withColumn("config", F.lit("dense-only")), rules, chunks(spark, d))


@register(
    f"""{BASE}, own AS (SELECT q.query_id, c.id, c.session_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, c.id) AS place
      FROM chunks c, queries q WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL AND c.embedding_model = '{MODEL}' AND {WHERE}) SELECT query_id, id, session_id, place FROM own WHERE place <= 5"""
)
def guarded_search(spark, d):
    """A filtered search whose candidates and results pass the guards."""
    return plan(spark, d, text=False, filters=FILTER, stages=CONFIGS["dense-only"]).results.select("query_id", "id", "session_id", "place")


@register(
    f"""{ALL}, {RANKED}, {KEPT}, {JUDGED}, x AS (SELECT r.query_id, r.id IN (SELECT t.id FROM twins t WHERE t.query_id = r.query_id) AS gone, coalesce(j.grade > 0, false) AS good FROM ranked r LEFT JOIN judged j ON j.query_id = r.query_id AND j.id = r.id)
    SELECT query_id, count(*) FILTER (gone) AS dropped, count(*) AS n, round(count(*) FILTER (gone) / count(*)::DOUBLE, 9) AS rate, bool_or(gone AND good) AS dropped_relevant FROM x GROUP BY query_id"""
)
def dedup_drop_rate(spark, d):
    """How much deduplication drops, and whether any of it was relevant."""
    return evaluate.drop_rate(fusion.dedup(plan(spark, d).ranked), _judged(spark, d)).withColumn("rate", F.round("rate", 9))


@register(
    f"""{BASE}, {DENSE}, {LEXICAL}, {JUDGED}, r AS (SELECT 'dense-only' AS config, query_id, id, rank FROM dense UNION ALL SELECT 'lexical-only', query_id, id, rank FROM words),
    good AS (SELECT * FROM judged WHERE grade > 0), n AS (SELECT query_id, count(*) AS n_relevant FROM good GROUP BY query_id),
    m AS (SELECT config, query_id, count(*) FILTER (g.id IS NOT NULL AND rank <= 5) / any_value(n_relevant)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (g.id IS NOT NULL AND rank <= 10), 0) AS rr
      FROM r JOIN n USING (query_id) LEFT JOIN good g USING (query_id, id) GROUP BY config, query_id)
    SELECT config, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, count(*) AS n, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS reciprocal_rank FROM m GROUP BY ALL"""
)
def config_buckets(spark, d):
    """Means by configuration and the ledger's bucket."""
    p = plan(spark, d)
    ranked = p.dense.select(F.lit("dense-only").alias("config"), "query_id", "id", "rank").unionByName(p.words.select(F.lit("lexical-only").alias("config"), "query_id", "id", "rank"))
    ledger = spark.createDataFrame([(q, "odd" if q % 2 else "even") for q, *_ in BATCH], "query_id int, bucket string")
    m = evaluate.by_bucket(evaluate.metrics(ranked, _judged(spark, d), keys=("config", "query_id")), ledger, ("recall", "reciprocal_rank"))
    return m.select("config", "bucket", "n", *(F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank")))


STAGE_OF = "CASE event_id % 9 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' WHEN 2 THEN 'exact' WHEN 3 THEN 'fused' WHEN 4 THEN 'temporal' WHEN 5 THEN 'dedup' WHEN 6 THEN 'final' WHEN 7 THEN 'other' END"
SCORE_OF = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END"


@register(
    f"""WITH t AS (SELECT event_id, {STAGE_OF} AS stage, event_id % 5 AS rank, {SCORE_OF} AS score FROM events)
    SELECT event_id FROM t WHERE stage IS NULL OR stage = 'other' OR rank < 1 OR score IS NULL OR NOT isfinite(score)"""
)
def trace_contract(spark, d):
    """Events with an unknown stage, a rank under 1 or a score that is no number."""
    rows = table(spark, d, "events").select("event_id", F.expr(STAGE_OF).alias("stage"), (F.col("event_id") % 5).alias("rank"), F.expr(SCORE_OF).alias("score"))
    return evaluate.check_trace(rows).select("event_id")


@register(
    """SELECT doc_id % 50 AS query_id, doc_id AS rank, doc_id % 5 <> 0 AS is_traced FROM documents WHERE (doc_id % 5 = 0 AND text IS NOT NULL) OR (doc_id % 5 <> 0 AND doc_id % 7 = 0 AND text IS NOT NULL)"""
)
def trace_consistency(spark, d):
    """Places where the returned and the traced contents differ."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("place"), F.col("text").alias("content"))
    other = F.when(F.col("place") % 7 == 0, F.concat(F.lit("other "), "content")).otherwise(F.col("content"))
    traced = rows.where("place % 5 <> 0").select("query_id", F.col("place").alias("rank"), other.alias("content"))
    return evaluate.consistent(rows, traced).select("query_id", "rank", F.col("traced").isNotNull().alias("is_traced"))


@register(
    """SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 2 = 0 AND turn % 3 <> 0 THEN concat_ws(' ', role || ' said', text) ELSE text END, '\\s+', ' ', 'g')) AS query FROM conversations"""
)
def canonical_queries(spark, d):
    """The conversation before a query, white space squeezed."""
    none = F.expr("cast(array() as array<string>)")
    context = F.when(F.col("turn") % 3 != 0, F.array("role", F.lit("said"))).otherwise(none)
    kind = F.when(F.col("turn") % 2 == 0, "multi_turn").otherwise("single")
    return table(spark, d, "conversations").select("conv_id", "turn", evaluate.canonical_query(kind, context, F.col("text")).alias("query"))


@register("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 > 0 THEN 'false_return' ELSE 'correct_empty' END WHEN doc_id % 3 = 0 THEN 'missed' ELSE 'answered' END AS label FROM documents")
def evidence_labels(spark, d):
    """Whether anything should and did come back."""
    return table(spark, d, "documents").select("doc_id", evaluate.no_evidence(F.col("doc_id") % 3, F.col("doc_id") % 2 == 0).alias("label"))


@register("SELECT 'tune and holdout' AS pair, true AS isolated UNION ALL SELECT 'documents and labels', NOT EXISTS (SELECT 1 FROM documents JOIN labels USING (doc_id))")
def split_isolation(spark, d):
    """Whether two sets share a key."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("bucket"))
    own = evaluate.split(docs, {"en": 20, "de": 5})
    other = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    pairs = (("tune and holdout", own.where("split = 'tune'"), own.where("split = 'holdout'")), ("documents and labels", docs, other))
    return reduce(DataFrame.unionByName, (evaluate.apart(a, b).select(F.lit(name).alias("pair"), "isolated") for name, a, b in pairs))


@register(
    """WITH q AS (SELECT doc_id AS query_id, lang AS bucket FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY query_id) AS r, count(*) OVER (PARTITION BY bucket) AS c FROM q)
    SELECT query_id, bucket, CASE WHEN r <= c - CASE bucket WHEN 'en' THEN 20 WHEN 'de' THEN 5 ELSE 0 END THEN 'tune' ELSE 'holdout' END AS split FROM n"""
)
def split_assign(spark, d):
    """Mechanical split by bucket."""
    return evaluate.split(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("bucket")), {"en": 20, "de": 5})


@register("SELECT 'lang' AS \"column\", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def bucket_counts(spark, d):
    """Rows by value of several columns."""
    return evaluate.counts_by(table(spark, d, "documents"), "lang", "source")


@register(
    f"""{BASE}, {DENSE}, {LEXICAL}, a AS (SELECT query_id, id, rank FROM dense), b AS (SELECT query_id, id, rank FROM words)
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS old_rank, b.rank AS new_rank, a.rank IS DISTINCT FROM b.rank AS rank_changed,
      coalesce(b.rank = 1 AND coalesce(a.rank, 0) <> 1, false) AS winner_transition, coalesce(b.rank < a.rank, false) AS promoted FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id"""
)
def rank_transitions(spark, d):
    """One configuration against another."""
    p = plan(spark, d)
    return evaluate.transitions(p.dense, p.words)


@register(
    f"""{BASE}, {DENSE}, {JUDGED}, x AS (SELECT j.query_id, max_by(j.id, (c.timestamp_start, j.id)) AS id FROM judged j JOIN chunks c ON c.id = j.id WHERE j.grade > 0 AND c.timestamp_start IS NOT NULL GROUP BY j.query_id)
    SELECT x.query_id, x.id, d.rank FROM x LEFT JOIN dense d ON d.query_id = x.query_id AND d.id = x.id"""
)
def newest_relevant(spark, d):
    """Where the newest relevant row stands."""
    stamps = chunks(spark, d).where("timestamp_start is not null").select("id", "timestamp_start")
    return evaluate.newest_relevant(plan(spark, d, text=False).dense, _judged(spark, d), stamps)


@register("SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_differences(spark, d):
    """Keys on one side only."""
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id")
    return evaluate.id_differences(table(spark, d, "documents").select(key), table(spark, d, "labels").select(key))


# -- functions --------------------------------------------------------------


@register(
    """SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview, substr(sha256(text), 1, 16) AS short_hash,
      len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) AS cjk, sha256('m|1') || ':document:' || sha256(text) AS replay_key, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n_words FROM documents"""
)
def text_functions(spark, d):
    """Scalar functions."""
    return table(spark, d, "documents").select(
        "doc_id",
        text.squeeze("text").alias("squeezed"),
        text.preview("text").alias("preview"),
        text.short_hash("text").alias("short_hash"),
        text.cjk_chars("text").cast("long").alias("cjk"),
        vector.replay_key(F.lit("m"), F.lit("1"), F.lit("document"), "text").alias("replay_key"),
        F.size(text.words("text")).cast("long").alias("n_words"),
    )


@register(
    """SELECT vec_id, len(embedding) AS dim, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, len(embedding) = 64 AS valid,
      abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.001 AS is_unit FROM embeddings"""
)
def vector_checks(spark, d):
    """Dimension, norm and validity."""
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(vector.norm("embedding"), 6).alias("norm"), vector.valid("embedding", DIM).alias("valid"), vector.unit_length("embedding").alias("is_unit"))


@register(
    """WITH t AS (SELECT item_id, list_transform(range(0, 8), lambda i: CAST(CAST('0x' || substr(sha256('tidemark-test:' || i || ':' || text), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 * 2 - 1) AS v FROM benchmark)
    SELECT item_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 9)) AS e FROM t"""
)
def hashed_vectors(spark, d):
    """Deterministic vectors of texts."""
    return table(spark, d, "benchmark").select("item_id", F.transform(vector.hashed("text", 8), lambda x: F.round(x, 9)).alias("e"))


@register(
    """WITH s AS (SELECT sha256(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1) SELECT b.item_id, s.item_id AS stored FROM benchmark b JOIN s ON s.h = sha256(b.text)"""
)
def replay_lookup(spark, d):
    """Text to stored vector by composite key."""
    b = table(spark, d, "benchmark").select("item_id", vector.replay_key(F.lit("m"), F.lit("1"), F.lit("query"), "text").alias("key"))
    stored = b.groupBy("key").agg(F.min("item_id").alias("stored"))
    return b.join(stored, "key").select("item_id", "stored")


@register(
    """SELECT event_id, epoch_us(date_trunc('second', ts)) AS iso, epoch_us(ts) // 1000 * 1000 AS millis, (epoch_us(ts) // 1000000) * 1000000 AS seconds, NULL::BIGINT AS bad FROM events"""
)
def timestamp_forms(spark, d):
    """ISO text, milliseconds and seconds as one time."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    ms = F.unix_millis("t").cast("string")
    return e.select(
        "event_id",
        F.unix_micros(times.from_text(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"),
        F.unix_micros(times.from_text(ms)).alias("millis"),
        F.unix_micros(times.from_text(F.unix_seconds("t").cast("string"))).alias("seconds"),
        F.unix_micros(times.from_text(F.lit("soon"))).alias("bad"),
    )


HEADS = ("the LATEST plan", "not the latest", "mylatest", "last 7 days", "last 0 days", "last 366 days", "最新ではない話", "  直近の会議", "过去 3 天", "過去４日", "plain", "not latest, latest", "LAST 12 DAY")
_HEADS = ", ".join(f"'{h}'" for h in HEADS)


@register(
    f"""WITH q AS (SELECT doc_id, lower(translate(([{_HEADS}])[CAST(doc_id % {len(HEADS)} AS INTEGER) + 1], '０１２３４５６７８９', '0123456789') || ' ' || regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]', ' ', 'g')) AS f FROM documents),
    p AS (SELECT doc_id, f, ltrim(f) AS s FROM q),
    n AS (SELECT *, TRY_CAST(regexp_extract(f, '(?:^|\\W)last\\s+([0-9]{{1,3}})\\s+days?(?:\\W|$)', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(s, '^过去\\s*([0-9]{{1,3}})\\s*天', 1) AS INTEGER) AS b, TRY_CAST(regexp_extract(s, '^過去\\s*([0-9]{{1,3}})\\s*日', 1) AS INTEGER) AS c FROM p)
    SELECT doc_id, CASE WHEN regexp_matches(f, '(^|\\W)not\\s+(the\\s+)?latest(\\W|$)') THEN false WHEN regexp_matches(f, '(^|\\W)latest(\\W|$)') THEN true
      WHEN starts_with(s, '最新') OR starts_with(s, '直近') THEN NOT (starts_with(s, '最新ではない') OR starts_with(s, '直近ではない'))
      ELSE coalesce(a BETWEEN 1 AND 365, false) OR coalesce(b BETWEEN 1 AND 365, false) OR coalesce(c BETWEEN 1 AND 365, false) END AS recent FROM n"""
)
def recency_intent(spark, d):
    """The grammar on a column of queries, made of documents."""
    heads = F.array(*map(F.lit, HEADS))
    tail = F.regexp_replace(F.lower(F.substring("text", 1, 60)), "[^a-z0-9]", " ")
    q = F.concat(F.element_at(heads, (F.col("doc_id") % len(HEADS) + 1).cast("int")), F.lit(" "), tail)
    return table(spark, d, "documents").select("doc_id", intent.recent(q).alias("recent"))


# -- files, scopes, order -----------------------------------------------------

@register(
    f"""WITH {CHUNKS} SELECT substr(sha256(session_id), 1, 16) AS session, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_start NULLS LAST, content, id) AS place, timestamp_start, {_sql_redact('content')} AS content
    FROM chunks WHERE session_id <> 'src0'"""
)
def scope_export_order(spark, d):
    """The order of an export, as a row's place among those of its session."""
    c = chunks(spark, d).withColumn("metadata", F.lit(None).cast("string"))
    rows = lifecycle.export_rows(c, c.where("session_id <> 'src0'")).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("session").orderBy("at")).cast("long")
    return rows.withColumn("place", place).select("session", "place", "timestamp_start", "content")


@register(
    """WITH b AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'store' WHEN 1 THEN 'chat' ELSE 'sessions' END AS scope,
      CASE doc_id % 6 WHEN 0 THEN 'store://t' || doc_id WHEN 1 THEN 'file:/data/chat/c' || doc_id || '.jsonl' WHEN 2 THEN 'file:/data/s/u' || doc_id || '.jsonl' WHEN 3 THEN 'file:/data/s/u' || doc_id || '.jsonl.deleted.1'
        WHEN 4 THEN 'file:/data/s/../u' || doc_id || '.jsonl' ELSE 'file:/database/u' || doc_id || '.jsonl' END AS file_path,
      CASE doc_id % 6 WHEN 0 THEN 't' || doc_id WHEN 1 THEN 'chat-c' || doc_id WHEN 3 THEN 'u' || doc_id || ':deleted' ELSE 'u' || doc_id END AS session_id FROM documents)
    SELECT asked, scope, file_path, session_id FROM b, (VALUES ('sessions'), ('store'), ('chat'), ('all')) v(asked) WHERE (asked = 'all' OR asked = scope) AND doc_id % 6 < 4"""
)
def scope_resolve(spark, d):
    """Bindings of each scope and of all, without paths outside the roots."""
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("store://t"), n)).when(k == 1, F.concat(F.lit("file:/data/chat/c"), n, F.lit(".jsonl"))).when(k == 2, F.concat(F.lit("file:/data/s/u"), n, F.lit(".jsonl")))
        .when(k == 3, F.concat(F.lit("file:/data/s/u"), n, F.lit(".jsonl.deleted.1"))).when(k == 4, F.concat(F.lit("file:/data/s/../u"), n, F.lit(".jsonl"))).otherwise(F.concat(F.lit("file:/database/u"), n, F.lit(".jsonl")))
    )
    bound = lifecycle.bindings(table(spark, d, "documents").select(path.alias("file_path"), F.lit(None).cast("timestamp").alias("processed_at")))
    return reduce(DataFrame.unionByName, (lifecycle.resolve(bound, scope, ("file:/data",)).select(F.lit(scope).alias("asked"), "scope", "file_path", "session_id") for scope in lifecycle.SCOPES))


@register(
    """SELECT source, lang AS value, place, ndcg FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ndcg NULLS LAST, lang) AS place
      FROM (SELECT source, lang, round(avg(CASE WHEN lang <> 'de' THEN n_chars % 97 END), 9) AS ndcg FROM documents GROUP BY source, lang))"""
)
def worst_classes(spark, d):
    """Groups by a mean, the worst first."""
    own = F.when(F.col("lang") != "de", F.col("n_chars") % 97)
    g = table(spark, d, "documents").groupBy("source", F.col("lang").alias("value")).agg(F.round(F.avg(own), 9).alias("ndcg"))
    return evaluate.worst_first(g, "ndcg", "source").select("source", "value", "place", "ndcg")


@register(
    """SELECT conv_id || ':' || turn AS key, role, CASE WHEN turn % 3 = 1 THEN 'a' || chr(10) || text WHEN turn % 3 = 2 THEN '' ELSE text END AS text, CASE WHEN turn % 2 = 0 THEN conv_id || ':' || turn END AS stamp
    FROM conversations WHERE text IS NOT NULL AND turn % 5 <> 4"""
)
def session_lines(spark, d):
    """Session files written and read again: lists of parts, invalid and blank lines, missing times."""
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    key = F.concat_ws(":", "conv_id", "turn")
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    content = F.when(F.col("turn") % 3 == 1, F.to_json(F.array(part("text", F.lit("a")), part("image", F.lit("no")), part("text", F.col("text")))))
    content = content.when(F.col("turn") % 3 == 2, F.lit("[]")).otherwise(F.substring(F.to_json(F.array("text")), 2, 1_000_000_000))
    content = F.when(F.col("turn") % 3 == 0, F.regexp_replace(content, r"\]$", "")).otherwise(content)
    stamp = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(', "timestamp": "'), key, F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(F.lit('  {"type": "message", "message": {"role": "'), "role", F.lit('", "id": "'), key, F.lit('", "content": '), content, F.lit("}"), stamp, F.lit("} "))
    line = F.when(F.col("turn") % 5 == 4, F.element_at(F.array(*map(F.lit, ("", "{broken", '{"type": "note"}', "[1, 2]"))), (F.col("conv_id") % 4 + 1).cast("int"))).otherwise(line)
    at = scratch(spark, "lines")
    c.select(line.alias("value"), key.alias("k")).repartition(8, "k").select("value").write.text(at)
    rows = sessions.lines(spark, at)
    keys = F.get_json_object("value", "$.message.id").alias("key")
    named = rows.where("value LIKE '{\"type\": \"message\"%'").select("path", F.col("line_no").alias("turn_index"), keys)
    return sessions.messages(rows).join(named, ["path", "turn_index"]).select("key", "role", "text", F.col("timestamp").alias("stamp"))


@register("SELECT 'd' || doc_id AS id, lang, text AS content, source AS session, n_chars % 7 AS day, [lang, source] AS tags FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def eval_corpus(spark, d):
    """An evaluation corpus written as JSON lines and read by its reader."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    at = scratch(spark, "corpus")
    stamp = F.concat(F.lit("2024-01-0"), (F.col("n_chars") % 7 + 1).cast("string"), F.lit("T00:00:00Z"))
    docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "lang", F.col("text").alias("content"), F.col("source").alias("session"), stamp.alias("timestamp"), F.lit("chat").alias("source_kind"), F.array("lang", "source").alias("tags"), F.lit(1).alias("other")).write.json(at)
    found = evaluation.corpus(spark, at)
    return found.select("id", "lang", "content", "session", (F.dayofmonth("timestamp") - 1).cast("long").alias("day"), "tags")


@register("SELECT count(*) AS found, count_if(k = 0) AS unchanged, count_if(k = 1) AS empty, count_if(k = 2) AS cron, count_if(k = 3) AS done, count_if(k = 4) AS partial, count_if(k = 5) AS error, sum(CASE WHEN k = 3 THEN n_chars ELSE 0 END)::BIGINT AS chunks FROM (SELECT doc_id % 6 AS k, n_chars FROM documents)")
def ingest_counters(spark, d):
    """The counters of a run."""
    names = F.array(*map(F.lit, ("unchanged", "empty", "cron", "done", "partial", "error")))
    k = (F.col("doc_id") % 6 + 1).cast("int")
    return incremental.run_counters(table(spark, d, "documents").select(F.element_at(names, k).alias("status"), F.when(k == 4, F.col("n_chars")).otherwise(0).alias("chunks")))


@register(
    """WITH l AS (SELECT doc_id // 5 AS path, CASE WHEN doc_id // 5 % 3 = 0 AND doc_id % 5 = 2 THEN 1 ELSE 0 END AS fine FROM documents WHERE doc_id % 5 <> 4)
    SELECT path, count(*) AS n FROM l GROUP BY path HAVING sum(fine) = 0"""
)
def unreadable_files(spark, d):
    """Files with text but no record, which the error budget counts."""
    place, path = F.col("doc_id") % 5, F.floor(F.col("doc_id") / 5)
    value = F.when(place == 4, "").when((path % 3 == 0) & (place == 2), F.concat(F.lit('{"a": '), "doc_id", F.lit("}"))).otherwise(F.concat(F.lit("{bad "), "doc_id"))
    return incremental.unreadable(table(spark, d, "documents").select(path.alias("path"), value.alias("value")))
