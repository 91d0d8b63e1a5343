from datetime import UTC, datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.operators.filters import SearchFilters
from tidemark.plans.search import CONFIGS, Search, Stages, run_search, search, search_page

NOW = datetime(2024, 6, 1, tzinfo=UTC)
Q, FAR = [1.0, 0.0, 0.0], [0.5, 0.8660254, 0.0]
SCHEMA = "id string, session_id string, source_type string, content string, embedding array<float>, embedding_model string, timestamp_start timestamp, created_at timestamp"


def row(i, content, e=FAR, session="s1", source="main_user", days=0.0, model="m", created=None):
    ts = None if days is None else NOW - timedelta(days=days)
    return (f"{i:04d}", session, source, content, e, model, ts, created)


@pytest.fixture(scope="module")
def ask(spark):
    def run(rows, text, limit=5, offset=0, **options):
        df = spark.createDataFrame(rows, SCHEMA)
        return search(df, text, lambda t: Q, limit, offset, model="m", now=NOW, dim=3, **options)

    return run


def ids(rows):
    return [r.id for r in rows]


def test_channels_add_up(ask):
    rows = [row(1, "red kite over the moor", Q), row(2, "blue whale"), row(3, "nothing here")]
    got, summary = ask(rows, "kite", explain=True)
    assert ids(got)[0] == "0001" and got[0].score == pytest.approx(3 / 61)
    assert got[0].explain.matched_channel_count == 3 and got[0].explain.multi_channel and got[0].explain.score_kind == "rrf"
    assert got[1].score == pytest.approx(1 / 62) and not got[1].explain.channels.lexical.matched
    assert summary["lexical_method"] == "ts_rank_cd" and summary["dense_fetched"] == 3 and summary["returned_count"] == 3 and summary["pool_limit"] == 30


def test_all_terms_are_needed_and_near_ones_rank_first(ask):
    rows = [row(1, "alpha x x x beta", None), row(2, "beta alpha", None), row(3, "alpha only", None)]
    got = ask(rows, "alpha beta", stages=Stages(dense=False, exact=False))
    assert ids(got) == ["0002", "0001"]


def test_trigram_only_without_words(ask):
    rows = [row(1, "harbour"), row(2, "harbor")]
    got, summary = ask(rows, "harbouring", stages=Stages(dense=False, exact=False), explain=True)
    assert ids(got)[0] == "0001" and summary["lexical_method"] == "trigram_fallback"
    assert ids(ask(rows, "harbor", stages=Stages(dense=False, exact=False))) == ["0002"]


def test_exact_is_short_literal_and_newest_first(ask):
    only = Stages(dense=False, lexical=False, temporal=False)
    rows = [row(1, "王小明 said hi", None, days=3), row(2, "about 王小明", None, days=1), row(3, "王小明?", None, days=None), row(4, "50% off", None), row(5, "500 off", None)]
    got, _ = ask(rows, "小明", stages=only, explain=True)
    assert ids(got) == ["0001", "0002", "0003"] and {r.score for r in got} == {1 / 61}
    assert {r.id: r.explain.channels.exact.candidate_rank for r in got} == {"0002": 1, "0001": 2, "0003": 3}
    assert ids(ask(rows, "0% o", stages=only)) == ["0004"]
    assert ask(rows, "a query of more than twenty", stages=only) == []


def test_decay_by_intent_or_time_filter(ask):
    dense = Stages(lexical=False, exact=False)
    rows = [row(1, "old", Q, days=120), row(2, "new", FAR, days=0.0)]
    assert ids(ask(rows, "anything", stages=dense)) == ["0001", "0002"]
    got = ask(rows, "the latest", stages=dense)
    assert ids(got) == ["0002", "0001"] and got[1].score == pytest.approx(2**-4 / 61)
    timed = SearchFilters.of(time_from="2020-01-01T00:00:00Z")
    assert ids(ask(rows, "anything", stages=dense, filters=timed)) == ["0002", "0001"]
    unknown = [row(1, "a", Q, days=None, created=NOW - timedelta(days=60)), row(2, "b", FAR, days=None)]
    got = ask(unknown, "latest", stages=dense)
    assert [r.score for r in got] == pytest.approx([0.25 / 61, 0.25 / 62])


def test_filters_before_limits(ask):
    rows = [row(k, f"text {k}", Q, session="other") for k in range(40)] + [row(99, "text 99", FAR, session="mine", days=5), row(98, "text 98", FAR, session="mine", days=None)]
    assert set(ids(ask(rows, "zzz", filters=SearchFilters.of(session_ids=["mine"])))) == {"0098", "0099"}
    late = SearchFilters.of(session_ids=["mine"], time_to="2024-06-01T00:00:00Z")
    assert ids(ask(rows, "zzz", filters=late)) == ["0099"]
    assert ask(rows, "text", filters=SearchFilters.of(source_types=["cron"])) == []


def test_model_and_dimension(ask):
    rows = [row(1, "kite a", Q), row(2, "kite b", Q, model="other"), row(3, "kite c", [1.0, 0.0]), row(4, "kite d", None)]
    got, summary = ask(rows, "kite", explain=True)
    assert ids(got) == ["0001", "0004"] and summary["dense_fetched"] == 1


def test_dedup_keeps_provenance(ask):
    rows = [row(1, "same", Q), row(2, "same", Q), row(3, "same", Q, session="s2"), row(4, "same", Q, source="cron"), row(5, "same", [0.0, 1.0, 0.0]), row(6, "same", None), row(7, "same", None)]
    got = ask(rows, "same", limit=20)
    assert sorted(ids(got)) == ["0001", "0003", "0004", "0005", "0006", "0007"]
    assert len(ask(rows, "same", limit=20, stages=CONFIGS["+temporal"])) == 7
    assert sorted(ids(ask(rows, "same", 3) + ask(rows, "same", 3, 3))) == sorted(ids(got))


def test_pages(spark):
    df = spark.createDataFrame([row(k, f"item number {k}", None) for k in range(7)], SCHEMA)
    page = lambda limit, offset: search_page(df, "item number", None, limit, offset, model="m", now=NOW, dim=3, stages=Stages(dense=False))
    a, b, c = page(3, 0), page(3, 3), page(3, 6)
    assert (a.has_more, a.next_offset, b.has_more, b.next_offset, c.has_more, c.next_offset) == (True, 3, True, 6, False, None)
    assert [r.id for p in (a, b, c) for r in p.results] == [f"{k:04d}" for k in range(7)]
    for bad in (0, 21, True):
        with pytest.raises(QueryError) as e:
            page(bad, 0)
        assert e.value.code == "limit_out_of_bounds"


def test_remote_form(spark):
    df = spark.createDataFrame([row(k, f"item {k}", Q) for k in range(3)], SCHEMA)
    call = lambda **a: run_search(df, lambda t: Q, **({"query": "item", "model": "m", "now": NOW, "dim": 3} | a))
    got = call(limit=50, source_types=["main_user"], explain=True)
    assert got["limit"] == 20 and len(got["results"]) == 3 and got["filters_applied"]["source_types"] == ["main_user"]
    assert got["results"][0]["provenance"]["timestamp"].startswith("2024-06-01") and "explain_summary" in got
    assert call(query=" ") == {"error": {"code": "invalid_query"}}
    assert call(source_types="x") == {"error": {"code": "invalid_filter_type"}}
    assert run_search(df, lambda t: [1.0], query="item", model="m", dim=3) == {"error": {"code": "embedding_dimension_mismatch"}}
    assert run_search(df, lambda t: 1 / 0, query="item", model="m", dim=3) == {"error": {"code": "search_unavailable", "type": "ZeroDivisionError"}}


def test_stages():
    for bad in ({"dense": 1}, {"dense": False, "lexical": False, "exact": False}):
        with pytest.raises(QueryError):
            Stages(**bad)
    assert list(CONFIGS) == ["dense-only", "lexical-only", "rrf", "+exact", "+temporal", "+dedup"]


def test_empty_corpus(spark):
    df = spark.createDataFrame([], SCHEMA)
    rows, summary = search(df, "anything", lambda t: Q, model="m", now=NOW, dim=3, explain=True)
    assert rows == [] and summary["pool_limit"] == 30 and summary["returned_count"] == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_filters_by_query_equal_single_searches(spark, indexed):
    """A batch with a filter for each query finds what each query finds alone, and decays alike."""
    from tidemark.operators import index
    from tidemark.operators.filters import QueryFilters
    from tidemark.plans import corpus, registry

    sf = "/root/testdata/sf0.001"
    own = corpus.index(spark, sf) if indexed else None
    chunks, asked = corpus.chunks(spark, sf), corpus.queries(spark, sf)
    each = {q: f for q, f in registry.EACH.items() if q != 1}  # the second query has none

    def found(queries, filters):
        s = Search(chunks, queries, corpus.MODEL, corpus.NOW, corpus.DIM, filters=filters, index=own)
        rows = s.results.select("query_id", "place", "id", F.round("score", 9).alias("score"), "decayed").collect()
        s.release()
        return sorted(map(tuple, rows))

    together = found(asked, QueryFilters(each, asked))
    alone = [found(asked.where(F.col("query_id") == q), each.get(q, SearchFilters())) for q in range(5)]
    assert together == [r for rows in alone for r in rows] and {r[0] for r in together} >= {0, 1, 2}
    with pytest.raises(QueryError):
        QueryFilters({99: SearchFilters()}, asked)
    union = QueryFilters({q: SearchFilters.of(source_types=[t]) for q, t in enumerate(("en", "fr", "de", "es", "en"))}, asked)
    plan = chunks.where(union.predicate())._jdf.queryExecution().executedPlan().toString()
    assert "In(lang, [de,en,es,fr])" in plan.replace(", ", ",").replace("In(lang,", "In(lang, ")
