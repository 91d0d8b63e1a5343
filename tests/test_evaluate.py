import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, evaluate, report


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", f"d{k}", k) for k in range(1, 13)] + [("r", "x", 1)], "query_id string, id string, rank int")
    judged = spark.createDataFrame([("q", "d2", 3), ("q", "d7", 1), ("q", "gone", 2), ("q", "d1", 0), ("r", "y", 1), ("none", "z", 1)], "query_id string, id string, grade int")
    got = {r.query_id: r for r in evaluate.metrics(ranked, judged).collect()}
    assert set(got) == {"q", "r"} and got["q"].recall == pytest.approx(1 / 3) and got["q"].reciprocal_rank == 0.5
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert got["q"].ndcg == pytest.approx((7 / math.log2(3) + 1 / 3) / ideal)
    assert (got["r"].recall, got["r"].reciprocal_rank, got["r"].ndcg) == (0, 0, 0)


def test_ideal_takes_all_relevant_rows(spark):
    ranked = spark.createDataFrame([("q", f"d{k}", k) for k in range(1, 11)], "query_id string, id string, rank int")
    judged = spark.createDataFrame([("q", f"d{k}", 1) for k in range(1, 21)], "query_id string, id string, grade int")
    assert evaluate.metrics(ranked, judged).first().ndcg < 1


def test_labels_and_rates(spark):
    rows = spark.createDataFrame([(0, True), (2, True), (0, False), (1, False)], "n int, none boolean")
    assert [r.x for r in rows.select(evaluate.no_evidence(F.col("n"), F.col("none")).alias("x")).collect()] == ["correct_empty", "false_return", "missed", "answered"]
    judged = spark.createDataFrame([("q", "a", True), ("q", "b", False), ("p", "c", True)], "query_id string, id string, kept boolean")
    rel = spark.createDataFrame([("q", "b", 2)], "query_id string, id string, grade int")
    got = {r.query_id: (r.dropped, r.rate, r.dropped_relevant) for r in evaluate.drop_rate(judged, rel).collect()}
    assert got == {"q": (1, 0.5, True), "p": (0, 0.0, False)}


def test_trace_contract(spark):
    rows = [("dense", 1, 0.5), ("moon", 1, 0.5), ("final", 0, 0.5), ("final", 1, float("nan")), ("final", 1, None), (None, 1, 0.5)]
    assert evaluate.check_trace(spark.createDataFrame(rows, "stage string, rank int, score double")).count() == 5
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, place int, content string")
    b = spark.createDataFrame([("q", 1, "x"), ("q", 2, "z"), ("q", 3, "w")], "query_id string, rank int, content string")
    assert evaluate.consistent(a, b).count() == 2


def test_split_isolation_and_canonical_query(spark):
    rows = evaluate.split(spark.createDataFrame([(f"q{k:02d}", "b") for k in range(10)], "query_id string, bucket string"), {"b": 4})
    tune, test = rows.where("split = 'tune'"), rows.where("split = 'holdout'")
    assert (tune.count(), test.count()) == (6, 4) and evaluate.isolated(tune, test) and not evaluate.isolated(tune, rows)
    df = spark.createDataFrame([("multi_turn", ["one  two"], "three"), ("exact", ["no"], " a \n b ")], "k string, c array<string>, t string")
    assert [r.x for r in df.select(evaluate.canonical_query(F.col("k"), F.col("c"), F.col("t")).alias("x")).collect()] == ["one two three", "a b"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("a", "s1", datetime(2024, 1, 1), "note"), ("b", "s2", datetime(2024, 1, 2), "faq"), ("c", "s1", datetime(2024, 1, 3), "note")]
    return spark.createDataFrame(rows, "id string, session string, timestamp timestamp, source_kind string")


def problems(spark, corpus, tag, evidence, relevant=("a", "b"), lang="en", text="plain"):
    ledger = spark.createDataFrame([("q", [tag], {tag: json.dumps(evidence)} if evidence is not None else {})], "query_id string, tags array<string>, evidence map<string, string>")
    asked = spark.createDataFrame([("q", lang, text, {d: 1 for d in relevant} | {"z": 0})], "query_id string, lang string, query_text string, relevance map<string, int>")
    return {r.problem for r in coverage.problems(ledger, asked, corpus).collect()}


WHY = {"why": "because"}


@pytest.mark.parametrize(
    ("tag", "evidence", "want"),
    [
        ("cross_session", WHY | {"docs": ["b", "a"]}, set()),
        ("cross_session", WHY | {"docs": ["a"]}, {"documents are not the relevant ones", "one session only"}),
        ("cross_session", {"docs": ["a", "b", "nope"]}, {"no reason", "unknown document", "documents are not the relevant ones"}),
        ("knowledge_update", WHY | {"docs": ["a", "b"]}, set()),
        ("knowledge_update", WHY | {"docs": ["c"]}, {"documents are not relevant", "one time only"}),
        ("hard_negative", {"reason": "r", "relevant_docs": ["a", "b"], "non_relevant_docs": ["c"]}, set()),
        ("hard_negative", WHY | {"relevant_docs": ["a"], "non_relevant_docs": ["b"]}, {"a negative is relevant", "relevant documents differ"}),
        ("same_name", WHY | {"docs": ["a"], "entity": "Ann"}, set()),
        ("same_name", WHY | {"docs": []}, {"no documents", "no entity"} | set()),
        ("time_filter", WHY | {"operator": "before", "iso_bound": "2024-01-03T00:00:00Z", "eligible_docs": ["a", "b"]}, set()),
        ("time_filter", WHY | {"operator": "after", "iso_bound": "2024-01-01T00:00:00Z", "eligible_docs": ["b"]}, {"eligible documents differ"}),
        ("time_filter", WHY | {"operator": "near", "iso_bound": "2024-01-01", "eligible_docs": ["b"]}, {"bad time rule", "eligible documents differ"}),
        ("source_filter", WHY | {"kind": "faq"}, set()),
        ("source_filter", WHY | {"kind": "moon"}, {"unknown kind"}),
        ("session_filter", WHY | {"session": "s9"}, {"unknown session"}),
        ("duplicate_groups", WHY | {"groups": [["a", "b"]]}, set()),
        ("duplicate_groups", WHY | {"groups": [["a"], ["a", "b"]]}, {"a group of one", "groups overlap"}),
        ("duplicate_groups", WHY, {"no groups"}),
        ("long_chinese", WHY, {"not long Chinese"}),
    ],
)
def test_coverage(spark, corpus, tag, evidence, want):
    assert problems(spark, corpus, tag, evidence) == want


def test_coverage_of_text_and_counts(spark, corpus):
    assert problems(spark, corpus, "long_chinese", WHY, lang="zh", text="请问这艘船什么时候开") == set()
    assert "no evidence" in problems(spark, corpus, "long_chinese", None, lang="zh", text="请问这艘船什么时候开")
    ledger = spark.createDataFrame([("1", "b", ["x"]), ("2", "b", ["x", "y"])], "query_id string, bucket string, tags array<string>")
    assert [(r.tag, r.n) for r in coverage.short_tags(ledger, {"x": 2, "y": 2, "z": 1}).orderBy("tag").collect()] == [("y", 1), ("z", 0)]
    assert [(r.bucket, r.expected, r.n) for r in coverage.wrong_counts(ledger, "bucket", {"b": 3, "c": 0}).collect()] == [("b", 3, 2)]


def test_reports(spark, corpus, tmp_path):
    part = spark.createDataFrame([("rrf", 0.5, 1), ("dense", None, 2)], "config string, ndcg double, n int")
    found = report.results(part, part, part)
    text = report.markdown("Run", found)
    assert text.startswith("# Run") and "| rrf | 0.500 | 1 |" in text
    report.write_json(str(tmp_path / "r.json"), found)
    assert json.load(open(tmp_path / "r.json"))["configs"][0]["config"] == "rrf"
    m = report.manifest(spark, {"results": str(tmp_path / "r.json")}, model="m")
    assert len(m["inputs"]["results"][0]["sha256"]) == 64 and m["model"] == "m"
    docs = corpus.withColumn("content", F.col("id"))
    vectors = spark.createDataFrame([(k, [1.0]) for k in "abc"], "id string, embedding array<float>")
    rows = report.corpus_chunks(docs, vectors, "m", "eval").orderBy("id").collect()
    assert [(r.session_id, r.source_type, r.turn_index_end) for r in rows][0] == ("eval-s1", "note", 0)
    with pytest.raises(Exception, match="no vector for c"):
        report.corpus_chunks(docs, vectors.where("id <> 'c'"), "m", "eval").collect()
