"""What bounds memory and shuffles as tables grow; each with the results of the plain way."""

import random
import re
from collections import defaultdict
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import channels, index
from tidemark.plans import corpus, registry, search
from tidemark.plans.search import Search

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 2, 1, tzinfo=UTC)
WORDS = ["ferry", "Lantern", "naïve", "ÉLAN", "x1", "the", "of", "漢字", "𝒳𝒴", "don't"]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(4)
    rows = [(f"c{i % 70:03}", None if i % 9 == 0 else f"s{i % 3}", None if i == 5 else "" if i == 6 else " ".join(rnd.choices(WORDS, k=rnd.randint(1, 25)))) for i in range(80)]  # ten ids occur twice
    return spark.createDataFrame(rows, "id string, session_id string, content string")


def places(chunks):
    out = defaultdict(list)
    for r in chunks.collect():
        for k, w in enumerate(re.findall(r"[^\W_]+", (r.content or "").lower()), 1):
            out[w, r.session_id, r.id].append(k)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("run,block", [(1_000_000, 4096), (40, 4096), (40, 3), (1, 1)])
def test_postings_need_no_shuffle(spark, chunks, monkeypatch, run, block):
    monkeypatch.setattr(index, "RUN", run)
    rows = index.postings(chunks.coalesce(1), block)
    assert "Exchange" not in plan_of(rows) and "Sort" not in plan_of(rows)
    got, terms = defaultdict(list), []
    for r in rows.collect():
        assert len(r.docs) <= 2 * block  # ids that occur twice may stand in two rows of one block
        terms.append(r.term)
        for doc in r.docs:
            at = 0
            for g in doc.gaps:
                at += g
                got[r.term, r.session_id, doc.id].append(at)
    assert {k: sorted(v) for k, v in got.items()} == places(chunks)
    if run == 1_000_000:
        assert terms == sorted(terms, key=str.encode)  # a run is in order of words


def test_posting_rows_need_no_shuffle(spark, chunks, monkeypatch):
    rows = registry.QUERY["posting_rows"](spark, SF)
    assert "Exchange" not in plan_of(rows) and rows.count() > 0

    class Repeated:  # ids that occur twice are brought together
        def __init__(self):
            self.rows, self.postings = chunks, index.postings(chunks)

    monkeypatch.setattr(registry, "index", lambda *_: Repeated())
    want = defaultdict(list)
    for (term, _, key), at in places(chunks).items():
        want[term, key] += at
    got = {(r.term, r.id): (r.n, r.first_pos, r.last_pos, r.positions) for r in registry.QUERY["posting_rows"](spark, SF).collect()}
    assert got == {k: (len(v), min(v), max(v), sum(v)) for k, v in want.items()}


@pytest.mark.parametrize("run", [250_000, 30])
def test_trigram_sets_in_slices(monkeypatch, run):
    monkeypatch.setattr(index, "GRAM_RUN", run)
    rnd = random.Random(2)
    lists = [None if k == 3 else rnd.choices(["ferry", "naïve", "漢字", "𝒳𝒴", "x1"], k=k % 12) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["s"] * 52), pa.array([f"c{k}" for k in range(52)]), pa.array([["x"], ["y"], *lists], pa.list_(pa.string()))], names=["session_id", "id", "w"]).slice(2)
    out = list(index._sets({"fer": 1})(iter([batch])))
    assert len(out) == 1 if run > 300 else len(out) > 8
    got = [(i, m, p) for b in out for i, m, p in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert [i for i, _, _ in got] == [f"c{k}" for k in range(2, 52)]
    for (_, m, packed), own in zip(got, lists, strict=True):
        want = set().union(*(channels.local_trigrams(w) for w in own or ()))
        assert m == len(want) and packed == "".join(sorted(want, key=lambda g: (g == "fer", g)))


def test_trigram_sets_as_lists(spark, chunks):
    got = sorted((r.id, r.m, sorted(r.grams)) for r in index.gram_sets(chunks, {}).collect())
    sets = ((r.id, set().union(*(channels.local_trigrams(w) for w in re.findall(r"[^\W_]+", (r.content or "").lower())))) for r in chunks.collect())
    assert got == sorted((i, len(s), sorted(s)) for i, s in sets if s)


def test_trigram_scan_in_slices():
    n = 3 * channels.SLICE + 1
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{k}" for k in range(n)]), pa.array([None if k == 1 else f"ferry w{k}" for k in range(n)])], names=["id", "content"])
    out = list(channels._shared_trigrams(frozenset(["fer", "w7 "]), 100)(iter([batch])))
    assert len(out) == 4 and max(len(set(b.column(0).to_pylist())) for b in out) <= channels.SLICE
    got = sorted((i, m, g) for b in out for i, m, g in zip(*(c.to_pylist() for c in b.columns), strict=True))
    sets = {f"c{k}": channels.local_trigrams("ferry") | channels.local_trigrams(f"w{k}") for k in range(n) if k != 1}
    assert got == sorted((i, len(s), g) for i, s in sets.items() for g in s & {"fer", "w7 "})


def test_redacted_json_in_slices(spark, monkeypatch):
    given = [None, "", "a@b.example.com", '{"a":["x@y.example.com",1]}', "[1", '"q"'] * 7
    want = [None, "", text.MARK, '{"a":["%s",1]}' % text.MARK, "[1", '"q"'] * 7
    monkeypatch.setattr(text, "REDACTED_AT_ONCE", 4)
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").coalesce(1)
    assert [r.m for r in rows.select("k", text.redact_json("t").alias("m")).orderBy("k").collect()] == want


def test_texts_of_candidates_are_not_shuffled(spark, monkeypatch):
    def found():
        s = Search(corpus.index(spark, SF).rows, corpus.queries(spark, SF), corpus.MODEL, corpus.NOW, corpus.DIM, index=corpus.index(spark, SF))
        try:
            return plan_of(s.fused), sorted((r.query_id, r.id, round(r.score, 9), r.content) for r in s.fused.collect())
        finally:
            s.release()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, rows = found()
        joins = [line for line in plan.split("InMemoryTableScan")[0].splitlines() if "Join" in line]
        assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]
        monkeypatch.setattr(search, "MAX_SENT", 0)  # too many to be sent: the same rows by a shuffle
        plan, shuffled = found()
        assert "SortMergeJoin" in plan and shuffled == rows and rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_pass_one_join_for_all_channels(spark):
    rows = registry.plan(spark, SF).base(False)
    assert "Join" not in plan_of(rows)
    assert sorted(map(str, corpus.index(spark, SF).rows.collect())) == sorted(map(str, corpus.chunks(spark, SF).collect()))
