import json
import os
import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config, indexing, ingest
from tidemark.ingest import Run
from tidemark.operators import channels, index
from tidemark.plans.search import Search, search
from tidemark.store import Store

WORDS = ["ferry", "harbour", "Lantern", "naïve", "ÉLAN", "x1", "the", "of", "漢字", "don't", "İstanbul", "ΣΑΣ"]
NOW = datetime(2024, 2, 1, tzinfo=UTC)


def write(path, *records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in records))


def message(role, text):
    return {"type": "message", "message": {"role": role, "content": text}, "timestamp": "2024-01-02T00:00:00Z"}


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        text = None if i == 7 else "" if i == 8 else " ".join(rnd.choices(WORDS, k=rnd.randint(1, 30)))
        vector = None if i == 9 else [0.0] * 4 if i == 10 else [float("nan"), 0.0, 0.0, 1.0] if i == 11 else [rnd.gauss(0, 1) for _ in range(4)]
        rows.append((f"c{i:03}", None if i == 5 else f"s{i % 2}", "chat" if i % 3 else "main", text, vector, "m", datetime(2024, 1, 1 + i % 20)))
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, "id string, session_id string, source_type string, content string, embedding array<float>, embedding_model string, timestamp_start timestamp").withColumn("created_at", F.col("timestamp_start"))


@pytest.fixture(scope="module")
def asked(spark):
    texts = [(0, "the ferry"), (1, "lantern"), (2, "of the of x1"), (3, "élan harbour naïve"), (4, "absent"), (5, "'"), (6, "漢字 & the"), (7, "i̇stanbul"), (8, "σασ")]
    r = np.random.default_rng(3)
    rows = [(q, t, [float(x) for x in r.normal(size=4)], 6) for q, t in texts]
    return spark.createDataFrame(rows, "query_id int, text string, embedding array<double>, pool int")


def listed(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 10])
def test_postings_equal_the_scan(spark, chunks, asked, tmp_path, block):
    once = chunks.distinct()
    index.postings(once, block).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.select(F.max(F.size("docs"))).first()[0] <= 4 * block
    for allowed in (once, once.where("source_type = 'chat'"), once.where("false")):
        assert listed(index.lexical(stored, allowed, asked)) == listed(channels.lexical(allowed, asked))
    n = stored.where("term = 'the'").count()  # sessions s0, s1 and none, in one block each or in several
    assert n == 3 if block == 4096 else n > 6


def test_word_search_reads_no_text(spark, chunks, asked, tmp_path):
    chunks.distinct().write.parquet(str(tmp_path / "c"))
    stored_chunks = spark.read.parquet(str(tmp_path / "c"))
    index.postings(stored_chunks).write.parquet(str(tmp_path / "p"))
    s = Search(stored_chunks, asked.withColumn("limit", F.lit(3)).withColumn("offset", F.lit(0)), "m", NOW, 4, index=index.Index(spark.read.parquet(str(tmp_path / "p"))))
    plan = index.lexical(s.index.postings, s.base(False), s.asked)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("content" in line.split("ReadSchema")[1] for line in scans)
    assert any("In(term" in line or "EqualTo(term" in line or "Or(" in line for line in scans)


@pytest.mark.parametrize("counted,threshold", [(0, 0.3), (60, 0.3), (60, 0.1), (60, 0.75), (60, 1.0)])
def test_stored_trigrams_equal_the_scan(spark, chunks, asked, tmp_path, counted, threshold):
    once = chunks.distinct()
    order = index.gram_order(once, counted) if counted else {}
    index.gram_sets(once, order).write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    more = asked.unionByName(asked.where("query_id < 4").withColumn("query_id", F.col("query_id") + 20).withColumn("text", F.concat("text", F.lit(" lantern of harbours x1"))))
    for allowed in (once, once.where("source_type = 'chat'")):
        got = listed(index.trigram(stored, order, allowed, more, threshold))
        assert got == listed(channels.trigram(allowed, more, threshold))
    plan = index.trigram(stored, order, once.select("id"), more, threshold)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(m" in plan and "LessThanOrEqual(m" in plan


def test_all_cells_equal_the_exact_channel(spark, chunks, asked):
    once = chunks.distinct()
    centre = index.train(once.where("embedding IS NOT NULL").select("id", "embedding"), 4, cells=7)
    assert centre.shape == (7, 4) and np.allclose(np.linalg.norm(centre, axis=1), 1, atol=1e-5)
    rows = index.cells(once, centre)
    own = {r.id: r.cell for r in rows.collect()}
    assert own["c010"] == own["c011"] == -1 and "c009" not in own and set(own.values()) == {-1, *range(7)}
    cells = index.Cells(rows, centre, 7)
    usable = once.where("embedding IS NOT NULL")
    for allowed in (usable, usable.where("source_type = 'main'")):
        assert listed(cells.dense(allowed, asked)) == listed(channels.dense(allowed, asked))
    few = listed(cells.dense(usable, asked, probes=1))
    assert 0 < len(few) <= len(listed(channels.dense(usable, asked)))


def test_audit_widens_the_probes(spark):
    r = np.random.default_rng(2)
    heads = r.normal(size=(20, 16))
    x = np.concatenate([h + r.normal(size=(60, 16)) * 0.3 for h in heads]).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:05}", f"s{i % 3}", [float(f) for f in v]) for i, v in enumerate(x)], "id string, session_id string, embedding array<float>")
    centre = index.train(df.select("id", "embedding"), 16, cells=20)
    cells = index.Cells(index.cells(df, centre), centre, 20)
    probes, measured = cells.audit(audited=30, pool=50)
    assert 1 <= probes < 20 and measured[-1][1] >= index.RECALL and [p for p, _ in measured] == [2**k for k in range(len(measured))]
    # Against plain numpy, over queries that the audit did not draw.
    u = x / np.linalg.norm(x, axis=1)[:, None]
    picked = [5, 333, 700, 1100]
    asked = spark.createDataFrame([(k, [float(f) for f in x[k]], 50) for k in picked], "query_id int, embedding array<double>, pool int")
    found = {(r.query_id, r.id) for r in cells.dense(df, asked, probes).collect()}
    true = {(k, f"v{i:05}") for k in picked for i in np.argsort(-(u @ u[k]))[:50]}
    assert len(found & true) / len(true) >= 0.8
    assert cells.audit(audited=30, pool=50, least=1.01)[0] == 20  # never enough: all cells, which is exact


def test_no_vectors_no_cells(spark, chunks, asked):
    none = chunks.where("id IN ('c010', 'c011')")
    centre = index.train(none.select("id", "embedding"), 4)
    assert len(centre) == 0 and {r.cell for r in index.cells(none, centre).collect()} == {-1}
    assert index.postings(chunks.where("false")).collect() == [] and index.postings(chunks.where("content IS NULL")).collect() == []


def test_a_store_keeps_its_indexes(spark, tmp_path, monkeypatch):
    s = config.load(env={}, warehouse=str(tmp_path / "w"), sessions_root=str(tmp_path / "s"), embedding_dim=8, embedding_model="hashed-8", embedding_provider="hashed", environment="test", allow_hashed=True)
    for k in range(6):
        write(str(tmp_path / "s" / f"u{k}.jsonl"), message("user", f"where is the ferry number{k} today"), message("assistant", "at the quay, as every day"))
    store = Store(spark, str(tmp_path / "w"))
    store.migrate()
    rows, calls = spark.sparkContext.accumulator(0), ingest.embed

    def counted(given, *rest):
        @F.pandas_udf("string")
        def seen(ids):
            rows.add(len(ids))
            return ids

        return calls(given, *rest).withColumn("id", seen("id"))

    monkeypatch.setattr(ingest, "embed", counted)
    got = Run(spark, store, s).sessions()
    assert (got["done"], got["unchanged"]) == (6, 0) and rows.value == 6  # each chunk went through the embedder once
    have = indexing.stored(store)
    assert have.postings is not None and have.cells is None

    def same():
        """Searches with and without the indexes agree, and postings are those of the present chunks."""
        chunks, have = store.table("session_chunks"), indexing.stored(store)
        fresh = {(r.term, d.id, tuple(d.gaps)) for r in index.postings(chunks).collect() for d in r.docs}
        assert {(r.term, d.id, tuple(d.gaps)) for r in have.postings.collect() for d in r.docs} == fresh
        assert {(r.id, frozenset(r.grams)) for r in have.grams.collect()} == {(r.id, frozenset(r.grams)) for r in index.gram_sets(chunks, {}).collect()}
        for text in ("the quay",):
            options = {"model": "hashed-8", "dim": 8, "now": NOW, "embed": lambda t: [float(len(t) % 3)] + [1.0] * 7}
            a, b = (search(chunks, text, limit=5, index=i, **options) for i in (None, have))
            assert [(r.id, round(r.score, 9)) for r in a] == [(r.id, round(r.score, 9)) for r in b] and a
        return have

    same()
    write(str(tmp_path / "s" / "u3.jsonl"), message("user", "no boat for number3 any more, says the quay"))
    got = Run(spark, store, s).sessions()
    assert (got["found"], got["done"], got["unchanged"]) == (1, 1, 5)
    same()
    made = indexing.rebuild(store, 8, cells=3)
    assert made["cells"] == 3 and 1 <= made["probes"] <= 3
    assert same().cells.probes == made["probes"]
    write(str(tmp_path / "s" / "u9.jsonl"), message("user", "one more ferry, number9"))
    Run(spark, store, s).sessions()
    assert {r.session_id for r in same().cells.rows.collect()} == {"u0", "u1", "u2", "u3", "u4", "u5", "u9"}
    gone = spark.createDataFrame([("u0",), ("u9",)], "session_id string")
    store.publish(indexing.without(store, gone) | {"session_chunks": store.removed("session_chunks", gone, "session_id")})
    assert {r.session_id for r in same().cells.rows.collect()} == {"u1", "u2", "u3", "u4", "u5"}
