import re

import numpy as np
import pytest

from tidemark.llm.graph import components
from tidemark.llm import common, minhash
from tidemark.llm.minhash import Join, chunks, distance_limit, keep_first, near_duplicates, op5_minhash_near_dedup

from .fixtures import TEXTS, documents, dump

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(texts, links)


def corpus():
    """Exact copies, a large group of near copies, chains of edits, and shared passages."""
    r = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 5))
    texts = list(TEXTS)
    base = [word() for _ in range(120)]
    for _ in range(150):  # mutual similarity near the threshold
        own = list(base)
        for at in r.integers(0, 120, r.integers(0, 7)):
            own[at] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(90)]
    for step in range(30):  # each links to the next one only
        chain[(step * 3) % 90] = word()
        texts.append(" ".join(chain))
    for _ in range(120):  # half a shared passage: no link
        texts.append(" ".join(base[:60] + [word() for _ in range(60)]))
    texts += [t.upper() for t in texts[20:40] if t] * 3
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, k, percent):
    texts = dict(enumerate(corpus()))
    sets, root = brute(texts, k, percent)
    rows = near_duplicates(documents(spark, list(texts.values())).repartition(5), shingle=k, percent=percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id), texts[r.doc_id]


def test_keep_first_keeps_columns(spark):
    from pyspark.sql import functions as F

    texts = corpus()
    _, root = brute(dict(enumerate(texts)), 5, 80)
    df = documents(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("_gone", F.lit(2))
    out = keep_first(df)
    assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == sorted({root[i] for i in root})


def test_one_row_of_each_group_stays(spark):
    a, near_a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in "axbc")
    near_a = a + " more"
    schema = "doc_id long, text string, note string"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (5, c, "x"), (7, a, "z"), (3, near_a, "x"), (None, a, "x"), (9, "", "x"), (9, "", "x")]
    out = keep_first(spark.createDataFrame(rows, schema)).collect()
    kept = sorted((r.doc_id or 0, r.text) for r in out)
    assert len(kept) == 6 and kept[0] == (0, a) and kept[-2:] == [(9, "")] * 2
    assert {t for i, t in kept if i == 5} == {b, c} and [t for i, t in kept if i == 3][0] in (a, near_a) and (7, a) not in kept
    found = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.component_id or 0, r.kept) for r in found if r.doc_id in (3, 7)) == [(3, False), (3, True), (3, True)]
    assert sorted((r.component_id, r.kept) for r in found if r.doc_id == 5) == [(3, False), (5, True), (5, True), (5, True)]


def test_repeated_rows_cost_one_set(spark):
    a = " ".join(f"a{k}" for k in range(80))
    rows = [(1, a)] * 10_000 + [(2, a + " tail")] * 50 + [(1, "something else " + a[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    j = Join(df, 5, 80, "doc_id", "text")
    counts, take = [], j.sets

    def watched(nodes):
        found = take(nodes)
        counts.append(found.count())
        return found

    j.sets = watched
    out = j.run()
    assert out.count() == len(rows)
    assert max(counts) == 2  # a set for each class, however often its row is repeated
    assert j_counts(out) == {(1, 1): 10_001, (2, 1): 50}
    assert len(keep_first(df).collect()) == 2


def j_counts(out):
    return {(r.doc_id, r.component_id): r["count"] for r in out.groupBy("doc_id", "component_id").count().collect()}


def test_salted_joins_and_shuffled_sets(spark, monkeypatch):
    """The same result with every key heavy and every set looked up by shuffle."""
    for name in ("spread_join", "materialize"):
        assert getattr(minhash, name) is getattr(common, name)
    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(minhash, "HEAVY_SETS", 2)
    monkeypatch.setattr("tidemark.llm.graph.HEAVY", 3)
    monkeypatch.setattr(minhash, "BROADCAST", 0)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = dict(enumerate(corpus()))
    _, root = brute(texts, 3, 85)
    rows = near_duplicates(documents(spark, list(texts.values())).repartition(5), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == root


def test_edge_rows(spark, tmp_path):
    at = dump(spark, tmp_path / "none", documents(spark, []))
    assert op5_minhash_near_dedup(spark, at).collect() == []
    extra = [(None, TEXTS[4], None, None, None), (4, TEXTS[4], None, None, None), (4, "other words here entirely", None, None, None)]
    out = near_duplicates(documents(spark, extra=extra)).collect()
    assert len(out) == len(TEXTS) + 3
    assert [r.kept for r in out if r.doc_id is None] == [True] and {r.component_id for r in out if r.doc_id in (4, 5)} == {4}


def test_only_blank_texts(spark):
    out = near_duplicates(documents(spark, [None, "", " \n"])).collect()
    assert all(r.kept and r.n_shingles == 0 and r.component_id == r.doc_id for r in out)


def test_pigeonhole_covers_the_limit():
    for percent in (80, 85, 95):
        t = distance_limit(percent)
        parts = chunks(t)
        assert sorted(np.concatenate(parts)) == list(range(40)) and (len(parts) * 2 > t) and min(map(len, parts)) > 1


def test_components(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001 + i) for i in range(400)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = {x for a, b in edges if a != b for x in (a, b)}
    want = roots(sorted({x for e in edges for x in e}), edges)
    assert got == {i: want[i] for i in ids}
