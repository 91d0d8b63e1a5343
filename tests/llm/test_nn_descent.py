import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import nn_descent as nn

from .test_near_dup import roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    ok = {}
    width = max(len(v or []) for _, v, _ in rows)
    for k, (i, v, _) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(np.float32(v)).all() and np.any(np.float32(v)):
            x = np.zeros(width)
            x[: len(v)] = np.float32(v)
            ok[k] = x / np.abs(x).max()
    keys = list(ok)
    x = np.array([ok[k] / np.linalg.norm(ok[k]) for k in keys])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    links = [(rows[keys[a]][0], rows[keys[b]][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    root = roots(sorted({r[0] for r in rows if r[0] is not None}), links)
    n = {k: int(near[j].sum()) for j, k in enumerate(keys)}
    return sorted((rows[k][0] is None, rows[k][0] or 0, n.get(k, 0), root.get(rows[k][0])) for k in range(len(rows)))


def vectors(n=1500, dim=16):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, dim))
    x[100:400] = x[100] + r.normal(size=(300, dim)) * 0.05  # crowded: lists saturate
    x[400:440] = x[400]  # equal vectors
    for k in range(440, 470):  # a chain
        x[k] = x[k - 1] + r.normal(size=dim) * 0.3
    x[500:900:2] = x[501:900:2] + r.normal(size=(200, dim)) * 0.12  # pairs
    return [(i, [float(f) for f in v], i % 7) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [1024, 100])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(nn, "BLOCK", block)
    rows = vectors()
    out = nn.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = {x[1]: x for x in brute(rows, 0.9)}
    got = {r.vec_id: r for r in out}
    found, true = sum(r.n_links for r in out), sum(x[2] for x in want.values())
    assert all(r.n_links <= want[r.vec_id][2] for r in out) and found >= 0.98 * true
    assert np.mean([got[i].component_id == want[i][3] for i in got]) > 0.98
    assert all(r.kept == (r.component_id == r.vec_id) for r in out)
    assert {r.recall >= nn.RECALL for r in out} == {True}


def test_edge_rows(spark, tmp_path):
    rows = [
        (1, None, 0),
        (2, [], 0),
        (3, [0.0, 0.0, 0.0], 0),
        (4, [1.0, None, 0.0], 0),
        (5, [1.0, float("nan"), 0.0], 0),
        (6, [float("inf"), 0.0, 1.0], 0),
        (7, [1.0, 2.0, 3.0], None),
        (8, [2.0, 4.0, 6.0], 1),
        (9, [1.0, 2.0], 1),
        (10, [1.0, 2.0, 0.1], 1),
        (10, [1.0, 2.0, 0.1], 1),
        (None, [1.0, 2.0, 3.0], 1),
        (50, [-1.0, -2.0, -3.0], 1),
        (51, [3e38, 6e38 / 2, 1e30], 1),
        (52, [3e-40, 3e-40, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as node", "1 as n_links", "2 as unit")
    out = nn.near_vectors(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in out) == brute(rows, 0.9)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert nn.op7_nn_descent(spark, str(tmp_path)).collect() == []
    assert [r.n_links for r in nn.near_vectors(spark.createDataFrame(rows[:6], SCHEMA)).collect()] == [0] * 6


def groups(n, dim=64, apart=0.95):
    """Two groups: cosines of about 0.99 inside, of 0.94 between."""
    r = np.random.default_rng(4)
    a = np.eye(dim)[0]
    b = apart * a + np.sqrt(1 - apart**2) * np.eye(dim)[1]
    x = np.concatenate([c + r.normal(size=(n, dim)) * 0.1 / np.sqrt(dim) for c in (a, b)])
    return [(i, [float(f) for f in v], 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("n", [30, 300])
def test_links_between_saturated_components(spark, monkeypatch, n):
    monkeypatch.setattr(nn, "AUDITS", 1)
    monkeypatch.setattr(nn, "WIDE", 50)
    alone = [(1000 + k, [float(j == 2 + k) for j in range(64)], 0) for k in range(5)]
    rows = groups(n) + alone
    out = nn.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows, 0.9)
    assert sum(x[2] for x in want) > 1.9 * 2 * n * (n - 1)  # links between the groups count, too
    assert sorted((False, r.vec_id, r.n_links, r.component_id) for r in out) == want


@pytest.mark.parametrize("wide", [4096, 300])
def test_missed_sparse_links_are_seen_behind_a_dense_group(spark, monkeypatch, wide):
    monkeypatch.setattr(nn, "WIDE", wide)
    rows = vectors()[:900]
    sparse = {i for i, _, _ in rows if i >= 470}
    resolve = nn.Search.resolve

    def blind(self):
        """A search that never finds a link of the sparse rows."""
        out = resolve(self)
        lost = F.col("node").isin([r.node for r in self.rows.where("vec_id >= 470").select("node").collect()])
        self.known = self.known.withColumn("m", F.when(lost, 0).otherwise(F.col("m")))
        return out.withColumn("n_links", F.when(F.col("vec_id") >= 470, 0).otherwise(F.col("n_links")))

    monkeypatch.setattr(nn.Search, "resolve", blind)
    monkeypatch.setattr(nn, "AUDITS", 1)
    out = nn.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows, 0.9)
    assert sum(x[2] for x in want if x[1] in sparse) < 0.03 * sum(x[2] for x in want)  # a sum of links would not show it
    assert sorted((False, r.vec_id, r.n_links, r.component_id) for r in out) == want
    assert {(r.exact, r.recall) for r in out} == {(True, 1.0)}


def test_tables_grow_with_the_cells():
    s = nn.Search.__new__(nn.Search)
    s.threshold = 0.9
    for s.n in (10, 1000, 1_000_000):
        bits, n = s.tables()
        assert n >= nn.TABLES and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** n <= nn.MISS


def pairs_without_audited_ids(n=900):
    """Triples of near vectors; no id is divisible by 50."""
    r = np.random.default_rng(8)
    base = r.normal(size=(n // 3, 24))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.1, base + r.normal(size=base.shape) * 0.1])
    return [(50 * i + 1, [float(f) for f in v], 0) for i, v in enumerate(x)]


def test_recall_is_measured_where_no_id_is_audited(spark, monkeypatch):
    rows = pairs_without_audited_ids()
    want = brute(rows, 0.9)
    monkeypatch.setattr(nn, "AUDITS", 1)
    monkeypatch.setattr(nn, "ROUNDS", 0)
    monkeypatch.setattr(nn.Search, "tables", lambda self: (6, 1))  # a search that misses many links
    out = nn.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((False, r.vec_id, r.n_links, r.component_id) for r in out) == want and {(r.exact, r.recall) for r in out} == {(True, 1.0)}
    monkeypatch.setattr(nn, "SMALL", 10)  # as in a table too large to ask all
    out = nn.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((False, r.vec_id, r.n_links, r.component_id) for r in out) == want and {r.exact for r in out} == {True}


def test_recall_without_any_link(spark, monkeypatch):
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(50 * i + 1, [float(f) for f in v], 0) for i, v in enumerate(r.normal(size=(60, 40)))], SCHEMA)
    assert {x.recall for x in nn.near_vectors(df).collect()} == {1.0}  # all classes were asked
    monkeypatch.setattr(nn, "SMALL", 10)
    assert {x.recall for x in nn.near_vectors(df).collect()} == {None}  # nothing was measured
