"""Every registered query against its SQL oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans.registry import ORACLE, QUERY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERY))
def test_query(spark, duck, name):
    df = QUERY[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_plans_stay_in_the_jvm(spark):
    """Column-only operators must not bring Python into their plans."""
    for name in ("redact_documents", "exact_substring", "temporal_decay", "dedup_provenance", "conversation_chunks", "audit_patterns", "dense_topk"):
        plan = QUERY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
    scan = QUERY["redact_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan
