import hashlib
import re

import duckdb
import pytest

from tidemark.llm.fim import ORACLE, draws, fim_documents, op13_fill_in_middle, restore, restored, transform, unit_ends
from tidemark.llm.fim import UNIT

from .fixtures import TEXTS, documents, dump

MORE = ["has <P> inside", "<M>", " lead and trail \n\n", "one", "ü" * 40 + " " + "😀 " * 30, "long " * 300_000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    """The contract word by word, with lists of units in place of offsets."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    n, digest = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text)
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}")
    return n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    texts = [*TEXTS, *MORE]
    base = documents(spark, texts * 6, extra=[(None, "null id here", "en", "s", 1), (3, "id again", "en", "s", 1), (3, "id again", "en", "s", 1)])
    at = dump(spark, tmp_path_factory.mktemp("fim"), base)
    return at, base.collect(), op13_fill_in_middle(spark, at).collect()


def test_equals_brute_force(rows):
    _, source, got = rows
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text or ""), sha(r.text or "")) for r in source), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_oracle_sql_gives_the_same_rows(rows):
    at, _, got = rows
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE).fetchall(), key=str) == sorted(map(tuple, got), key=str)


def test_every_form_restores(spark):
    import regex

    unit = regex.compile(UNIT)
    for text in [*TEXTS, *MORE]:
        for k in range(20):
            h = [k * 7919, k * 104729, 0, 0 if k % 2 else 99]
            form, _, _, output = transform(text or "", unit_ends(unit, text or ""), h)
            assert restore(output, form) == (text or "")
    assert draws(42, "7") != draws(43, "7")


def test_parameters_reach_the_forms(spark):
    made = fim_documents(documents(spark, ["alpha beta gamma"] * 50), fim_percent=100, spm_percent=0)
    back = made.withColumn("b", restored("output", "form")).collect()
    assert {r.form for r in back} == {"psm"} and {r.b.text for r in back} == {"alpha beta gamma"}


def test_awkward_tables(spark):
    docs = documents(spark, [None, "x y"])
    assert fim_documents(docs.where("false")).collect() == []
    extra = docs.selectExpr("*", "1 AS n", "'z' AS form", "2 AS output", "3 AS made")
    assert [tuple(r) for r in fim_documents(extra).collect()] == [tuple(r) for r in fim_documents(docs).collect()]
