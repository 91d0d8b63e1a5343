"""Members of archives as rows, and which of their findings block."""

import gzip
import hashlib
import io
import tarfile
import zipfile

from tidemark.functions import text
from tidemark.operators import lifecycle
from tidemark.sources import artifacts


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("folder")
        for name, body in files.items():
            z.writestr(name.replace("__", "."), body)
    return out.getvalue()


def tarred(mode, **files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name.replace("__", "."))
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "elsewhere"
        t.addfile(link)
    return out.getvalue()


def test_members_of_archives(spark, tmp_path):
    secret = b"mail ann@harbour.org\n"
    inner = tarred("w:gz", a__txt=secret, b__txt=b"\xff plain")
    files = {
        "plain.txt": secret,
        "one.zip": zipped(x__txt=secret, in__tar__gz=b""),
        "deep/two.tgz": tarred("w:gz", in__zip=zipped(t__tar__gz=inner), c__txt=b"nothing"),
        "three.tar": tarred("w", d__txt=b"x" * 5000),
        "broken.tar.gz": gzip.compress(b"no archive at all"),
        "cut.zip": zipped(x__txt=secret)[:-10],
    }
    for name, body in files.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(body)
    rows = {r.path: r for r in artifacts.read(spark, str(tmp_path / "r"), most=2000).collect()}
    for name, body in files.items():
        assert (rows[name].digest, rows[name].size) == (hashlib.sha256(body).hexdigest(), len(body))
    t = "deep/two.tgz!/in.zip!/t.tar.gz"
    assert set(rows) - set(files) == {"one.zip!/x.txt", "one.zip!/in.tar.gz", "deep/two.tgz!/c.txt", "deep/two.tgz!/in.zip", t, f"{t}!/a.txt", f"{t}!/b.txt", "three.tar!/d.txt"}
    assert rows[f"{t}!/a.txt"].text == secret.decode() and rows[f"{t}!/b.txt"].text == "� plain" and rows[f"{t}!/a.txt"].digest == hashlib.sha256(secret).hexdigest()
    assert rows["three.tar!/d.txt"].error == "too large" and rows["three.tar!/d.txt"].text is None
    assert rows["broken.tar.gz"].error and rows["cut.zip"].error and rows["one.zip!/in.tar.gz"].error and not rows["one.zip"].error
    shallow = artifacts.read(spark, str(tmp_path / "r"), depth=1).where("path like 'deep%'").collect()
    assert {r.path: r.error for r in shallow}["deep/two.tgz!/in.zip"] == "too deep" and len(shallow) == 3

    found = lifecycle.audit(artifacts.read(spark, str(tmp_path / "r")).selectExpr("*", "'artifact' as source"), "path", "digest", "source")
    rules = [("email_in_blob", None, f"{t}!/a.txt", hashlib.sha256(secret).hexdigest(), None), ("email_in_blob", None, "plain.txt", "0" * 64, None), ("email_in_blob", "commit", None, None, None), ("host_path", None, "one.zip!/x.txt", None, None)]
    got = {(r.path, r.blocking) for r in lifecycle.allow(found, spark.createDataFrame(rules, lifecycle.ALLOWED)).where("category = 'email_in_blob'").collect()}
    assert got >= {(f"{t}!/a.txt", False), ("plain.txt", True), ("one.zip!/x.txt", True)}
    assert found.count() == lifecycle.allow(found, spark.createDataFrame(rules + rules, lifecycle.ALLOWED)).count()


def test_rules_are_exact(spark):
    schema = "category string, match string, blocking boolean, source string, path string, digest string"
    found = spark.createDataFrame([("k", "abc", True, "s", "p", "d"), ("k", "abcd", True, "s", None, None), ("k", "abc\n", True, None, "q", "d"), ("j", "abc", True, "s", "p", "d"), ("k", "zz", False, "s", "p", "d")], schema)

    def left(*rules):
        return [r.blocking for r in lifecycle.allow(found, spark.createDataFrame(list(rules), lifecycle.ALLOWED)).orderBy("category", "match").collect()]

    assert left() == [True, True, True, True, False]
    assert left(("k", None, None, None, "abc")) == [True, False, True, True, False]
    assert left(("k", "s", None, None, None)) == [True, False, True, False, False]
    assert left(("k", None, "p", "x", None), ("j", None, "p", "d", "a.c")) == [False, True, True, True, False]


def test_values_after_the_first_sign(spark):
    rows = [("credential_assignment", m) for m in ("password = test-abcdefghijkl", "password=\"abcd=test-efgh\"", "api_key: 'example-12345678'", "secret='te\"st-12345678'", "password = 'a:test-abcdefgh'")]
    got = [r.b for r in spark.createDataFrame(rows, "c string, m string").coalesce(1).select(text.audit_blocking("c", "m").alias("b")).collect()]
    assert got == [False, True, False, True, False]
