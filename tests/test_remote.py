"""Vectors from a service: rate over all tasks, retries, failed texts, resumption, settings."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark import config, remote
from tidemark.embedding import call_batches, embed, query_embedder
from tidemark.errors import ConfigError, QueryError
from tidemark.ingest import Run
from tidemark.store import Store


class Service(http.server.BaseHTTPRequestHandler):
    """Vectors of four numbers; refuses once where asked to, fails on texts with ``poison``."""

    def log_message(self, *args):
        pass

    def do_POST(self):
        own = self.server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with own.guard:
            own.calls.append((time.monotonic(), body, self.headers.get("Authorization")))
            refuse, own.refusals = own.refusals > 0, max(0, own.refusals - 1)
        texts = body["input"]
        code = 429 if refuse else 500 if any("poison" in t for t in texts) else 200
        self.send_response(code)
        if refuse:
            self.send_header("Retry-After", "0.1")
        self.end_headers()
        if code == 200:
            short = len(texts) - any("short" in t for t in texts)
            self.wfile.write(json.dumps({"data": [{"embedding": [len(t), 1.0, 2.0, 3.0][: 3 if "narrow" in t else 4]} for t in texts[:short]]}).encode())


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    server.calls, server.refusals, server.guard = [], 0, threading.Lock()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def settings(service, tmp_path, **more):
    (tmp_path / "key").write_text("secret\n")
    own = {"embedding_provider": "remote", "embedding_url": f"http://127.0.0.1:{service.server_address[1]}/v1", "embedding_table": str(tmp_path / "vectors"), "embedding_key_file": str(tmp_path / "key"), "embedding_dim": 4}
    return config.load(env={}, **(own | {"embedding_model": "m", "batch_size": 2, "max_retries": 1, "requests_per_second": 200.0, "fetch_tasks": 2} | more))


def test_fill_keeps_what_it_has(spark, service, tmp_path):
    s = settings(service, tmp_path)
    rows = spark.createDataFrame([(f"text {k % 9}",) for k in range(30)] + [(None,), ("",)], "content string").withColumn("embedding", F.lit("clash"))
    assert remote.known(spark, s).count() == 0
    assert remote.fill(rows, s).count() == 0 and remote.known(spark, s).count() == 10
    sent = [t for _, body, _ in service.calls for t in body["input"]]
    assert sorted(sent) == sorted([f"text {k}" for k in range(9)] + [""]) and all(len(b["input"]) <= 2 and b["model"] == "m" and b["input_type"] == "document" for _, b, _ in service.calls)
    assert {a for _, _, a in service.calls} == {"Bearer secret"}
    n = len(service.calls)
    assert remote.fill(rows, s).count() == 0 and len(service.calls) == n  # nothing is sent twice
    got = embed(rows.drop("embedding").where("content is not null"), s).select("content", "embedding").distinct().collect()
    assert all(r.embedding == [len(r.content), 1.0, 2.0, 3.0] for r in got) and len(got) == 10
    assert remote.fill(rows.where("false"), s).count() == 0


def test_failures_are_rows_and_stay_due(spark, service, tmp_path, monkeypatch):
    s = settings(service, tmp_path, batch_size=1)
    monkeypatch.setattr(remote, "SLICE_SECONDS", 0.01)  # two texts a slice
    rows = spark.createDataFrame([("good",), ("poison",), ("narrow",), ("short",), ("fine",)], "content string")
    failed = {r.content: r.error for r in remote.fill(rows, s).collect()}
    assert set(failed) == {"poison", "narrow", "short"} and "500" in failed["poison"] and "dimension" in failed["narrow"] and "number" in failed["short"]
    n = len(service.calls)
    assert remote.fill(rows, s).count() == 3 and len(service.calls) == n + 3
    service.refusals = 1
    assert remote.fill(spark.createDataFrame([("later",)], "content string"), settings(service, tmp_path, max_retries=2)).count() == 0
    assert query_embedder(spark, s)("where") == [5.0, 1.0, 2.0, 3.0] and service.calls[-1][1]["input_type"] == "query"
    with pytest.raises(QueryError) as e:
        query_embedder(spark, s)("poison")
    assert e.value.code == "embedding_unavailable"


def test_one_rate_for_all_tasks(spark, service, tmp_path):
    s = settings(service, tmp_path)
    rows = spark.range(24).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("content"))
    assert call_batches(rows, remote.caller(s), batch=1, per_second=10.0, tasks=4).where("error is null").count() == 24
    at = sorted(t for t, _, _ in service.calls)
    for a, b in zip(at, at[14:]):
        assert b - a > 0.9  # any 15 calls span at least a second and a bit, whatever the task


def test_ingest_with_a_service(spark, service, tmp_path):
    message = lambda text: json.dumps({"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}}) + "\n"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.jsonl").write_text(message("a harbour full of ships"))
    (tmp_path / "s" / "b.jsonl").write_text(message("the poison session"))
    s = settings(service, tmp_path, sessions_root=str(tmp_path / "s"), batch_size=1)
    target = Store(spark, str(tmp_path / "w"))
    target.migrate()
    assert Run(spark, target, s).sessions(dry_run=True)["found"] == 2 and not service.calls
    got = Run(spark, target, s).sessions()
    assert (got["done"], got["partial"]) == (1, 1)
    rows = target.table("session_chunks").collect()
    assert [(r.session_id, r.embedding_model, len(r.embedding)) for r in rows] == [("a", "m", 4)]
    (tmp_path / "s" / "b.jsonl").write_text(message("the mended session"))
    assert Run(spark, target, s).sessions()["done"] == 1 and target.table("session_chunks").count() == 2


def test_settings_that_are_refused(service, tmp_path):
    for more in ({"embedding_url": ""}, {"embedding_table": ""}, {"batch_size": 0}, {"requests_per_second": 0.0}, {"fetch_tasks": 0}):
        with pytest.raises(ConfigError):
            settings(service, tmp_path, **more)
    with pytest.raises(ConfigError):
        remote.caller(settings(service, tmp_path, embedding_key_file=str(tmp_path / "none")))
