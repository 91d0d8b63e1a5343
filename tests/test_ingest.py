import io
import json
import os
import re
import sqlite3
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.embedding import call_batches, check_replay, embed
from tidemark.errors import ConfigError, EvaluationError, IngestError, MigrationError, PrivacyError, ReplayError, SnapshotError
from tidemark.ingest import Run
from tidemark.operators import chunking, lifecycle, messages, report
from tidemark.schema import TABLES
from tidemark.sources import evaluation, sessions, store
from tidemark.store import Step, Store
from tidemark.streaming import sessions as stream

HASHED = {"environment": "test", "embedding_provider": "hashed", "allow_hashed": True, "embedding_model": "hashed-8", "embedding_dim": 8}


def message(role, content, ts="2024-03-01T10:00:00Z", kind="message"):
    return json.dumps({"type": kind, "message": {"role": role, "content": content}, "timestamp": ts})


def write(path, *rows, newline="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(newline.join(rows).encode() if all(isinstance(r, str) for r in rows) else b"\n".join(rows))


@pytest.fixture
def root(tmp_path):
    a = [
        message("user", "hello, where is the ferry?"),
        "",
        "{broken",
        message("assistant", [{"type": "text", "text": "At the quay."}, {"type": "image", "text": "no"}, {"type": "text", "text": "See a@b.org"}], 1709287260000),
        message("system", "not this one"),
        message("toolResult", "nor this"),
        message("assistant", '{"tool_calls": []}'),
        message("user", "  hm "),
        message("user", "a note", kind="other"),
        message("user", "thanks a lot", "never"),
    ]
    write(tmp_path / "s" / "u1.jsonl", *a)
    write(tmp_path / "s" / "u2.jsonl.deleted.1", message("user", "the first version"))
    write(tmp_path / "s" / "u2.jsonl.deleted.2", message("user", "the second, longer version of it"))
    write(tmp_path / "s" / "u3.jsonl", message("user", "run the cron job now"))
    write(tmp_path / "s" / "u4.jsonl", message("user", "[Subagent] task for today"), message("assistant", "done with it"))
    write(tmp_path / "s" / "u5.jsonl", message("system", "nothing to keep"))
    for name in ("u1.trajectory.jsonl", "u1.checkpoint.x.jsonl", "u1.bak.jsonl", "u1.trajectory-path.json", "notes.txt"):
        write(tmp_path / "s" / name, message("user", "should not be read"))
    return tmp_path


def settings(root, **more):
    return config.load(env={}, warehouse=str(root / "w"), sessions_root=str(root / "s"), chat_root=str(root / "chat"), store_path=str(root / "store.db"), **HASHED, **more)


@pytest.fixture
def target(spark, root):
    s = Store(spark, str(root / "w"))
    s.migrate()
    return s


def test_session_messages(spark, root):
    found = sessions.discover(spark, str(root / "s"))
    assert sorted(r.name for r in found.collect()) == ["u1.jsonl", "u2.jsonl.deleted.2", "u3.jsonl", "u4.jsonl", "u5.jsonl"]
    rows = sessions.messages(sessions.lines(spark, str(root / "s" / "u1.jsonl")))
    items = messages.session_items(rows.withColumn("session_id", F.lit("u1"))).orderBy("turn_index").collect()
    assert [(r.turn_index, r.item) for r in items] == [(1, "[user] hello, where is the ferry?"), (4, "[assistant] At the quay.\nSee [redacted]"), (10, "[user] thanks a lot")]
    assert [r.ts and r.ts.isoformat() for r in items] == ["2024-03-01T10:00:00", "2024-03-01T10:01:00", None]


def test_ingest_sessions(spark, root, target):
    run = Run(spark, target, settings(root))
    assert run.sessions(dry_run=True)["done"] == 3 and target.table("session_chunks").count() == 0
    got = run.sessions()
    assert (got["found"], got["done"], got["cron"], got["empty"], got["chunks"]) == (5, 3, 1, 1, 3)
    rows = {r.session_id: r for r in target.table("session_chunks").collect()}
    assert {k: v.source_type for k, v in rows.items()} == {"u1": "main_user", "u2:deleted": "main_user", "u4": "subagent"}
    assert (rows["u1"].turn_index_start, rows["u1"].turn_index_end, len(rows["u1"].embedding)) == (1, 10, 8)
    marks = {os.path.basename(r.file_path): r.source_type for r in target.table("ingestion_state").collect()}
    assert marks["u3.jsonl"] == "cron" and marks["u5.jsonl"] == "empty"
    assert run.sessions() == {"found": 0}  # nothing changed
    write(root / "s" / "u4.jsonl", message("user", "[Subagent] task for today"), message("assistant", "done with it"), message("user", "one more thing"))
    assert run.sessions()["found"] == 1
    again = target.table("session_chunks").where("session_id = 'u4'").collect()
    assert len(again) == 1 and "one more thing" in again[0].content
    before = sorted((r.id, r.content) for r in target.table("session_chunks").collect())
    assert run.sessions(force=True)["done"] == 3
    assert sorted((r.id, r.content) for r in target.table("session_chunks").collect()) == before


def test_missing_vectors_write_nothing(spark, root, target):
    s = config.load(env={}, warehouse=str(root / "w"), sessions_root=str(root / "s"), embedding_dim=8, embedding_model="m")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    got = Run(spark, target, s, empty).sessions()
    assert got["partial"] == 3 and target.table("session_chunks").count() == 0
    sizes = {os.path.basename(r.file_path): r.file_size for r in target.table("ingestion_state").collect()}
    assert sizes["u1.jsonl"] == 0 and sizes["u3.jsonl"] > 0
    assert Run(spark, target, settings(root)).sessions()["done"] == 3  # partial files are due again


def test_error_budget(spark, root, target):
    for k in range(3):
        write(root / "s" / f"bad{k}.jsonl", "{no json", "nor this")
    assert Run(spark, target, settings(root)).sessions(dry_run=True)["empty"] == 4
    with pytest.raises(IngestError) as e:
        Run(spark, target, settings(root, max_failed_files=2)).sessions()
    assert e.value.code == "ingest_too_many_errors" and target.table("session_chunks").count() == 0


def test_ingest_chat(spark, root, target):
    def m(i, ts, content, **more):
        return json.dumps({"id": str(i), "type": 0, "timestamp": ts, "content": content, "author": {"global_name": None, "username": "ann"}} | more)

    write(root / "chat" / "general.jsonl", m(2, "2024-01-02T00:05:00+00:00", "second"), m(1, "2024-01-02T00:00:00+00:00", "first", author={"global_name": "Bo", "username": "b"}), m(3, "bad time here yes", "", attachments=[{"filename": "a.png"}], embeds=[{"title": "T"}]), m(4, "2024-01-03T00:00:00Z", "joined", type=7), "{x", m(5, "2024-01-03T00:00:00Z", "reply", type=19, author={}))
    got = Run(spark, target, settings(root)).chat()
    assert got["done"] == 1
    r = target.table("session_chunks").first()
    assert (r.session_id, r.source_type, r.channel) == ("chat-general", "chat", "general")
    assert r.content.split("\n") == ["[2024-01-02 00:00] Bo: first", "[2024-01-02 00:05] ann: second", "[2024-01-03 00:00] unknown: reply", "[bad time here ye] ann: [attachment: a.png] [embed: T]"]
    assert Run(spark, target, settings(root)).chat() == {"found": 0}
    assert Run(spark, target, settings(root)).chat(force=True, file="general.jsonl")["done"] == 1
    with pytest.raises(IngestError) as e:
        Run(spark, target, settings(root)).chat(file="none.jsonl")
    assert e.value.code == "chat_file_missing"


@pytest.fixture
def database(root):
    db = sqlite3.connect(root / "store.db")
    db.execute("CREATE TABLE sessions (id TEXT, source TEXT, title TEXT, chat_id TEXT, message_count INT, started_at REAL, last_activity_at REAL, rewind_count INT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, timestamp REAL, active INT, compacted INT)")
    db.executemany("INSERT INTO sessions VALUES (?,?,?,?,?,?,?,?)", [("a", "cli", "", "", 4, 1000.0, 2000.0, 0), ("b", "cron", "", "", 1, 1000.0, 2000.0, 0), ("c", "subagent", "", "", 1, 1500.0, None, 0), ("d", "cli", "", "", 1, None, None, 0)])
    db.executemany("INSERT INTO messages VALUES (?,?,?,?,?,?,?)", [(1, "a", "user", "first message", 1000.5, 1, 0), (2, "a", "assistant", "hidden by rewind", 1001, 0, 0), (3, "a", "assistant", "kept by compaction", 1002, 0, 1), (4, "a", "tool", "a tool result", 1003, 1, 0), (5, "b", "user", "scheduled thing", 1, 1, 0), (6, "c", "user", "subagent work", 1500, 1, 0), (7, "d", "user", "never active", 1, 1, 0)])
    db.commit()
    return db


def test_ingest_store(spark, root, target, database):
    run = Run(spark, target, settings(root))
    assert run.store()["done"] == 2
    rows = {r.session_id: r for r in target.table("session_chunks").collect()}
    assert {k: (v.source_type, v.content) for k, v in rows.items()} == {"a": ("main_user", "[user] first message\n[assistant] kept by compaction"), "c": ("subagent", "[user] subagent work")}
    assert rows["a"].timestamp_start == datetime.fromtimestamp(1000.5, UTC).replace(tzinfo=None) and rows["a"].turn_index_end == 3
    assert run.store() == {"found": 0}
    database.execute("INSERT INTO messages VALUES (8, 'a', 'user', 'a later turn', 3000, 1, 0)")
    database.execute("UPDATE sessions SET message_count = 5, last_activity_at = 3000 WHERE id = 'a'")
    database.commit()
    run.store()
    assert sorted(r.content for r in target.table("session_chunks").where("session_id = 'a'").collect()) == ["[user] a later turn", "[user] first message\n[assistant] kept by compaction"]
    database.execute("UPDATE messages SET active = 0, compacted = 0 WHERE id = 1")
    database.execute("UPDATE sessions SET rewind_count = 1, last_activity_at = 4000 WHERE id = 'a'")
    database.execute("UPDATE messages SET active = 0 WHERE session_id = 'c'")
    database.commit()
    run.store()
    rows = target.table("session_chunks").collect()
    assert [(r.session_id, r.content) for r in rows] == [("a", "[assistant] kept by compaction\n[user] a later turn")]
    with pytest.raises(ConfigError) as e:
        store.read_table(spark, str(root / "none.db"), "sessions")
    assert e.value.code == "source_not_found"


def test_store_filters_reach_the_database(spark, root, database):
    """Pushed or not, the same rows; the plan keeps only what the database can't do alike."""
    database.executemany("INSERT INTO messages VALUES (?,?,?,?,?,?,?)", [(20, None, None, None, None, None, None), (21, "a", "User", "", -1.5, 1, 1), (22, "a", "user", "", 5, 2, 0)])
    database.commit()
    path = str(root / "store.db")
    asked = ["role in ('user', 'assistant') and content is not null", "active = 0 and compacted = 0", "timestamp > 1000.5", "timestamp <= 5 and role = 'user'", "content is null", "session_id >= 'b'", "role = 'x' or active = 1", "id < 3", "active <=> null", "not active = 1", "content like 'first%'"]
    try:
        for text in asked:
            got = {}
            for pushed in ("true", "false"):
                spark.conf.set(store.PUSHED, pushed)
                got[pushed] = sorted(map(str, store.read_table(spark, path, "messages").where(text).collect()))
            assert got["true"] == got["false"], text
        spark.conf.set(store.PUSHED, "true")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        own = plan(store.read_table(spark, path, "messages").where("active = 0 and compacted = 0"))
        assert "\nFilter" not in own and " Filter " not in own, own
        narrow = store.read_table(spark, path, "messages", columns=("session_id", "active"))
        assert narrow.columns == ["session_id", "active"] and narrow.where("active = 1").count() == 6
        assert store.visible_messages(store.read_table(spark, path, "messages")).count() == 5
    finally:
        spark.conf.unset(store.PUSHED)
    f = store.EqualTo(("role",), "user")
    kinds = {"role": "string", "active": "int"}
    assert store.condition(f, kinds) == ('"role" COLLATE BINARY = ?', ["user"])
    assert store.condition(store.GreaterThan(("role",), "a"), kinds) is None and store.condition(store.EqualTo(("role",), 1), kinds) is None
    reader = store.PushingReader({"path": path, "table": "messages"}, kinds)
    assert list(reader.pushFilters([f, store.GreaterThan(("role",), "a")])) and len(reader.conditions) == 1
    assert [r for p in reader.partitions() for r in reader.read(p)].count(("user", 1)) == 4


@pytest.mark.parametrize("n", [1, 79, 80, 81, 400, 401, 720, 721, 1000, 2000])
def test_window_count(spark, n):
    starts = spark.range(1).select(chunking.windows(F.lit(n)).alias("s")).first().s
    want, s = [], 0
    while True:
        want.append(s)
        if s + 400 >= n:
            break
        s += 320
    assert starts == want


def test_chunks_overlap_and_cover(spark):
    items = spark.createDataFrame([("s", f"item{k} " + "w " * 9 + "end", k) for k in range(100)], "session_id string, item string, turn_index int").withColumn("ts", F.timestamp_seconds("turn_index"))
    rows = chunking.chunk(items, ["session_id"]).orderBy("chunk_no").collect()
    n = rows[-1].token_end
    assert n == 1100 and [(r.token_start, r.token_end) for r in rows] == [(0, 400), (320, 720), (640, 1040), (960, 1100)]
    assert rows[0].turn_index_start == 0 and rows[-1].turn_index_end == 99 and all(a.turn_index_end >= b.turn_index_start for a, b in zip(rows, rows[1:]))
    assert all(r.timestamp_start.timestamp() == r.turn_index_start for r in rows)
    assert chunking.chunk(items.where("false"), ["session_id"]).count() == 0


def test_streaming(spark, root):
    seen = []

    def sink(files, batch):
        seen.extend((r.session_id, r.item) for r in stream.items(files).collect())

    for expected in (6, 7):  # six messages at first, then the new file's
        q = stream.run(spark, str(root / "s"), str(root / "cp"), sink, per_trigger=2)
        q.awaitTermination()
        assert q.exception() is None
        if expected == 6:
            first = len(seen)
            write(root / "s" / "u9.jsonl", message("user", "streamed later on"))
    assert len(seen) == first + 1 and seen[-1] == ("u9", "[user] streamed later on") and ("u1", "[user] thanks a lot") in seen


def test_lifecycle(spark, root, target):
    Run(spark, target, settings(root)).sessions()
    bound = lifecycle.bindings(target.table("ingestion_state"))
    assert {r.scope for r in bound.collect()} == {"sessions"} and lifecycle.conflicts(bound).isEmpty()
    assert lifecycle.resolve(bound, "chat").isEmpty() and lifecycle.resolve(bound, "all", ("file:/elsewhere",)).isEmpty()
    with pytest.raises(PrivacyError) as e:
        lifecycle.resolve(bound, "moon")
    assert e.value.code == "unknown_scope"
    rows = lifecycle.export_rows(target.table("session_chunks"), bound)
    dest = str(root / "out.json")
    assert lifecycle.write_export(rows, dest) == "dry_run" and not os.path.exists(dest)
    assert [lifecycle.write_export(rows, dest, confirm=True) for _ in range(2)] == ["exported", "already_exported"]
    data = json.load(open(dest))
    assert all(set(r) == set(lifecycle.EXPORTED["chunk"]) and r["kind"] == "chunk" for r in data)
    assert len(data) == 3 and len(data[0]["session"]) == 16 and oct(os.stat(dest).st_mode)[-3:] == "600" and "a@b.org" not in open(dest).read()
    for path, code in ((str(root / "no" / "x.json"), "export_dest_missing_parent"), (dest, "export_dest_content_mismatch")):
        with pytest.raises(PrivacyError) as e:
            lifecycle.write_export(rows.limit(1), path, confirm=True)
        assert e.value.code == code
    now = F.lit(datetime(2030, 1, 1))
    assert lifecycle.old_enough(bound, now, 90).count() == 5 and lifecycle.old_enough(bound, now, 9000).isEmpty()
    ages = lifecycle.retention_report(bound, now).first()
    assert (ages.n, ages.expired, ages.retention_days) == (5, 5, 90)
    assert lifecycle.retention_report(bound, now, {"sessions": 9000}).first().expired == 0


def test_export_holds_facts_after_chunks(spark, tmp_path):
    at = [datetime(2024, 1, k) for k in (1, 2, 3)]
    chunks = spark.createDataFrame([("c2", "s", "chat", "later", at[1], None), ("c1", "s", "chat", "sooner a@b.org", at[0], None), ("c3", "t", "chat", "other", at[0], None), ("c0", "s", "chat", "no time", None, None)], "id string, session_id string, source_type string, content string, timestamp_start timestamp, metadata string")
    facts = spark.createDataFrame([("f1", "s", "b", "x", at[0], "sum", '{"k": "a@b.org"}'), ("f2", "s", "a", "y", at[2], None, None), ("f3", "t", "a", "z", at[0], None, None)], "id string, session_id string, category string, content string, timestamp timestamp, task_summary string, metadata string")
    own = spark.createDataFrame([("s",), ("s",)], "session_id string")
    dest = str(tmp_path / "out.json")
    assert lifecycle.write_export(lifecycle.export_rows(chunks, own, facts), dest, confirm=True) == "exported"
    data = json.load(open(dest))
    assert [(r["kind"], r["content"].split(" ")[0], r.get("category")) for r in data] == [("chunk", "sooner", None), ("chunk", "later", None), ("chunk", "no", None), ("fact", "y", "a"), ("fact", "x", "b")]
    assert all(set(r) == set(lifecycle.EXPORTED[r["kind"]]) for r in data) and "a@b.org" not in open(dest).read()


def test_commits_touch_only_folders_that_hold_replaced_rows(spark, tmp_path, monkeypatch):
    own = Store(spark, str(tmp_path / "w"))
    own.migrate()

    def rows(*pairs):
        return spark.createDataFrame(pairs, "session_id string, content string").select(*((F.col(f.name) if f.name in ("session_id", "content") else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES["session_chunks"].fields))

    def stored():
        return sorted((r.session_id or "", r.content) for r in own.table("session_chunks").collect())

    own.publish({"session_chunks": own.replaced("session_chunks", rows(("a", "1"), ("b", "1"), (None, "n")), "session_id")})
    first = own.current()["session_chunks"]
    own.publish({"session_chunks": own.replaced("session_chunks", rows(("c", "1")), "session_id")})
    assert own.current()["session_chunks"][: len(first)] == first  # a new session leaves the others' folders alone
    own.publish({"session_chunks": own.added("session_chunks", rows(("c", "2")))})
    before = own.current()["session_chunks"]
    folders = own.replaced("session_chunks", rows(("c", "3"), ("c", "4")), "session_id")
    assert own.current()["session_chunks"] == before and ("c", "3") not in stored()  # not published yet
    own.publish({"session_chunks": folders})
    assert stored() == [("", "n"), ("a", "1"), ("b", "1"), ("c", "3"), ("c", "4")] and first[-1] in folders
    own.publish({"session_chunks": own.removed("session_chunks", spark.createDataFrame([("a",), ("zz",)], "session_id string"), "session_id")})
    assert stored() == [("", "n"), ("b", "1"), ("c", "3"), ("c", "4")]
    monkeypatch.setattr("tidemark.store.MAX_FOLDERS", 3)
    for k in range(4):
        own.publish({"session_chunks": own.added("session_chunks", rows((f"x{k}", "1")))})
    assert len(own.current()["session_chunks"]) < 3 and len(stored()) == 8
    assert own.vacuum("session_chunks") and len(stored()) == 8


def test_a_report_leaves_no_row_out(spark):
    assert len(report.rows_of(spark.range(5), limit=5)) == 5
    with pytest.raises(EvaluationError) as e:
        report.rows_of(spark.range(6), limit=5)
    assert e.value.code == "report_too_large"


def test_store_versions_and_snapshots(spark, root, target):
    assert target.health() == "current" and target.migrate() == []
    assert Store(spark, str(root / "fresh")).health() == "uninitialized"
    Run(spark, target, settings(root)).sessions()
    manifest = target.backup(str(root / "b"))
    assert manifest["tables"]["session_chunks"]["rows"] == 3
    with pytest.raises(SnapshotError) as e:
        target.backup(str(root / "b"))
    assert e.value.code == "backup_target_exists"
    copy = Store(spark, str(root / "r"))
    copy.restore(str(root / "b"))
    assert copy.health() == "current" and copy.table("session_chunks").exceptAll(target.table("session_chunks")).isEmpty()
    with pytest.raises(SnapshotError):
        copy.restore(str(root / "b"))
    files = Store(spark, str(root / "b")).files
    files.write("MANIFEST.json", files.read("MANIFEST.json").replace('"rows": 3', '"rows": 4'))
    for bad, code in ((str(root / "b"), "manifest_digest_mismatch"), (str(root / "nowhere"), "backup_missing"), (str(root / "w"), "manifest_missing")):
        with pytest.raises(SnapshotError) as e:
            target.verify_backup(bad)
        assert e.value.code == code
    changed = [Step(1, "initial", lambda s: None, "other text")]
    assert target.health(changed) == "drifted"
    with pytest.raises(MigrationError) as e:
        target.migrate(steps=changed)
    assert e.value.code == "migration_checksum_mismatch"
    with pytest.raises(MigrationError) as e:
        target.migrate(9)
    assert e.value.code == "target_beyond_head"
    assert target.lock("sessions") and not target.lock("sessions")
    target.commit("session_chunks", target.table("session_chunks").limit(1))
    assert target.table("session_chunks").count() == 1 and target.vacuum("session_chunks") and target.table("session_chunks").count() == 1


def test_command_line(spark, root, monkeypatch):
    for k, v in HASHED.items():
        monkeypatch.setenv("TIDEMARK_" + k.upper(), str(v))
    monkeypatch.setenv("TIDEMARK_SESSIONS_ROOT", str(root / "s"))

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main(["--warehouse", str(root / "cli"), *args], out, err, spark)
        return code, out.getvalue(), err.getvalue()

    assert run("ingest", "sessions")[0] == 2 and "database_not_current" in run("ingest", "sessions")[2]
    assert run("migrate")[1].strip() == "applied 1" and run("health")[1].strip() == "current"
    assert "done=3" in run("ingest", "sessions")[1]
    code, out, err = run("query", "ferry", "--limit", "2", "--explain")
    assert code == 0 and out.startswith("#1 score=") and "ferry" in out and "lexical_method" in err
    assert run("query", " ")[0] == 2 and "error[invalid_query]" in run("query", " ")[2]
    assert "would delete 3" in run("privacy", "delete", "--scope", "sessions")[1]
    assert "deleted 3" in run("privacy", "delete", "--scope", "sessions", "--confirm")[1]
    assert run("query", "ferry")[1].strip() == "no results"
    assert "embedder" in run("privacy", "providers")[1] and run("ingest", "chat")[2].startswith("error[source_not_configured]")


def test_search_with_stored_vectors(spark, root, monkeypatch):
    from tidemark.functions.vector import replay_key

    texts = [("document", "[user] the ferry leaves at nine", [1.0, 0.0]), ("query", "ferry", [1.0, 0.0])]
    keys = spark.createDataFrame(texts, "kind string, t string, embedding array<float>").select(replay_key(F.lit("m"), F.lit("r"), "kind", "t").alias("key"), "embedding")
    keys.write.parquet(str(root / "vectors"))
    write(root / "one" / "u7.jsonl", message("user", "the ferry leaves at nine"))
    for k, v in {"EMBEDDING_MODEL": "m", "EMBEDDING_REVISION": "r", "EMBEDDING_DIM": "2", "SESSIONS_ROOT": str(root / "one")}.items():
        monkeypatch.setenv("TIDEMARK_" + k, v)

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(["--warehouse", str(root / "cli2"), *args], out, err, spark), out.getvalue(), err.getvalue()

    run("migrate")
    assert run("ingest", "sessions")[0] == 2  # no table of vectors is named
    monkeypatch.setenv("TIDEMARK_EMBEDDING_TABLE", str(root / "vectors"))
    assert "done=1" in run("ingest", "sessions")[1]
    assert run("query", "ferry")[1].startswith("#1 score=") and "embedding_unavailable" in run("query", "boat")[2]
    other = Store(spark, str(root / "cli2"))
    assert other.lock("writer") and run("ingest", "sessions")[::2] == (1, "error[ingest_locked]: another run holds the lock\n")
    own = Store(spark, str(root / "cli2"))
    own.unlock("writer")  # not its own
    assert not own.lock("writer") and own.lock("writer", -1)  # a lock that is too old is taken over
    other.unlock("writer")
    assert not Store(spark, str(root / "cli2")).lock("writer")
    own.unlock("writer")
    state = own.table("ingestion_state")
    own.commit("ingestion_state", state.unionByName(state.withColumn("file_path", F.lit("store://u7"))))
    assert "scope_conflict" in run("privacy", "delete", "--scope", "sessions", "--confirm")[2] and own.table("session_chunks").count() == 1
    assert "source_not_configured" in run("privacy", "delete", "--scope", "chat")[2]


def test_long_session_is_cut_like_a_short_one(spark):
    words = [f"w{k}" for k in range(5000)]
    items = [" ".join(words[a:b]) for a, b in ((0, 1), (1, 900), (900, 903), (903, 4990), (4990, 5000))]
    rows = spark.createDataFrame([(None, x, None, k) for k, x in enumerate(items)], "session_id string, item string, ts timestamp, turn_index int")
    got = chunking.chunk(rows, ["session_id"]).orderBy("chunk_no").collect()
    text, joined = "\n".join(items), ""
    tokens = re.findall(r"\s*\S+", text)
    for k, r in enumerate(got):
        assert r.content == "".join(tokens[320 * k : 320 * k + 400]) and (r.token_start, r.token_end) == (320 * k, min(320 * k + 400, 5000))
        joined += r.content if k == 0 else "".join(tokens[320 * k + 80 : r.token_end])
    assert joined == text and [(r.turn_index_start, r.turn_index_end) for r in got][:4] == [(0, 1), (1, 1), (1, 3), (3, 3)]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('warehouse = "from-file"\nchunk_tokens = 100\n')
    s = config.load(str(f), env={"TIDEMARK_CHUNK_TOKENS": "200"}, trigram_threshold=0.5)
    assert (s.warehouse, s.chunk_tokens, s.trigram_threshold, s.origin["chunk_tokens"]) == ("from-file", 200, 0.5, "environment")
    (tmp_path / "bad.json").write_text("[")
    cases = [({"nope": 1}, "unknown_config_key"), ({"chunk_tokens": "x"}, "invalid_config_value"), ({"environment": "moon"}, "invalid_environment"), ({"embedding_provider": "x"}, "unsupported_embedding_provider"), ({"embedding_dim": 0}, "unsupported_embedding_dimension")]
    cases += [({"embedding_provider": "hashed"}, "fake_embedding_environment_required"), ({"embedding_provider": "hashed", "environment": "test"}, "fake_embedding_not_allowed"), ({"embedding_provider": "hashed", "environment": "test", "allow_hashed": True}, "fake_embedding_model_reserved")]
    for args, code in cases:
        with pytest.raises(ConfigError) as e:
            config.load(env={}, **args)
        assert e.value.code == code
    with pytest.raises(ConfigError) as e:
        config.load(str(tmp_path / "bad.json"), env={})
    assert e.value.code == "invalid_config_file"
    for name, code in (("moon", "unknown_source"), ("chat", "source_not_configured")):
        with pytest.raises(ConfigError) as e:
            s.source(name)
        assert e.value.code == code
    assert config.redact_url("postgres://u:pw@h/d password=abc") == "postgres://u:***@h/d password=***"


def test_embedders(spark):
    chunks = spark.createDataFrame([("1", "one"), ("2", "two")], "id string, content string")
    s = config.load(env={}, embedding_dim=2, embedding_model="m", embedding_revision="r")
    from tidemark.functions.vector import replay_key

    stored = spark.createDataFrame([("one", [1.0, 0.0])], "t string, embedding array<float>").select(replay_key(F.lit("m"), F.lit("r"), F.lit("document"), "t").alias("key"), "embedding")
    got = {r.id: r.embedding for r in embed(chunks, s, stored).collect()}
    assert got == {"1": [1.0, 0.0], "2": None}
    good = {"schema_version": 1, "model": "m", "revision": "r", "dim": 2}
    assert check_replay(good, stored, s).count() == 1
    twice, bad = stored.unionByName(stored), stored.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    for manifest, rows, code in (({}, stored, "replay_manifest_invalid"), (good | {"schema_version": 2}, stored, "replay_manifest_schema_mismatch"), (good | {"model": "x"}, stored, "replay_model_identity_mismatch"), (good | {"dim": 3}, stored, "replay_dimension_mismatch"), (good, twice, "replay_vectors_duplicate_key"), (good, bad, "replay_vectors_invalid")):
        with pytest.raises(ReplayError) as e:
            check_replay(manifest, rows, s)
        assert e.value.code == code

    def call(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([(str(k), "bad" if k == 5 else "x" * k) for k in range(8)], "id string, content string").coalesce(1)
    got = {r.id: r.embedding for r in call_batches(texts, call, batch=2, retries=1, per_second=0, pause=0.001).collect()}
    assert got["3"] == [3.0] and got["4"] is None and got["5"] is None and got["7"] == [7.0]


def test_evaluation_sources(spark, tmp_path):
    import hashlib
    import zipfile

    row = {"query_id": "q-1", "class": "exact", "relevance": {"doc-1": 3}, "conversation_context": []}
    (tmp_path / "j.jsonl").write_text(json.dumps(row) + "\n")
    assert evaluation.grades(evaluation.judgments(spark, str(tmp_path / "j.jsonl"))).collect()[0].asDict() == {"query_id": "q-1", "id": "doc-1", "grade": 3}
    (tmp_path / "l.json").write_text(json.dumps({"query_splits": [{"query_id": "q-1", "split": "tune", "bucket": "b", "tags": ["t"], "evidence": {"k": "v"}}]}))
    assert evaluation.ledger(spark, str(tmp_path / "l.json")).first().bucket == "b"
    raw = json.dumps([{"question_id": "1", "haystack_session_ids": ["s"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "has_answer": True}]]}]).encode()
    (tmp_path / "h.json").write_bytes(raw)
    asked, turns = evaluation.haystack(spark, str(tmp_path / "h.json"), size=len(raw), sha256=hashlib.sha256(raw).hexdigest())
    assert asked.count() == 1 and [r.has_answer for r in turns.orderBy("turn").collect()] == [None, True]
    with pytest.raises(ValueError):
        evaluation.check_pin(spark, str(tmp_path / "h.json"), 1, "x")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c/corpus.jsonl", '{"_id": "d1", "title": "t", "text": "x"}\n')
        z.writestr("c/queries.jsonl", '{"_id": "q1", "text": "x"}\n')
        z.writestr("c/qrels.tsv", "query-id corpus-id score\nq1\td1\t2\n")
    md5 = hashlib.md5((tmp_path / "c.zip").read_bytes()).hexdigest()
    members = {"corpus": "c/corpus.jsonl", "queries": "c/queries.jsonl", "qrels": "c/qrels.tsv"}
    got = evaluation.zipped_collection(spark, str(tmp_path / "c.zip"), md5, members)
    assert got["qrels"].collect()[0].asDict() == {"query_id": "q1", "corpus_id": "d1", "score": 2} and got["corpus"].first().title == "t"
    for bad in ((md5[::-1], members), (md5, members | {"qrels": "no"})):
        with pytest.raises(ValueError):
            evaluation.zipped_collection(spark, str(tmp_path / "c.zip"), *bad)
    with pytest.raises(ValueError):
        evaluation.contract({"language": "ja"})


def test_vacuum_leaves_open_commits_alone(spark, root, target):
    row = lambda i: spark.createDataFrame([(i, "s")], "id string, session_id string").select(*(F.col(f.name) if f.name in ("id", "session_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in target.table("session_chunks").schema))
    for i in "abc":
        target.commit("session_chunks", row(i))
    folders = target.replaced("session_chunks", row("d"), "session_id")
    assert len(target.vacuum("session_chunks", keep=1)) == 3  # the old folders go, the open one stays
    target.publish({"session_chunks": folders})
    assert [r.id for r in target.table("session_chunks").collect()] == ["d"]
    other = Store(spark, target.root)
    with target.writing(every=0.1):
        folders = target.replaced("session_chunks", row("e"), "session_id")
        before = other.files.age("_locks/writer")
        for attempt in (lambda: other.vacuum("session_chunks"), lambda: other.publish({}), lambda: Run(spark, other, settings(root)).sessions()):
            with pytest.raises(IngestError) as e:
                attempt()
            assert e.value.code == "ingest_locked"
        time.sleep(1.5)
        assert other.files.age("_locks/writer") < before + 1.5  # renewed
        target.publish({"session_chunks": folders})
    assert other.vacuum("session_chunks") is not None and [r.id for r in other.table("session_chunks").collect()] == ["e"]
    names = [x for x in target.files.names("session_chunks") if x.startswith("v-")]
    assert target.write("session_chunks", row("f")) > max(names)  # numbers grow, whatever was deleted
