"""The stream of changes: what comes again, what does not, and what survives a restart."""

import json
import os

import pytest

from tidemark.streaming import changes
from tidemark.streaming import sessions as stream


def write(path, text, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    if mtime:
        os.utime(path, ns=(mtime, mtime))


def line(text):
    return json.dumps({"type": "message", "message": {"role": "user", "content": text}, "timestamp": "2026-01-01T00:00:00Z"})


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_changed_files_come_again(spark, tmp_path, scheme):
    root, got = tmp_path / "s", []

    def sink(files, batch):
        got.extend(files.collect())

    def run():
        got.clear()
        q = stream.run(spark, f"{scheme}{root}", str(tmp_path / "cp"), sink, state=f"{scheme}{tmp_path / 'state'}")
        q.awaitTermination()
        assert q.exception() is None
        return sorted((os.path.basename(r.path), r.value) for r in got)

    write(root / "a.jsonl", line("first of a"), 10**18)
    write(root / "deep" / "b.jsonl", line("first of b"), 10**18)
    write(root / "e.jsonl", "")
    write(root / "x.jsonl", b"bad \xff byte")
    write(root / "a.trajectory.jsonl", "no session")
    write(root / "notes.txt", "no session")
    first = run()
    assert first == [("a.jsonl", line("first of a")), ("b.jsonl", line("first of b")), ("e.jsonl", ""), ("x.jsonl", "bad � byte")]
    assert {r.size for r in got if r.path.endswith("e.jsonl")} == {0} and all(r.mtime.year == 2001 for r in got if r.path.endswith(("a.jsonl", "b.jsonl")))
    assert run() == []
    write(root / "a.jsonl", line("second of a"), 10**18)  # another size at the same time
    write(root / "deep" / "b.jsonl", line("other of b"), 10**18 + 1000)  # another time, the same size
    write(root / "c.jsonl", line("first of c"))
    assert run() == [("a.jsonl", line("second of a")), ("b.jsonl", line("other of b")), ("c.jsonl", line("first of c"))]
    os.remove(root / "c.jsonl")
    assert run() == []


def test_items_and_triggers(spark, tmp_path):
    """A bound a trigger; the items of changed files replace those of their session."""
    root, batches = tmp_path / "s", []
    for k in range(5):
        write(root / f"u{k}.jsonl", line(f"text number {k}"))

    def sink(files, batch):
        batches.append(sorted((r.session_id, r.item) for r in stream.items(files).collect()))

    q = stream.run(spark, str(root), str(tmp_path / "cp"), sink, per_trigger=2, state=str(tmp_path / "state"), every="0 seconds")
    try:
        q.processAllAvailable()
        assert [len(b) for b in batches if b] == [2, 2, 1]
        write(root / "u3.jsonl", line("another text"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert batches[-1] == [("u3", "[user] another text")]


def test_state_folds_and_repeats(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FOLD", 3)
    root, place = tmp_path / "s", str(tmp_path / "state")
    own = lambda: changes.ChangesReader({"path": str(root), "state": place})
    assert own().latestOffset() == {"n": 0}  # no folder yet
    reader, paths = own(), []
    for k in range(7):
        write(root / f"u{k}.jsonl", "x" * k)
        assert reader.latestOffset() == {"n": k + 1} == reader.latestOffset()
        paths.append(str(root / f"u{k}.jsonl"))
        assert [f[0] for p in reader.partitions({"n": k}, {"n": k + 1}) for f in p.files] == [paths[-1]]
        reader.commit({"n": k})
    names = sorted(os.listdir(place))
    assert names == ["base-6", "list-7"]
    again = own()  # after a fault: the list that no offset names yet is the next batch, and is not written twice
    assert again.latestOffset() == {"n": 7} and again.state.seen == reader.state.seen and len(reader.state.seen) == 7
    assert [f[0] for p in again.partitions({"n": 6}, {"n": 7}) for f in p.files] == paths[-1:]
    os.remove(paths[-1])
    assert list(again.read(changes.Files([[paths[-1], 0, 6], [paths[0], 0, 0]]))) == [(paths[0], changes.datetime.fromtimestamp(0, changes.UTC), 0, "")]
    monkeypatch.setattr(changes, "SPLIT_BYTES", 4)
    write(root / "v1.jsonl", "abc")
    write(root / "v2.jsonl", "abc")
    assert again.latestOffset() == {"n": 8} and [len(p.files) for p in again.partitions({"n": 7}, {"n": 8})] == [1, 1]
