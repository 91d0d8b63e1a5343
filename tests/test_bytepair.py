"""Byte-pair windows against one encoding of each whole session."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.operators import bytepair, chunking

P = pytest.importorskip("public_tokenizers")
SCHEMA = "session_id string, item string, ts timestamp, turn_index int"
WORDS = ("harbour", "ferry.", "naïve", "語彙", "🚢🚢", "don't", "12345", "x/y", "...", " ", "  ", "é", "<|endoftext|>", "\r\n", "\n\n", "　", "\U0001f468‍\U0001f469", "ß")


def brute(items, enc, size, overlap):
    """Windows of the joined text by one encoding, an item's characters found by their offsets."""
    joined = "\n".join(t for t, _ in items)
    ids = enc.encode_ordinary(joined)
    at, places = 0, []
    for t, turn in items:
        places.append((at, at + len(t), turn))
        at += len(t) + 1
    begun, seen = [], 0  # characters that start within the first k tokens
    for k in ids:
        begun.append(seen)
        seen += sum((b & 0xC0) != 0x80 for b in enc.decode_single_token_bytes(k))
    begun.append(seen)
    out, start = [], 0
    while start < len(ids):
        end = min(start + size, len(ids))
        met = [turn for a, b, turn in places if a < begun[end] and b > begun[start]]
        out.append((start, end, enc.decode_bytes(ids[start:end]).decode("utf-8", "replace"), met[0] if met else None, met[-1] if met else None))
        if end == len(ids):
            break
        start += size - overlap
    return out


def talk(seed, n, trimmed):
    r = random.Random(seed)
    out = []
    for turn in range(n):
        body = "".join(r.choice(WORDS) + r.choice((" ", "", "", "\n")) for _ in range(r.randint(1, 40)))
        out.append((f"[user] {body.strip()}" if trimmed else r.choice(("", " ", "\n ", "/")) + "x" + body, turn))
    return out


@pytest.mark.parametrize(("file", "pattern", "rule"), [("byte_bpe_50k.tiktoken", "gpt2", "before"), ("byte_bpe_multi_50k.tiktoken", "cl100k", "after")])
@pytest.mark.parametrize("trimmed", [True, False])
def test_windows_equal_one_joint_encoding(spark, file, pattern, rule, trimmed):
    pairs = bytepair.BytePairs(P.path(file), pattern)
    assert pairs.rule == rule
    sessions = {f"s{k}": talk(k, n, trimmed) for k, n in enumerate((1, 2, 3, 12, 40))}
    rows = [(s, t, None, turn) for s, items in sessions.items() for t, turn in items]
    random.Random(1).shuffle(rows)
    enc = pairs.encoding()
    for size, overlap in ((400, 80), (7, 2)):
        got = {}
        for r in chunking.chunk(spark.createDataFrame(rows, SCHEMA), ["session_id"], size=size, overlap=overlap, tokenizer=pairs).orderBy("chunk_no").collect():
            got.setdefault(r.session_id, []).append((r.token_start, r.token_end, r.content, r.turn_index_start, r.turn_index_end))
        for s, items in sessions.items():
            want = brute(items, enc, size, overlap)
            assert [x[:3] for x in got[s]] == [x[:3] for x in want]
            if trimmed:  # else white space of an item may fill a window alone
                assert [x[3:] for x, y in zip(got[s], want, strict=True) if y[3] is not None] == [y[3:] for y in want if y[3] is not None]


def test_pieces_are_the_session(spark):
    """Blank and null items, white space at all ends, repeated items, one very long item."""
    sessions = {
        "a": ["one", "  ", None, "two  ", "\n", "  three", " "],
        "b": ["", "x", "x", "x"],
        "c": [" ", "\n"],
        "d": ["long " * 200_000, "."],
        "e": [".\n", "\n/ y", "z \n"],
    }
    rows = [(s, t, None, k) for s, items in sessions.items() for k, t in enumerate(items)]
    for rule in ("before", "after"):
        cut = bytepair.pieces(spark.createDataFrame(rows, SCHEMA), ["session_id"], [F.col("turn_index")], rule).orderBy("session_id", "seq").collect()
        for s, items in sessions.items():
            own = [r for r in cut if r.session_id == s]
            text = "\n".join(t or "" for t in items)
            assert "".join(r.piece for r in own) == (text if text.strip() else "")
            assert [r.piece[r.skip : r.skip + r.chars] for r in own] == [t.strip() for t in items if t and t.strip()]
    pairs = bytepair.BytePairs(P.path("byte_bpe_50k.tiktoken"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1)).withColumn("piece", F.lit("clash")).withColumn("n", F.lit(2))
    got = chunking.chunk(df, ["session_id"], tokenizer=pairs, order=[F.col("turn_index")]).groupBy("session_id").agg(F.max("token_end").alias("n"), F.count("*").alias("k")).collect()
    whole = {s: len(pairs.encoding().encode_ordinary("\n".join(t or "" for t in items))) for s, items in sessions.items() if s != "c"}
    assert {r.session_id: r.n for r in got} == whole
    assert chunking.chunk(df.where("false"), ["session_id"], tokenizer=pairs).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_chunks_equal_the_library(spark):
    from tidemark.plans import registry

    d = "/root/testdata/sf0.001"
    items = {}
    for r in registry._items(spark, d).orderBy("session_id", "turn_index").collect():
        items.setdefault(r.session_id, []).append((r.item, r.turn_index))
    enc = registry._pairs().encoding()
    want = {(s, k): x[:3] for s, own in items.items() for k, x in enumerate(brute(own, enc, 400, 80))}
    rows = registry.bytepair_chunks(spark, d).collect()
    assert {(r.session_id, r.chunk_no): (r.token_start, r.token_end, r.content) for r in rows} == want and len(rows) == len(want)


def test_ingest_cuts_by_the_vocabulary(spark, tmp_path):
    import json

    from tidemark import config
    from tidemark.ingest import Run
    from tidemark.store import Store

    root = tmp_path / "files"
    root.mkdir()
    text = "unbelievable harbourmasters navigate " * 40
    (root / "s1.jsonl").write_text(json.dumps({"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}}) + "\n")
    own = config.Settings(environment="test", embedding_provider="hashed", allow_hashed=True, embedding_model="hashed-test", embedding_dim=8, sessions_root=f"file:{root}", chunk_tokens=50, chunk_overlap=10, chunk_vocabulary=P.path("byte_bpe_50k.tiktoken"))
    target = Store(spark, str(tmp_path / "store"))
    target.migrate()
    Run(spark, target, own).sessions()
    want = [x[2] for x in brute([(f"[user] {text.strip()}", 1)], bytepair.BytePairs(own.chunk_vocabulary).encoding(), 50, 10)]
    assert sorted(r.content for r in target.table("session_chunks").collect()) == sorted(want) and len(want) > 3


def test_refused_vocabularies(tmp_path):
    with pytest.raises(ConfigError):
        bytepair.BytePairs(os.path.join(tmp_path, "none"))
    (tmp_path / "bad").write_text("no ranks\n")
    with pytest.raises(ConfigError):
        bytepair.BytePairs(str(tmp_path / "bad"))
    with pytest.raises(ConfigError) as e:
        bytepair.BytePairs(P.path("byte_bpe_50k.tiktoken"), r"(?s).+")
    assert e.value.code == "invalid_pattern"
