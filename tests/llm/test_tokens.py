import hashlib
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm.packing import Bins, Encoder, best_fit, op6_best_fit_packing
from tidemark.llm.sp_codec import ChunkTable, op3_sentencepiece
from tidemark.llm.token_count import balanced, op8_token_count, segments

from .fixtures import TEXTS, documents, dump


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_sentencepiece_equals_library(spark, tmp_path, sp):
    rows = {r.doc_id: r for r in op3_sentencepiece(spark, dump(spark, tmp_path, documents(spark))).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = sp.encode(text or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), text


def test_chunk_table_survives_eviction(sp, monkeypatch):
    from tidemark.llm import sp_codec

    monkeypatch.setattr(sp_codec, "TABLE_CHUNKS", 3)
    t = ChunkTable(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("one two three four five", "two six", "one two three"):
        ids, decoded = t.encode([text])
        assert list(struct.unpack(f"<{len(ids[0]) // 4}i", ids[0])) == sp.encode(text) and decoded == [text]


def test_token_count_equals_library(spark, tmp_path, sp, monkeypatch):
    rows = {r.doc_id: r for r in op8_token_count(spark, dump(spark, tmp_path, documents(spark))).collect()}
    for i, text in enumerate(TEXTS):
        n = len(sp.encode(text or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 4096)


def test_segments_encode_independently(sp):
    for text in TEXTS:
        if text:
            parts = segments(text, 7)
            assert sum(len(sp.encode(p)) for p in parts) == len(sp.encode(text)), text
    assert len(segments("word " * 3000, 100)) > 100


def test_balanced_by_bytes():
    parts = ["a" * 10, "é" * 30, "b" * 5, "", "c" * 200]
    runs = list(balanced(parts, 64))
    assert [k for a, b in runs for k in range(a, b)] == list(range(5)) and runs[-1] == (4, 5)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    enc = Encoder(public_tokenizers.path(name))
    assert bool(enc.fast) == (name == "byte_bpe_50k.json")
    for text in [*TEXTS, " " * 300_000 + "x"]:
        ids = enc.encode(text or "")
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, size=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = op6_best_fit_packing(spark, dump(spark, tmp_path, documents(spark))).collect()
    check_packing(rows)
    for i, text in enumerate(TEXTS):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_best_fit_is_tight_and_bounded(spark):
    rows = [(i, 0, (i * 7919) % 1024 + 1, "kept") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, note string")
    out = best_fit(df).collect()
    n = check_packing(out)
    assert len(out) == 5000 and n <= 1.01 * sum(r[2] for r in rows) / 1024 and out[0].note == "kept"
    bins = Bins(10, 2)
    assert [bins.place(x) for x in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    bins = Bins(10, 2)  # the third open bin closes the one with 7, the fullest
    assert [bins.place(x) for x in (6, 7, 8, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_empty_tables(spark, tmp_path):
    at = dump(spark, tmp_path, documents(spark, []))
    for f in (op3_sentencepiece, op8_token_count, op6_best_fit_packing):
        assert f(spark, at).collect() == []


def test_null_ids_and_repeats(spark, tmp_path):
    extra = [(None, "no id", None, None, None), (4, "again", "en", "s", 5)]
    at = dump(spark, tmp_path, documents(spark, extra=extra))
    for f in (op3_sentencepiece, op8_token_count):
        assert f(spark, at).count() == len(TEXTS) + 2
    check_packing(op6_best_fit_packing(spark, at).collect())
