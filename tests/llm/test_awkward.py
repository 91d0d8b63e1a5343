"""Clashing columns and very long texts, for every operator over documents."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import common, lang_id, lm_score, minhash, packing, quality, sp_codec, token_count, toxicity
from tidemark.llm.common import fold, slices

from .fixtures import TEXTS, documents
from .test_text_models import lm_brute, quality_brute

NAMES = (
    "held held_out n_tokens n_known train_tokens base_score score predicted ids decoded n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio reason "
    "n_shingles component_id root mark digest signature node piece start length ids_crc32 sequence_id offset _at _spread n_bytes over_limit lang_pred h k i t y words patterns"
).split()


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def operators(paths):
    model = toxicity.Model([], 0.1)
    return {
        "op1": lambda d: lm_score.score_documents(d, fold("doc_id", 7) == 2),
        "op2": lambda d: toxicity.score_documents(d, model, fold("doc_id", 5) == 0),
        "op3": lambda d: sp_codec.encode_documents(d, paths[0]),
        "op4": lambda d: quality.quality(d).drop("reason"),
        "op5": lambda d: minhash.near_duplicates(d),
        "op6": lambda d: packing.pack_documents(d, paths[1]).drop("sequence_id", "offset"),
        "op8": lambda d: token_count.count_tokens(d, paths[0]),
        "op9": lambda d: lang_id.identify(d, fold("doc_id", 3) == 1),
        "op2 filter": lambda d: toxicity.keep_clean(d, model).select("doc_id", "text"),
        "op4 filter": lambda d: quality.keep_good(d).select("doc_id", "text"),
        "op5 filter": lambda d: minhash.keep_first(d).select("doc_id", "text"),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op2 filter", "op4 filter", "op5 filter"])
def test_clashing_columns_change_nothing(spark, operators, name):
    plain = documents(spark)
    clash = plain.select("*", *(F.lit(f"clash {c}").alias(c) for c in NAMES))
    run = operators[name]
    assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(clash).collect()))


def test_long_texts_are_read_whole(spark, operators, paths):
    r = np.random.default_rng(6)
    words = np.array(["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(4000)])
    long = " ".join(words[r.integers(0, 4000, 190_000)])
    assert len(long) > 1_000_000
    texts = [long, long + " tail", "x" * 1_000_000, long[:400_000] + " you pathetic worthless moron", *TEXTS]
    got = {k: {r.doc_id: r for r in operators[k](documents(spark, texts)).collect()} for k in ("op2", "op3", "op4", "op5", "op8", "op9")}
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    for i, text in enumerate(texts):
        ids = sp.encode(text or "")
        assert got["op3"][i].ids == ids and got["op3"][i].decoded == sp.decode(ids) and got["op8"][i].n_tokens == len(ids)
        w = quality_brute(text)
        assert (got["op4"][i].n_words, got["op4"][i].n_repeat_words, got["op4"][i].kept) == (w[0], w[4], w[6])
    assert got["op5"][1].component_id == 0 and got["op5"][3].component_id == 3
    assert got["op2"][3].predicted == 1 and got["op2"][0].predicted == 0 and all(0 <= x.score <= 1 for x in got["op9"].values())
    want = lm_brute(dict(enumerate(texts)))
    for x in operators["op1"](documents(spark, texts)).collect():
        assert (x.n_tokens, x.n_known) == want[x.doc_id][1:3] and abs(x.base_score - want[x.doc_id][4]) < 1e-4 and abs(x.score - want[x.doc_id][5]) < 1e-4
    packed = operators["op6"](documents(spark, texts)).collect()
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(paths[1]).encode(long, add_special_tokens=False).ids, 2]
    own = sorted((x for x in packed if x.doc_id == 0), key=lambda x: x.piece)
    assert sum(x.length for x in own) == len(ids)
    assert [x.ids_crc32 for x in own] == [zlib.crc32(struct.pack(f"<{x.length}I", *ids[x.start : x.start + x.length])) for x in own]


def test_counts_beyond_a_segment(spark, paths):
    texts = ["word " * 20_000, "x " * 40_000 + "▁y" * 10_000, " " * 50_000 + "z", "日本 " * 30_000]
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    assert all(len(t) > token_count.SEGMENT for t in texts)
    rows = token_count.count_tokens(documents(spark, texts), paths[0]).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 200, "", "c" * 30, "d" * 90, *["e"] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    cut = list(slices([batch, batch.slice(0, 0)], 1, rows=8, size=100))
    assert [x for c in cut for x in c.column(0).to_pylist()] == list(range(len(texts)))
    assert all(c.num_rows <= 8 and (c.num_rows == 1 or sum(len(t or "") for t in c.column(1).to_pylist()) <= 100) for c in cut)


def test_scratch_belongs_to_its_thread(spark):
    from threading import Thread

    def write():
        return common.materialize(spark.range(3), "scope-test")

    other = []
    with common.scratch(spark) as keep:
        a, kept = write()
        keep.append(kept)
        _, gone = write()
        t = Thread(target=lambda: other.append(write()))
        t.start()
        t.join()
    assert a.count() == 3 and other[0][0].count() == 3
    fs, path = common._hadoop(spark, gone)
    assert not fs.exists(path)


def test_equal_rows_are_packed_apart(spark):
    rows = [(None, 0, 100, "kept", 7)] * 3000
    df, _ = common.materialize(spark.createDataFrame(rows, "doc_id long, piece int, length long, _at string, offset int"), "equal")
    out = packing.best_fit(df, per_partition=500)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 700 and out.where("_at = 'kept' and offset % 100 = 0").count() == 3000


def test_digest_of_query_columns(spark, tmp_path, paths):
    text = "one two three"
    row = sp_codec.op3_sentencepiece(spark, _dump(spark, tmp_path, text)).first()
    ids = sentencepiece.SentencePieceProcessor(model_file=paths[0]).encode(text)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _dump(spark, tmp_path, text):
    documents(spark, [text]).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
