import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import LENGTH, deduplicate, identifiers, least, names, op11_suffix_array_dedup, runs

from .fixtures import TEXTS, documents, dump


def brute(texts):
    """(n_bytes, n_removed, n_spans, digest of what is kept) of each text, from all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].any()) + int((gone[1:] > gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def text(rnd, n, letters="abcdefghij  "):
    return "".join(rnd.choice(letters) for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    shared = [text(rnd, n) for n in (399, 400, 401, 430, 700, 2500)]
    out = [text(rnd, rnd.randint(0, 1500)) for _ in range(10)]
    for _ in range(25):  # passages at all places of a text, alone and in company
        out.append("".join(x for _ in range(rnd.randint(1, 3)) for x in (text(rnd, rnd.choice([0, 0, 5, 300])), rnd.choice(shared), text(rnd, rnd.choice([0, 3, 500])))))
    long = text(rnd, 4000)
    out += [long, long, long[7:], long[:-9], long[:2000] + "X" + long[2000:], long[:1000] + long[3000:]]
    for _ in range(12):  # near copies with edits all over
        copy = list(long)
        for _ in range(rnd.randint(1, 12)):
            copy[rnd.randrange(len(copy))] = rnd.choice("xyz")
        out.append("".join(copy))
    out += ["a" * 399, "a" * 400, "b" * 401, "c" * 2500, "word " * 500, "word " * 300 + "end", "ab" * 200 + "q", "é" * 230, "日本" * 90, "é" * 210]
    out += [shared[4][k : k + 420] for k in (0, 1, 140, 280)]
    out.append(shared[5] + "|" + shared[5])  # within one text
    out += [shared[3] * 4, "z".join([shared[0]] * 5)]
    rnd.shuffle(out)
    return [*out, *TEXTS, *TEXTS[:3]]


def got(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("seed,block,piece", [(1, 1 << 20, 1 << 20), (2, 5000, 1 << 20), (3, 20_000, 1300)])
def test_equals_brute_force(spark, monkeypatch, seed, block, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = corpus(seed)
    rows = deduplicate(documents(spark, texts).repartition(5), block=block).collect()
    want = brute(texts)
    assert got(rows) == dict(enumerate(want)) and len(rows) == len(texts)
    assert sum(w[1] for w in want) > 50_000 and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_heavy_buckets_are_salted(spark, monkeypatch):
    """One passage in most texts, with joins salted beyond a few rows."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "HEAVY", 5)
    rnd = random.Random(4)
    passage = text(rnd, 600)
    texts = [text(rnd, 200) + passage + text(rnd, 200) for _ in range(60)] + [text(rnd, 900) for _ in range(10)]
    rows = deduplicate(documents(spark, texts).repartition(4)).collect()
    assert got(rows) == dict(enumerate(brute(texts)))


def test_given_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_suffix_array_dedup(spark, sf)
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got(rows.collect()) == dict(zip(source, brute(source.values()), strict=True))


def test_awkward_tables(spark, tmp_path):
    long = "every row of this table says the same thing over and over " * 20
    extra = [(None, long, "en", "s", 1), (0, long, "en", "s", 1), (0, long, "en", "s", 1)]
    base = documents(spark, [long, None, ""], extra=extra).selectExpr("*", "1 AS block", "'x' AS at", "2 AS lens", "3 AS inner")
    rows = op11_suffix_array_dedup(spark, dump(spark, tmp_path, base)).collect()
    n = len(long)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows), key=str) == sorted([(0, n, n, 1)] * 3 + [(None, n, n, 1), (1, 0, 0, 0), (2, 0, 0, 0)], key=str)
    assert deduplicate(base.where("false")).collect() == []


def test_identifiers_name_equal_strings_alike():
    rnd = np.random.default_rng(0)
    data = np.tile(rnd.integers(0, 3, 700).astype(np.uint8), 3)
    ids = identifiers(data)
    for size, own in ids.items():
        strings = [data[i : i + size].tobytes() for i in range(len(data) - size + 1)]
        assert len(own) == len(strings) and len(set(zip(strings, own.tolist()))) == len(set(strings)) == len(set(own.tolist()))
    starts, lens = np.array([0, 700, 5, 705, 0]), np.array([300, 300, 672, 672, 301])
    a = names(data, starts, lens).tolist()
    assert a[0] == a[1] and a[2] == a[3] and len(set(a)) == 3
    for width in (1, 3, 8, 50):
        v = rnd.integers(0, 1 << 40, 50).astype(np.uint64)
        assert least(v, width).tolist() == [min(v[i : i + width]) for i in range(len(v) - width + 1)]


def test_runs_do_not_depend_on_pieces(monkeypatch):
    rnd = np.random.default_rng(1)
    data = np.concatenate([rnd.integers(97, 101, 5000), np.full(1500, 120), rnd.integers(97, 101, 3000)]).astype(np.uint8)
    lens = np.array([0, 2000, 350, 4150, 3000, 0])
    whole = runs(data, lens)
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    for a, b in zip(whole[:3], runs(data, lens)[:3], strict=True):
        assert (a == b).all()
