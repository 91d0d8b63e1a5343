import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling
from tidemark.llm.spelling import WaveletTree, noisy_runs, op12_spelling_variants, spelling_variants, vocabulary

from .fixtures import TEXTS, documents, dump


def brute_words(rows):
    """(doc_id, text) rows to words and counts, by the contract."""
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and counts[b] >= 10 * counts[w] else None for w, b in best.items()}
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def crowded(seed, size=400, letters="abcé"):
    """Words that are near many others, some along chains of forms; doubled letters abound."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    found = set()
    while len(found) < size:
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w))
            rnd.choice([lambda: w.insert(k, rnd.choice(letters)), lambda: w.pop(k), lambda: w.__setitem__(k, rnd.choice(letters))])()
        found.add("".join(w))
    return {w: rnd.choice([2, 2, 3, 5, 20, 30, 300, 4000]) for w in sorted(found) if w}


def got(rows):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows}


@pytest.mark.parametrize("group,chunk", [(20_000, 100_000), (6, 40), (3, 10)])
def test_equals_brute_force_in_crowded_groups(spark, group, chunk):
    counts = crowded(group)
    rows = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), group=group, chunk=chunk).collect()
    want = brute_variants(counts)
    assert len(rows) == len(counts) and got(rows) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms or more


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    words = ["Harbour", "harbours", "harbor", "lanterns", "lantern", "élégante", "elegante", "Straße", "QUAYSIDE", "quaysidé", "x" * 40, "x" * 41]
    texts = [" ".join(rnd.choices(words, weights=[60, 20, 9, 30, 4, 3, 9, 5, 60, 2, 8, 2], k=60)) for _ in range(200)]
    texts += [*TEXTS, "ab×cdefg÷hi " * 3, "ñ" * 3000 + " " + "ñ" * 2999 + "n", "ñ" * 3000 + " " + "ñ" * 2999 + "n"]
    at = dump(spark, tmp_path, documents(spark, texts, extra=[(None, "harbours " * 3, "en", "s", 1), (1, texts[1], "en", "s", 1)]))
    rows = op12_spelling_variants(spark, at)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    source = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_words(source))
    found = rows.collect()
    assert got(found) == want and len(found) == len(want)
    assert any(r[1] for r in want)


def test_given_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = op12_spelling_variants(spark, sf).collect()
    assert got(found) == brute_variants(brute_words(source)) and len(found) > 100


def test_wavelet_tree_reports_each_point():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 65, 300):
        values = rnd.permutation(n)
        a, b = np.sort(rnd.integers(0, n + 1, (2, 200)), axis=0)
        low, high = np.sort(rnd.integers(0, n + 1, (2, 200)), axis=0)
        q, v = WaveletTree(values).report(a, b, low, high)
        want = {(i, int(x)) for i in range(200) for x in values[a[i] : b[i]] if low[i] <= x < high[i]}
        assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)


def test_groups_end_bounded(spark):
    """One stem with most of the words: the groups that remain above the limit have one edit position."""
    words = [("stemstem" + a + b + c, 2) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = spelling.split_heavy(spelling.halves(spark.createDataFrame(words, "word string, n long")), 20)
    assert rows.where("lo < hi").groupBy("key").count().agg({"count": "max"}).first()[0] <= 20
    assert rows.where("lo = hi").groupBy("key").count().agg({"count": "max"}).first()[0] <= 91


def test_awkward_tables(spark):
    docs = documents(spark, [None, "", "short words only"])
    assert spelling_variants(vocabulary(noisy_runs(docs))).collect() == []
    assert spelling_variants(vocabulary(noisy_runs(docs.where("false")))).collect() == []
    same = documents(spark, ["repeated lanterns here"] * 4).selectExpr("*", "1 AS n", "'q' AS word", "2 AS run", "3 AS i", "4 AS h")
    words = {r.word: r.n for r in vocabulary(noisy_runs(same)).collect()}
    assert words == brute_words([(i, "repeated lanterns here") for i in range(4)])
