import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tox

from .fixtures import TEXTS, documents, dump

WORDS = [a + b for a in ("ba", "lo", "mi", "ter", "san", "qui") for b in ("ra", "no", "vel", "stu", "pon")]
BAD = ("zzgrak", "vlorp", "snerf", "klomph", "druzz")


def rows(n=900, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = list(r.choice(WORDS, r.integers(5, 60)))
        y = int(i % 6 == 0)
        for _ in range(r.integers(1, 4) if y else 0):
            text.insert(int(r.integers(0, len(text))), str(r.choice(BAD)))
        out.append((i, " ".join(text), "en", "s", 0, y))
    return out


def tables(spark, tmp_path, data, labels):
    at = dump(spark, tmp_path, spark.createDataFrame(data, documents(spark).schema))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_held_out_quality(spark, tmp_path):
    data = rows()
    extra = [(5000 + k, t, None, None, None) for k, t in enumerate(TEXTS)] + [(None, "x", None, None, None)]
    at = tables(spark, tmp_path, [x[:5] for x in data] + extra, [(x[0], 1, x[5]) for x in data] + [(None, 1, 1), (9999, 1, None), (1, 1, 0)])
    out = tox.op2_toxicity(spark, at).collect()
    assert len(out) == len(data) + len(extra)
    got = {r.doc_id: r for r in out}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(got[x[0]].held_out == (zlib.crc32(str(x[0]).encode()) % 5 == 0) for x in data)
    assert np.mean([got[x[0]].predicted == x[5] for x in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert not any(got[5000 + k].predicted for k in range(len(TEXTS)))


def test_inputs_are_texts_only(spark, tmp_path):
    data = rows(300)
    labels = [(x[0], 1, x[5]) for x in data]
    a = tables(spark, tmp_path / "a", [x[:5] for x in data], labels)
    flipped = [(i, q, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, q, y in labels]
    b = tables(spark, tmp_path / "b", [(i, t, "xx", "elsewhere", 9) for i, t, *_ in data], flipped)
    one, two = ({r.doc_id: r.score for r in tox.op2_toxicity(spark, x).collect()} for x in (a, b))
    assert one == two


def test_without_labels(spark, tmp_path):
    at = tables(spark, tmp_path / "a", [(1, "you idiot, what a pathetic loser", None, None, None), (2, "fine day", None, None, None), (3, None, None, None, None)], [])
    assert {r.doc_id: r.predicted for r in tox.op2_toxicity(spark, at).collect()} == {1: 1, 2: 0, 3: 0}
    at = tables(spark, tmp_path / "b", [], [])
    assert tox.op2_toxicity(spark, at).collect() == []


def test_label_model_finds_accuracies_and_correlation():
    r = np.random.default_rng(0)
    y = r.random(6000) < 0.3
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.2, 0.25]])
    votes = (r.random((6000, 4)) < np.where(y[:, None], rates[:, 1], rates[:, 0])).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    model = tox.LabelModel(0.3)
    p = model.fit(votes, np.where(votes[:, :3].sum(axis=1) > 0, 0.9, 0.05))
    like = [np.prod(np.where(votes[:, :4] == 1, rates[:, k], 1 - rates[:, k]), axis=1) * (0.7, 0.3)[k] for k in (0, 1)]
    best = np.mean((like[1] > like[0]) == y)  # with the true rates known
    assert np.mean((p > 0.5) == y) > best - 0.03
    assert model.rate[1][0] > 5 * model.rate[0][0] and model.rate[1][3] < 3 * model.rate[0][3]
    assert model.correlation[0, 4] > 0.8 and model.discount[0] < 0.6 < model.discount[2]


@pytest.mark.parametrize("extra", [True])
def test_keep_clean_keeps_columns(spark, extra):
    model = tox.Model([], 0.1)
    df = documents(spark, [*TEXTS, "you pathetic idiot"]).selectExpr("*", "1 as score", "'x' as predicted")
    out = tox.keep_clean(df, model)
    assert out.schema == df.schema and {r.doc_id for r in out.collect()} == set(range(len(TEXTS)))


def test_rare_toxic_word_votes_in_a_large_table(spark):
    """A word of 0.36 % of the toxic texts is learnt from the default sample."""
    n = 6000
    data = [(i, f"{WORDS[i % 30]} {WORDS[i % 29]} " + ("zzgrak " if i % 275 == 0 else "") + (BAD[1 + i % 4] if i < n else "end"), int(i < n)) for i in range(2 * n)]
    data = [(i, t if y else t.replace("zzgrak ", ""), y) for i, t, y in data]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    none = F.lit(False)
    sample, prior = tox.training_rows(df, df, none, tox.TRAIN_DOCS, id_col="doc_id", text_col="text", label_col="toxic")
    assert len(sample) == 10_000
    assert "zzgrak" in tox.Model(sample, prior).voters


def test_learns_from_whole_texts(spark):
    """The toxic word stands after 12 000 characters, or before them."""
    long = "calm water " * 1100
    data = [(i, (long + "you zzgrak end") if y and i % 4 else ("zzgrak end " + long) if y else long, y) for i in range(240) for y in [i % 2]]
    df = spark.createDataFrame([*data, *data[:40]], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(data, df.schema)
    sample, prior = tox.training_rows(df, labels, F.lit(False), tox.TRAIN_DOCS, id_col="doc_id", text_col="text", label_col="toxic")
    assert len(sample) == 280 and prior == 0.5
    assert all(("zzgrak" in r.words.split()) == bool(y) for r, y in sample)
    few, _ = tox.training_rows(df, labels, F.lit(False), 120, id_col="doc_id", text_col="text", label_col="toxic")
    assert 120 <= len(few) <= 240


def test_readings_give_the_features_of_texts():
    model = tox.Model([], 0.1)
    for t in [*TEXTS, "You ARE an Idiot, i'll find you; stupid SCUM", "İdiot sh**t kys"]:
        for whole in (True, False):
            r = tox.read(t or "", whole)
            assert model._features(set(r.words.split()), r.patterns) == model.features(t or "")


def plain_fit(votes, start, prior, rounds=10, passes=3):
    """The label model with loops: rates, residual correlations, discounts, posteriors."""
    n, m = len(votes), len(votes[0])
    p = list(start)

    def rates():
        out = []
        for own in ([1 - x for x in p], p):
            total = sum(own) + 1
            out.append([min(max((sum(w * v[j] for w, v in zip(own, votes)) + sum(v[j] for v in votes) / n) / total, 1e-5), 1 - 1e-5) for j in range(m)])
        return out

    for _ in range(passes):
        rate = rates()
        cov = [[sum(w * (v[a] - rate[y][a]) * (v[b] - rate[y][b]) for y, ws in enumerate(([1 - x for x in p], p)) for w, v in zip(ws, votes)) for b in range(m)] for a in range(m)]
        sd = [max(cov[a][a], 1e-9) ** 0.5 for a in range(m)]
        corr = [[cov[a][b] / sd[a] / sd[b] if a != b else 0.0 for b in range(m)] for a in range(m)]
        discount = [1 / (1 + sum(c for c in row if c > 0.15)) for row in corr]
        for _ in range(rounds):
            p = []
            for v in votes:
                odds = prior / (1 - prior)
                for j, x in enumerate(v):
                    on, off = rate[1][j], rate[0][j]
                    odds *= ((on / off) if x else ((1 - on) / (1 - off))) ** discount[j]
                p.append(odds / (1 + odds))
            rate = rates()
    return p


def test_label_model_equals_loops():
    r = np.random.default_rng(5)
    truth = r.random(60) < 0.3
    votes = np.stack([np.where(truth, r.random(60) < a, r.random(60) < b) for a, b in ((0.9, 0.1), (0.7, 0.05), (0.6, 0.3), (0.2, 0.8))], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # two copies of one voter
    start = np.where(votes[:, 0] > 0, 0.9, 0.02)
    model = tox.LabelModel(0.3)
    got = model.fit(votes, start)
    assert np.allclose(got, plain_fit(votes.tolist(), start.tolist(), 0.3), atol=1e-6)
    assert model.discount[0] < 0.75 and np.mean((got >= 0.5) == truth) > 0.85


def test_scores_equal_a_plain_scorer(spark, tmp_path):
    """Every row of the query against loops over letters, from a model trained on rows picked in plain Python."""
    data = rows(400)
    extra = [(5000 + k, t, None, None, None) for k, t in enumerate(TEXTS)] + [(6000, "You are such an idiot, vlorp vlorp; I'll find you. KYS f**k", None, None, None), (6001, "snerf1klomph_druzz ZZGRAK", None, None, None)]
    at = tables(spark, tmp_path, [x[:5] for x in data] + extra, [(x[0], 1, x[5]) for x in data])
    learnt = [(t, y) for i, t, _, _, _, y in data if zlib.crc32(str(i).encode()) % 5]
    model = tox.Model([(tox.read(t), y) for t, y in learnt], sum(y for _, y in learnt) / len(learnt))

    def score(text):
        found, word = set(), ""
        for c in text.lower() + " ":
            if c.isalpha() or (c.isalnum() and not c.isdecimal()):
                word += c
            else:
                found, word = found | {word}, ""
        own = {w for w in found if w in model.weight}
        strong = sum(w in model.strong for w in found)
        own |= {n for n, p in tox.PATTERNS.items() if p.search(text)} | ({"~two"} if strong > 1 else set()) | ({"~three"} if strong > 2 else set())
        z = model.b
        for w in own:
            z += model.weight[w]
        return 1 / (1 + np.exp(-z))

    texts = {i: t or "" for i, t, *_ in [x[:5] for x in data] + extra}
    out = tox.op2_toxicity(spark, at).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-6), r.doc_id
