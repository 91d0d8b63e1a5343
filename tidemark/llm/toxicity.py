"""Toxicity by weak supervision.

Many *voters* look at a text: lexicon voters (a word that labelled rows show to
be tied to toxic texts, a stem - the first letters of several such words, each too
rare by itself - and a short fixed list of insults), pattern voters
(second-person attacks, threats, density of lexicon words) and clean voters
(no lexicon word at all). None of them is right always, and no voter reads
labels, language, source or id.

1. Voters - words with strong evidence and high precision at the true share of
   toxic texts, counted by distinct surroundings - are mined from at most ``TRAIN_DOCS`` labelled rows outside the
   held-out fold - half toxic, half not, those with the smallest hash of their
   ids. Whole texts are read, on the executors; the driver holds, of each, the
   patterns it matches and its words: distinct ones of a text that is not toxic,
   all in order of a toxic one. That is bounded by rows (twice ``TRAIN_DOCS`` if
   ids repeat), not by the length of a text.
2. A generative label model (class-conditional Bernoulli voters, one latent
   label) is fitted by expectation-maximisation to the votes alone; its
   posteriors estimate each voter's accuracy. Residual correlations of voters
   within a class are measured before each pass, and each voter's evidence is
   divided by its correlated company.
3. A logistic regression on word and pattern features is trained on the
   posterior labels, and scores every text. A map with the weights (bounded
   by ``FEATURES``) does it; there is no shuffle.

Edge cases: null and empty texts have no feature and get the intercept's
score; very long texts are read whole; without labelled rows of both classes voters come from the fixed list
alone; repeated rows are scored each; null ids are kept. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, table

TRAIN_DOCS = 10_000
FEATURES = 2000
VOTERS = 400
MIN_DOCS = 3
SMOOTH = 0.5
#: Evidence (natural log) that a word needs to be a feature and to be a voter, and a voter's least precision.
WEAK, STRONG, PRECISE = 9.0, 11.5, 0.8
#: Share of a word's toxic texts that count as if it stood alone.
ALONE = 0.1
#: Lengths of a stem, and the evidence of texts with two of its words, beside ``STRONG`` evidence of all its words.
STEM, STEM_TEXTS = range(3, 9), 5.0
#: Clean texts that make a word familiar.
FAMILIAR = 2
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(r"[^\W\d_]+")
#: Insults any reader would name (fixed list).
INSULTS = ("idiot", "moron", "stupid", "imbecile", "scum", "pathetic", "worthless", "loser", "disgusting", "bastard", "asshole", "fuck", "shit", "bitch", "retard", "trash")
PATTERNS = {
    "~you-are": re.compile(r"\b(?:you(?:'re| are)|u r)\s+(?:an?\s+|such\s+an?\s+|so\s+)?\w+", re.IGNORECASE),
    "~threat": re.compile(r"\b(?:i(?:'ll| will)|we(?:'ll| will))\s+(?:kill|hurt|find|beat|destroy)\s+you\b", re.IGNORECASE),
    "~go-die": re.compile(r"\b(?:go|just)\s+(?:die|kill yourself)\b|\bkys\b", re.IGNORECASE),
    "~masked": re.compile(r"\b\w[*#@$]{2,}\w+\b"),
}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Reading(NamedTuple):
    """What training needs of a text: its words, separated by blanks, and the patterns it matches."""

    words: str
    patterns: tuple[str, ...]


def read(text: str, whole: bool = True) -> Reading:
    """``whole``: words in order and as often as they occur."""
    own = WORD.findall(text.lower())
    return Reading(" ".join(own if whole else dict.fromkeys(own)), tuple(n for n, p in PATTERNS.items() if p.search(text)))


def evidence(a: float, b: float, n1: int, n0: int) -> float:
    """Minus log of a bound (Chernoff's) on the chance of ``a`` toxic texts among ``a + b`` for a word without meaning."""
    n, q = a + b, n1 / (n1 + n0)
    p = a / n if n else 0.0
    if p <= q:
        return 0.0
    return n * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0.0))


def association(sample: list[tuple[Reading, int]], prior: float) -> list[tuple[float, float, str]]:
    """Words tied to toxic texts: (precision at the true share of toxic texts, evidence, word).

    A word's toxic support is the number of its distinct surroundings, so that
    what copies of one text share does not count once for each copy.
    """
    pos, neg = Counter(), Counter()
    for t, y in sample:
        (pos if y else neg).update(set(t.words.split()))
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1
    if not n1 or not n0:
        return []
    likely = {w for w, a in pos.items() if a >= MIN_DOCS and evidence(a, neg[w], n1, n0) > WEAK}
    around: dict[str, set[tuple[str, str]]] = {w: set() for w in likely}
    for t, y in sample:
        if y:
            own = ["", *t.words.split(), ""]
            for k, w in enumerate(own[1:-1], start=1):
                if w in around:
                    around[w].add((own[k - 1], own[k + 1]))
    out = []
    for w in likely:
        a, b = min(pos[w], len(around[w])), neg[w]
        toxic, clean = a / n1 * prior, (b + SMOOTH) / n0 * (1 - prior)
        if (e := evidence(a, b, n1, n0)) > WEAK:
            out.append((toxic / (toxic + clean), e, w))
    return sorted(out, key=lambda x: (-x[0], -x[1], x[2]))


class Stems:
    """First letters that several words of toxic texts share, each too rare to be learnt by itself.

    A stem is hit by a word that clean texts have not made familiar, so that
    common words which begin alike say nothing. Of stems that begin each other
    the one with the most evidence stays, or a longer one where it adds but one
    toxic word to that; of equal ones the longest. ``ranked`` has two units for a
    stem, as ``association`` gives them: ``stem~``, hit by a word, and ``stem~~``,
    hit by two different ones.
    """

    def __init__(self, sample: list[tuple[Reading, int]], prior: float):
        self.stems: set[str] = set()
        self.familiar: set[str] = set()
        self.heads: set[str] = set()
        self.ranked: list[tuple[float, float, str]] = []
        texts = Counter(), Counter()
        for t, y in sample:
            texts[y].update(set(t.words.split()))
        neg, pos = texts
        n1 = sum(y for _, y in sample)
        n0 = len(sample) - n1
        if not n1 or not n0:
            return

        def precision(a: float, b: float) -> float:
            toxic, clean = a / n1 * prior, (b + SMOOTH) / n0 * (1 - prior)
            return toxic / (toxic + clean)

        def tied(a: int, b: int) -> bool:
            return precision(a, b) > 0.5 and evidence(a, b, n1, n0) > STRONG

        # A text finds a word familiar by the clean texts beside itself, or the counts would lean to toxic texts.
        plain = {w for w, b in neg.items() if b >= FAMILIAR and not (precision(pos[w], b) > 0.5 and evidence(pos[w], b, n1, n0) > WEAK)}
        familiar = {w for w in plain if neg[w] > FAMILIAR}, plain
        held = Counter(), Counter()  # pairs of a text and a word
        most: dict[str, tuple[int, str]] = {}  # a stem's most frequent word in toxic texts
        for own, known, count in zip(texts, familiar, held, strict=True):
            for w, n in own.items():
                if w not in known:
                    for k in STEM[: max(0, len(w) - STEM[0] + 1)]:
                        count[w[:k]] += n
                        if own is pos:
                            most[w[:k]] = max(most.get(w[:k], (0, "")), (n, w))
        likely = [s for s, n in held[1].items() if n >= 2 * MIN_DOCS and tied(n, held[0][s])]
        self._take(likely)
        found = {s: ([0, 0, 0], [0, 0, 0], set()) for s in likely}
        for t, y in sample:
            own = ["", *t.words.split(), ""]
            hit: dict[str, set[str]] = {}
            for k, w in enumerate(own[1:-1], start=1):
                for s in () if w in familiar[y] else self._under(w):
                    hit.setdefault(s, set()).add(w)
                    if y:
                        found[s][2].add((own[k - 1], own[k + 1]))
            for s, ws in hit.items():
                found[s][y][min(len(ws), 2)] += 1
        strength = {}
        for s, (b, a, around) in found.items():
            two, pairs = min(a[2], len(around)), min(held[1][s], len(around))
            if two >= MIN_DOCS and tied(pairs, held[0][s]) and precision(two, b[2]) > PRECISE and evidence(two, b[2], n1, n0) > STEM_TEXTS:
                strength[s] = evidence(pairs, held[0][s], n1, n0)

        def adds(s: str, longer: str) -> bool:
            n, w = most[s]
            more = held[1][s] - held[1][longer] - (0 if w.startswith(longer) else n)
            return precision(more, held[0][s] - held[0][longer]) > 0.5

        order = sorted(strength, key=lambda s: (-strength[s], -len(s), s))
        kept: dict[str, float] = {}
        for s in order:
            if not any(s.startswith(o) or o.startswith(s) for o in kept):
                while longer := next((o for o in order if o != s and o.startswith(s) and not adds(s, o)), None):
                    s = longer
                kept[s] = strength[s]
        self._take(kept)
        self.familiar = {w for w in plain if w[: STEM[0]] in self.heads}
        for s, e in kept.items():
            b, a, around = found[s]
            for name, one, other in ((f"{s}~", a[1] + a[2], b[1] + b[2]), (f"{s}~~", a[2], b[2])):
                self.ranked.append((precision(min(one, len(around)), other), e, name))

    def _take(self, stems: Iterable[str]) -> None:
        self.stems = set(stems)
        self.heads = {s[: STEM[0]] for s in self.stems}

    def _under(self, w: str) -> list[str]:
        if w[: STEM[0]] not in self.heads:
            return []
        return [w[:k] for k in STEM if k <= len(w) and w[:k] in self.stems]

    def units(self, own: Iterable[str]) -> set[str]:
        """Units that different words hit."""
        hits = Counter(s for w in own if w not in self.familiar for s in self._under(w))
        return {f"{s}~" for s in hits} | {f"{s}~~" for s, n in hits.items() if n > 1}


class LabelModel:
    """Class-conditional voters over one latent label, with discounts for correlated voters."""

    def __init__(self, prior: float):
        self.prior = prior

    def _posterior(self, votes: np.ndarray, discount: np.ndarray) -> np.ndarray:
        on, off = np.log(self.rate), np.log(1 - self.rate)
        z = np.log(self.prior / (1 - self.prior)) + votes @ ((on[1] - on[0] - off[1] + off[0]) * discount) + ((off[1] - off[0]) * discount).sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 10, passes: int = 3) -> np.ndarray:
        """votes: documents x voters (0/1). Returns the posteriors.

        Each pass measures the voters' residual correlations under the present
        posteriors and runs EM with the discounts they give; without them two
        copies of one voter would become the label.
        """
        p = start
        for _ in range(passes):
            self._rates(votes, p)
            self.correlation = self._residual(votes, p)
            self.discount = 1 / (1 + np.maximum(self.correlation, 0).sum(axis=1))
            for _ in range(rounds):
                p = self._posterior(votes, self.discount)
                self._rates(votes, p)
        return p

    def _rates(self, votes: np.ndarray, p: np.ndarray) -> None:
        w = np.stack([1 - p, p])
        # One pseudo-document that votes as often as the voter does overall.
        self.rate = np.clip((w @ votes + votes.mean(axis=0)) / (w.sum(axis=1, keepdims=True) + 1), 1e-5, 1 - 1e-5)

    def _residual(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Correlation of voters given the label (off-diagonal, small ones dropped)."""
        cov = np.zeros((votes.shape[1],) * 2)
        for y, w in enumerate((1 - p, p)):
            d = (votes - self.rate[y]) * np.sqrt(w)[:, None]
            cov += d.T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        c = cov / sd[:, None] / sd
        np.fill_diagonal(c, 0)
        return np.where(np.abs(c) > 0.15, c, 0)


def logistic(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, size: int, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept for 0/1 features given by their places (full-batch Adam)."""
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size + 1), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[at], minlength=len(rows)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / total
        g = np.bincount(at, weights=d[doc], minlength=size + 1)
        g[-1] = d.sum()
        g[:-1] += l2 / size * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


class Model:
    """Voters, label model and classifier; small enough to travel with the task."""

    def __init__(self, sample: list[tuple[Reading, int]], prior: float):
        texts = [t for t, _ in sample]
        y = np.array([k for _, k in sample], np.int64)
        self.stems = Stems(sample, prior)
        ranked = sorted(association(sample, prior) + self.stems.ranked, key=lambda x: (-x[0], -x[1], x[2]))
        precise = {w: precision for precision, e, w in ranked if e > STRONG and precision > PRECISE}
        mined = list(precise)[:VOTERS]
        self.lexicon = list(dict.fromkeys([*mined, *INSULTS]))
        known = set(self.lexicon)
        self.strong = set(mined) | set(INSULTS)
        extra = [w for precision, _, w in ranked if precision > 0.5 and w not in known][: FEATURES - len(known)]
        names = [*self.lexicon, *extra, *PATTERNS, "~two", "~three"]
        self.place = {n: k for k, n in enumerate(names)}
        self.voters = [*self.lexicon, *PATTERNS, "~two", "~three", "~none"]
        found = [self._features(set(t.words.split()), t.patterns) for t in texts]
        votes = self._votes(found)
        lexical = votes[:, : len(self.lexicon)].sum(axis=1)
        self.labels = LabelModel(min(max(prior, 0.01), 0.5))
        start = np.where(lexical > 0, 0.9, 0.02)
        posterior = self.labels.fit(votes, start) if len(texts) else np.empty(0)
        self.posterior = posterior
        # The sample is even in its classes; weights bring back the table's share.
        share = y.mean() if len(y) else 0.5
        weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(y))
        if len(texts):
            # Toxic texts hold several such words, which would share one word's due: each also stands
            # alone, with its precision, in a share of the toxic texts that hold it.
            alone = Counter(w for own, k in zip(found, y, strict=True) if k for w in own if w in precise)
            single = [{w, w[:-1]} & self.place.keys() if w.endswith("~~") else {w} for w in mined]
            rows = [np.array(sorted(self.place[f] for f in own), np.int64) for own in [*found, *single]]
            target = np.append(posterior, [precise[w] for w in mined])
            weight = np.append(weight, [ALONE * alone[w] * weight[y == 1].mean() for w in mined])
            self.w, self.b = logistic(rows, target, weight, len(names))
        else:
            self.w, self.b = np.zeros(len(names)), -2.0
        if not ranked:  # nothing was learnt: the fixed list decides
            for w in INSULTS:
                self.w[self.place[w]] = 3.0
            self.b = -2.0
        self.weight = {n: float(self.w[k]) for n, k in self.place.items()}

    def features(self, text: str) -> set[str]:
        return self._features(words(text), (n for n, p in PATTERNS.items() if p.search(text)))

    def _features(self, own: set[str], patterns: Iterable[str]) -> set[str]:
        out = {w for w in own if w in self.place}
        out |= self.stems.units(own) & self.place.keys()
        out.update(patterns)
        hits = len(own & self.strong)
        return out | ({"~two"} if hits >= 2 else set()) | ({"~three"} if hits >= 3 else set())

    def _votes(self, found: list[set[str]]) -> np.ndarray:
        lexicon = set(self.lexicon)
        out = np.zeros((len(found), len(self.voters)))
        index = {n: k for k, n in enumerate(self.voters)}
        for row, own in zip(out, found, strict=True):
            for f in own:
                if f in index:
                    row[index[f]] = 1
            row[-1] = not own & lexicon
        return out

    def score(self, text: str) -> float:
        z = self.b + sum(map(self.weight.__getitem__, self.features(text)))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        own = [read(t, bool(y)) for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        columns = [b.column(0), pa.array([r.words for r in own], pa.string()), pa.array([list(r.patterns) for r in own], pa.list_(pa.string())), b.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "words", "patterns", "y"])


def training_rows(df: DataFrame, labels: DataFrame, held_out: Column, bound: int, *, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[Reading, int]], float]:
    """A bounded labelled sample, half of each class where there are enough, and the toxic share of all labelled rows."""
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(~held_out & F.col("i").isNotNull() & F.col("y").isin(0, 1))
    counts = {r.y: r.c for r in own.groupBy("y").agg(F.count("*").alias("c")).collect()}
    total = sum(counts.values())
    if not total:
        return [], 0.1
    ids = [own.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(bound // 2) for y in (0, 1)]
    picked = ids[0].unionByName(ids[1])  # at most ``bound`` narrow rows
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    read_ = texts.join(F.broadcast(picked), "i").select(F.xxhash64("i").alias("h"), "t", "y").mapInArrow(_read, "h long, words string, patterns array<string>, y int")
    rows = read_.orderBy("h", "words", "patterns", "y").limit(2 * bound).collect()
    return [(Reading(r.words, tuple(r.patterns)), r.y) for r in rows], counts.get(1, 0) / total


def train(df: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    key = F.crc32(F.coalesce(F.col("i").cast("string"), F.lit("")).cast("binary")) % folds == held
    sample, prior = training_rows(df, labels, key, train_docs, id_col=id_col, text_col=text_col, label_col=label_col)
    return Model(sample, prior)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            score = [model.score(t or "") for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(df: DataFrame, model: Model, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), SCHEMA)


def _clean(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            yield b.filter(pa.array([model.score(t or "") < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def keep_clean(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows predicted not toxic, with all their columns."""
    return df.mapInArrow(_clean(model, df.columns.index(text_col)), df.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")), fold("doc_id", 5) == 0)
