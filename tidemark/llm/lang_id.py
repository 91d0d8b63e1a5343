"""Language identification with a convolutional network over bytes.

The network embeds the bytes of a fixed-length window, applies filters of
several widths, takes each filter's maximum over the window, and ends in a
softmax. It is trained in numpy (Adam on the cross-entropy) on at most
``TRAIN_DOCS`` labelled rows of each language outside the held-out fold - those
with the smallest hash of id and text, so any layout of the table gives the
same sample; one row for each hash. Their whole texts are cut into windows on
the executors, and the driver gets ``WINDOWS_PER_LANG`` windows of each
language at most, those with the smallest hash of row and place. The weights (a
few kB) travel inside the function.

Prediction reads whole texts: every text is cut into consecutive windows of
``WINDOW`` bytes (the last one padded with zeros), the windows of many texts
form one batch, and a text's score is the mean of its windows' log
probabilities weighted by their bytes, normalised.

Edge cases: null text or text without a letter is ``und`` with score 0; rows
with null lang are never learnt from; very long texts are read whole; without a labelled row every text is
``und``; with one language its score is 1; repeated rows are predicted each.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, table

WINDOW = 192
TRAIN_DOCS = 4000
WINDOWS_PER_LANG = 3000
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 8
EPOCHS = 6
BATCH = 64
RATE = 0.01
#: A letter of any script; numbers of whatever form are none.
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def windows(texts: list[str], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as byte rows, the text of each, its bytes in use."""
    data = [t.encode() for t in texts]
    count = np.array([-(-len(d) // size) for d in data])
    out = np.frombuffer(b"".join(d.ljust(c * size, b"\0") for d, c in zip(data, count, strict=True)), np.uint8).reshape(-1, size)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    used = np.minimum(size, np.repeat([len(d) for d in data], count) - (np.arange(len(owner)) - np.repeat(first, count)) * size)
    return out, owner, used


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, DIM))} | {f"w{w}": r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS} | {"o": r.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)), "c": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """Each position's ``w`` embedded bytes side by side."""
        return np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), w * DIM, axis=1)[:, ::DIM]

    def forward(self, rows: np.ndarray):
        x = self.p["e"][rows]
        pooled, at = [], []
        for w in WIDTHS:
            y = self._columns(x, w) @ self.p[f"w{w}"]
            k = y.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(y, k[:, None], 1)[:, 0] + self.p[f"b{w}"], 0))
            at.append(k)
        hidden = np.concatenate(pooled, axis=1)
        z = hidden @ self.p["o"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return x, at, hidden, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probs(self, rows: np.ndarray, batch: int = 256) -> np.ndarray:
        return np.concatenate([self.forward(rows[k : k + batch])[-1] for k in range(0, len(rows), batch)])

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        x, at, hidden, logp = self.forward(rows)
        n = len(rows)
        d = np.exp(logp)
        d[np.arange(n), target] -= 1
        d /= n
        g = {"o": hidden.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["o"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            own = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = own.sum(axis=0)
            span = at[i][:, :, None] + np.arange(w)  # the bytes each maximum read
            seen = rows[np.arange(n)[:, None, None], span]
            cols = self.p["e"][seen].reshape(n, FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("nf,nfd->df", own, cols)
            back = (own[:, :, None] * self.p[f"w{w}"].T).reshape(n, FILTERS, w, DIM)
            np.add.at(g["e"], seen, back)
        return g

    def fit(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
        r, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            for own in np.array_split(r.permutation(len(rows)), max(1, len(rows) // BATCH)):
                t += 1
                for k, g in self.gradients(rows[own], target[own]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(sample: list[tuple[bytes, str]]) -> tuple[ByteNet | None, list[str]]:
    """A network and its languages from (window, lang) rows."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None, []
    r, rows, target = np.random.default_rng(3), [], []
    for k, lang in enumerate(langs):
        own = np.frombuffer(b"".join(w for w, x in sample if x == lang), np.uint8).reshape(-1, WINDOW)
        rows.append(own)
        target.append(np.full(len(own), k))
    rows_, target_ = np.concatenate(rows), np.concatenate(target)
    # Half of the windows also occur cut short, as texts shorter than a window do.
    short = rows_.copy()
    cut = r.integers(8, WINDOW, len(short))
    short[np.arange(WINDOW) >= cut[:, None]] = 0
    pick = r.permutation(len(short))[: len(short) // 2]
    return ByteNet(len(langs)).fit(np.concatenate([rows_, short[pick]]), np.concatenate([target_, target_[pick]])), langs


def _predict(net: ByteNet | None, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, rows=256, size=1 << 20):
            texts = [t if t and LETTER.search(t) else "" for t in b.column(2).to_pylist()]
            named, score = [None] * len(texts), np.zeros(len(texts))
            rows, owner, used = windows(texts)
            if net is not None and len(rows):
                total = np.zeros((len(texts), len(langs)))
                for k in range(0, len(rows), 4096):  # bounded memory whatever the texts' length
                    np.add.at(total, owner[k : k + 4096], net.log_probs(rows[k : k + 4096]) * used[k : k + 4096, None])
                total /= np.maximum(np.bincount(owner, weights=used, minlength=len(texts)), 1)[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                named, score = [langs[k] for k in best], p[np.arange(len(texts)), best]
            ok = [bool(t) and x is not None for t, x in zip(texts, named, strict=True)]
            columns = [b.column(0), b.column(1), pa.array([x if k else "und" for x, k in zip(named, ok, strict=True)], pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def training_rows(df: DataFrame, held_out: Column, bound: int, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``text, lang, k`` of at most ``bound`` labelled rows of each language, those with the smallest hashes ``k``."""
    rows = df.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(id_col), text_col)
    keyed = rows.select(F.col(lang_col).alias("lang"), key.alias("k"))
    # Hashes are even, so a share of them holds ``bound`` of a language's keys (six deviations to spare): few rows meet by language.
    share = keyed.distinct().groupBy("lang").agg((F.lit(bound + 6 * bound**0.5 + 10) / F.count("*")).alias("share"))
    drawn = rows.select(F.col(lang_col).alias("lang"), key.alias("k"), F.col(text_col).alias("text")).join(F.broadcast(share), "lang")
    once = drawn.where(F.col("k") / 2.0**64 + 0.5 <= F.col("share")).groupBy("lang", "k").agg(F.min("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    return once.withColumn("turn", turn).where(F.col("turn") <= bound).select("text", "lang", "k")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of whole texts, but for a text's short rest: lang, k, place, window."""
    for b in slices(batches, 0, rows=256, size=1 << 20):
        rows, owner, used = windows(b.column(0).to_pylist())
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        own = np.flatnonzero((used >= WINDOW // 4) | (place == 0))
        at = pa.array(owner[own])
        yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(place[own], pa.int64()), pa.array([rows[i].tobytes() for i in own], pa.binary())], names=["lang", "k", "place", "window"])


def training_windows(rows: DataFrame, per_lang: int = WINDOWS_PER_LANG) -> list[tuple[bytes, str]]:
    """At most ``per_lang`` windows of each language, those with the smallest hashes."""
    found = rows.select("text", "lang", "k").mapInArrow(_cut, "lang string, k long, place long, window binary")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k", "place"), "k", "place")
    drawn = found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_lang)
    return [(bytes(r.window), r.lang) for r in drawn.orderBy("lang", "turn").select("window", "lang").collect()]


def identify(df: DataFrame, held_out: Column, *, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learning from rows not held out."""
    net, langs = train(training_windows(training_rows(df, held_out, train_docs, id_col=id_col, text_col=text_col, lang_col=lang_col)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(net, langs), SCHEMA)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1)
