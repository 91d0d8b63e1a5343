"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Words are counted, then each is compared with the words that differ from it by
exactly one inserted, deleted or replaced code point. With the words of a group
sorted forwards and backwards, a word's prefix of ``k`` code points is an
interval of the forward order, a suffix an interval of the reverse order. For
each edit position the two intervals make a rectangle; the points in it (a word
stands at its two ranks) are exactly the words with that prefix and suffix. A
wavelet tree over the reverse ranks in forward order reports them.

Distribution. One edit leaves one half of a word as it is, so each word goes to
the groups of its halves (for replacements, and for insertions as the shorter
and as the longer word): a group holds all that agree outside a range of edit
positions. A group beyond ``GROUP`` words is split: its range is halved, and
its words go to two groups that agree on more. A group whose range is one
position has at most as many words as the alphabet has letters, so this ends
with bounded groups and loses no pair. Groups are dealt by hash, run through
wavelet trees in runs of at most ``CHUNK`` words, and return sums for each word,
never pairs.

Forms follow from the near words: the most frequent one, if it is ``RATIO``
times as frequent. Along forms the count grows by that factor, so chains are
short; roots are found by doubling.

Edge cases: null and empty texts have no runs; a null id counts as the empty
string in the hash; repeated rows count each; runs of any length are words (a
range of positions is only visited where neighbours agree that far); ties of
the best near word go to the smallest in code-point order; without words the
result is empty. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, table

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
NOISE = 31
RATIO = 10
GROUP = 20_000
CHUNK = 100_000
CHUNK_BYTES = 16 << 20
QUERIES = 50_000
EQUAL, SHORT, LONG = 0, 1, 2
FOUND = "word string, c long, m long, other string"


def noisy_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """``word`` for each run of at least ``least`` code points that keeps as many after the planted deletions."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least},}})"), 1)).alias("run")
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), run).select("i", low.alias("run"))
    h = F.crc32(F.concat_ws(":", "i", "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"), F.length("run").alias("n"))
    at = F.pmod("h", "n").cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("n")))
    return hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(runs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that occur ``least`` times or more."""
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _rest(lo: Column, cut: Column) -> Column:
    """The word without ``cut`` code points from ``lo`` on."""
    word = F.col("word")
    return F.concat(F.substring(word, F.lit(1), lo), F.substring(word, lo + cut + 1, F.length(word)))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of the group: what all its words agree on."""
    span = F.col("hi") - F.col("lo")
    cut = F.when(F.col("role") == SHORT, span).otherwise(span + 1)
    own = F.least(F.col("role"), F.lit(1))
    return rows.withColumn("key", F.xxhash64(own, "size", "lo", "hi", _rest(F.col("lo"), cut)))


def halves(words: DataFrame) -> DataFrame:
    """Each word in the groups of its halves: ``word, n, role, size, lo, hi, key``.

    ``size`` is the length of the words (of the shorter ones, for insertions);
    edits are at positions ``lo`` to ``hi``.
    """
    cells = []
    for role in (EQUAL, SHORT, LONG):
        size = F.length("word") - (1 if role == LONG else 0)
        last = size - (1 if role == EQUAL else 0)
        mid = F.floor(size / 2).cast("int")
        cells += [F.struct(F.lit(role).alias("role"), size.alias("size"), lo.alias("lo"), hi.alias("hi")) for lo, hi in ((F.lit(0), mid - 1), (mid, last))]
    return _keyed(words.select("word", "n", F.explode(F.array(*cells)).alias("cell")).select("word", "n", "cell.*"))


def split_heavy(rows: DataFrame, limit: int = GROUP) -> DataFrame:
    """Groups over ``limit`` words halve their range of positions until none is left that can."""
    while True:
        rows, _ = materialize(rows, "spelling-groups")
        heavy = rows.where("lo < hi").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key")
        heavy, _ = materialize(heavy, "spelling-heavy")
        n = heavy.count()
        if not n:
            return rows
        hot = heavy.withColumn("hot", F.lit(True))
        if n <= 1_000_000:  # else the keys travel as the rows do
            hot = F.broadcast(hot)
        marked = rows.join(hot, "key", "left")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        ranges = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        parted = marked.where("hot").drop("key", "hot").withColumn("r", F.explode(ranges)).select("word", "n", "role", "size", "r.lo", "r.hi")
        rows = marked.where("hot IS NULL").drop("hot").select("word", "n", "role", "size", "lo", "hi", "key").unionByName(_keyed(parted))


class WaveletTree:
    """Range reporting over a permutation, level by level, for many rectangles at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(self.n - 1).bit_length())
        self.zeros = []
        for d in range(self.depth):
            bit = values >> (self.depth - 1 - d) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            # Nodes stay in place (values are a permutation); inside each, zeros go before ones.
            values = values[np.argsort(values >> (self.depth - 1 - d), kind="stable")]

    def report(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places a to b with values low to high (ends excluded): (number of the rectangle, value) of each point."""
        q, node = np.arange(len(a)), np.zeros(len(a), np.int64)
        for d in range(self.depth):
            width = self.depth - d
            begin = node << width
            to_zero = self.zeros[d]
            start = np.minimum(begin, self.n)
            za, zb = to_zero[a] - to_zero[start], to_zero[b] - to_zero[start]
            middle = np.minimum(begin + (1 << width - 1), self.n)
            left = (start + za, start + zb, 2 * node)
            right = (middle + (a - start - za), middle + (b - start - zb), 2 * node + 1)
            parts = []
            for x, y, v in (left, right):
                first = v << width - 1
                keep = (x < y) & (first < high[q]) & (first + (1 << width - 1) > low[q])
                parts.append((q[keep], x[keep], y[keep], v[keep]))
            q, a, b, node = (np.concatenate(p) for p in zip(*parts, strict=True))
        return q, node


def _letters(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _order(group: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by group and word; how many letters each shares with the row before it (-1: another group)."""
    mark = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    both = np.ascontiguousarray(np.hstack([mark, letters]))
    order = np.argsort(both.view(f"S{both.shape[1]}").ravel(), kind="stable")
    own = letters[order]
    differ = own[1:] != own[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1]) if len(own) > 1 else np.empty(0, np.int64)
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def _reach(common: np.ndarray) -> np.ndarray:
    """The longest prefix that each row shares with a neighbour."""
    return np.maximum(common, np.append(common[1:], -1))


def _interval(common: np.ndarray, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that share ``size`` letters with the rows at places ``at``: first and end."""
    edges = np.flatnonzero(np.append(common < size, True))
    k = np.searchsorted(edges, at, side="right")
    return edges[k - 1], edges[k]


def near_words(group: np.ndarray, role: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (word, near word) of groups of one ``size`` and kind, in runs.

    Insertions give both directions; of equal results of several positions
    (a letter doubled) only the first position counts.
    """
    kind = min(int(role[0]), 1)
    letters = _letters(words, size + kind)
    lens = np.array([len(w) for w in words])
    flipped = _letters([w[::-1] for w in words], size + kind)
    forward, shared = _order(group, letters)
    backward, shared_back = _order(group, flipped)
    rank, rank_back = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    rank[forward] = np.arange(len(words))
    rank_back[backward] = np.arange(len(words))
    tree = WaveletTree(rank_back[forward])
    reach, reach_back = _reach(shared)[rank], _reach(shared_back)[rank_back]
    asks = role != LONG
    tail = size - (1 - kind)  # letters of prefix and suffix together
    least, most = np.maximum(lo, tail - reach_back), np.minimum(hi, reach)
    asks &= least <= most
    if not asks.any():
        return
    for k in range(int(least[asks].min()), int(most[asks].max()) + 1):
        own = np.flatnonzero(asks & (least <= k) & (k <= most))
        for part in np.array_split(own, -(-len(own) // QUERIES)) if len(own) else []:
            a, b = _interval(shared, k, rank[part])
            low, high = _interval(shared_back, tail - k, rank_back[part])
            q, value = tree.report(a, b, low, high)
            word, other = part[q], backward[value]
            if kind == EQUAL:
                keep = word != other
                yield word[keep], other[keep]
            else:
                keep = lens[other] > lens[word]
                word, other = word[keep], other[keep]
                if k:
                    first = letters[word, k - 1] != letters[other, k]
                    word, other = word[first], other[first]
                yield np.concatenate([word, other]), np.concatenate([other, word])


def _search(chunk: pa.Table) -> pa.RecordBatch:
    """For each word of the chunk with near words: their number, the count of the best, and the best."""
    words = [w.encode("latin-1") for w in chunk["word"].to_pylist()]
    n = chunk["n"].to_numpy()
    same = [chunk[c].to_numpy() for c in ("key", "lo", "hi")]
    group = np.cumsum(np.any([np.append(False, c[1:] != c[:-1]) for c in same], axis=0))
    number, most, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1)
    place = np.empty(len(words), np.int64)  # code-point order of the words
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    for word, other in near_words(group, chunk["role"].to_numpy(), *same[1:], words, int(chunk["size"][0].as_py())):
        order = np.lexsort((place[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
        number += np.bincount(word, minlength=len(words))
        w, o = word[first], other[first]
        better = (n[o] > most[w]) | ((n[o] == most[w]) & (best[w] >= 0) & (place[o] < place[best[w]]))
        most[w[better]], best[w[better]] = n[o[better]], o[better]
    found = np.flatnonzero(number)
    text = chunk["word"].combine_chunks()
    columns = [text.take(pa.array(found)), pa.array(number[found]), pa.array(most[found]), text.take(pa.array(best[found]))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "c", "m", "other"])


def _runs(batches: Iterator[pa.RecordBatch], limit: int, size: int) -> Iterator[pa.Table]:
    """Whole groups of one size and kind, up to ``limit`` rows or ``size`` bytes at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    rows = 0
    for batch in batches:
        mark = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("size", "kind", "key", "lo", "hi")])
        cut = np.flatnonzero(np.any(mark[:, 1:] != mark[:, :-1], axis=0)) + 1
        cuts = ([0] if last is not None and np.any(mark[:, 0] != last) else []) + cut.tolist()
        at = 0
        for c in cuts:
            before = mark[:2, c - 1] if c else last[:2]
            full = rows + c - at >= limit or (rows + c - at) * int(mark[0, c]) >= size
            if full or np.any(before != mark[:2, c]):
                held.append(batch.slice(at, c - at))
                yield pa.Table.from_batches(held)
                held, rows, at = [], 0, c
        held.append(batch.slice(at))
        rows += batch.num_rows - at
        last = mark[:, -1]
    if rows:
        yield pa.Table.from_batches(held)


def _near(limit: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _runs((b for b in batches if b.num_rows), limit, size):
            if chunk.num_rows > 1:
                yield _search(chunk)

    return run


def near_summary(words: DataFrame, *, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """``word, n_near, form_n, form``: number and best of the near words of each word that has any."""
    rows = split_heavy(halves(words), group).withColumn("kind", F.least(F.col("role"), F.lit(1)))
    dealt = rows.repartition("key").sortWithinPartitions("size", "kind", "key", "lo", "hi")
    found = dealt.mapInArrow(_near(chunk, CHUNK_BYTES), FOUND)
    best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.other").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of each word with a ``form``: the end of its chain, by doubling."""
    spark = links.sparkSession
    now, _ = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, _ = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").limit(1).count() == 0:
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of a table of distinct words of ``a-z\\u00C0-\\u00FF`` and their counts."""
    spark = words.sparkSession
    with scratch(spark) as keep:
        words, at = materialize(words, "spelling-words")
        keep.append(at)
        near = near_summary(words, group=group, chunk=chunk)
        taken = F.col("form_n") >= ratio * F.col("n")
        joined = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n")
        )
        formed, at = materialize(joined, "spelling-forms")
        keep.append(at)
        ends, at = materialize(roots(formed.where("form IS NOT NULL")), "spelling-ends")
        keep.append(at)
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    found = spelling_variants(vocabulary(noisy_runs(table(spark, sf_dir, "documents"))))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
