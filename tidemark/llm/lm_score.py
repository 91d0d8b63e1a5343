"""Language-model scoring with a weighted backoff automaton.

The model is a trigram automaton over the corpus: one state for each pair of
words seen twice or more in training text, one for each word that training text
continues (plus the start state), and the empty state. A state has an arc for
each word seen after it and one failure arc: from a pair to its second word,
from a word to the empty state, whose arcs are the smoothed unigrams:

* unigram, absolute discount over ``V + 1`` events (all unseen words are one
  event): ``p(w) = (c(w) - D1) / N``, ``p(unseen) = D1 * V / N``;
* arc of word ``h`` on ``w``: ``p(w|h) = (1 - l2(h)) * c(hw) / c(h) + l2(h) * p(w)``;
* arc of pair ``gh`` on ``w``: ``(1 - l3(gh)) * c(ghw) / c(gh) + l3(gh) * p(w|h)``;
* failure arcs: ``l2(h)`` and ``l3(gh)``, with ``l(x) = D * c(x) ** (beta - 1)``.

Pairs seen once have no state: it could only repeat the one text it comes from.
Each ``D`` is ``n1 / (n1 + 2 * n2)`` of the counts of its order; each ``beta``
(growth of the number of distinct continuations of a state with its count) is
solved so that the modelled continuations of all states add up to the distinct
arcs of the training text. Each state's arcs sum to one, and every figure comes
from all training rows. Counts are by 64-bit hashes of words and sequences.

Distribution. Neither the counts nor the texts meet on one machine:

1. a map over the table turns runs of rows into *blocks* of at most
   ``block_tokens`` tokens (one longer document is one block), held as sorted
   64-bit word hashes and codes, written to the shared folder;
2. each block sends its distinct words, bigrams and trigrams, with training
   counts, to buckets by hash range. A frequent word is one entry per block, so no
   bucket is hot, and rows go to buckets that get an entry only, so there are
   never more rows than entries. A bucket adds up the counts and answers each block with the totals
   in the block's own order, which needs no keys on the way back;
3. block and answers meet, the block builds its part of the automaton, and a
   left-to-right traversal carries one state for each document and adds
   log-probabilities.

Edge cases: null or empty text is the end token alone; a null id counts as
training text; repeated rows are scored and counted each; very long texts are
scored whole (one block each); without training text every event has probability
1 / (V + 1) = 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, shuffle_partitions, slices, table
from .words import mix, word_hashes

END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a blank
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
BETAS = np.linspace(0.3, 1.0, 15)
BLOCK_TOKENS = 2_000_000
BUCKET_TOKENS = 1_000_000
WALK_TOKENS = 1_000_000

BLOCK_SCHEMA = "block_id long, doc_ids array<long>, lens array<int>, held array<boolean>, n_tokens long, vocab binary, codes binary"
ANSWER_SCHEMA = "block_id long, bucket int, a1 binary, a2 binary, a3 binary, stats array<double>"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array, each compressed if that makes it smaller, after their lengths."""
    if not len(a):
        return b""
    a = np.ascontiguousarray(a)
    z, out, sizes = zstandard.ZstdCompressor(level=1), [], []
    for plane in a.view(np.uint8).reshape(len(a), a.itemsize).T:
        raw = plane.tobytes()
        small = z.compress(raw) if plane.any() else b""
        out.append(small if len(small) < len(raw) else raw)
        sizes.append(len(out[-1]))
    return np.array([len(a), *sizes], np.uint32).tobytes() + b"".join(out)


def unpack(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    n, *sizes = np.frombuffer(b, np.uint32, size + 1).tolist()
    out, at, z = np.zeros((n, size), np.uint8), 4 * (size + 1), zstandard.ZstdDecompressor()
    for k, m in enumerate(sizes):
        if m:
            out[:, k] = np.frombuffer(b[at : at + m] if m == n else z.decompress(b[at : at + m]), np.uint8)
        at += m
    return out.view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end token after each; tokens in each text."""
    hashes, lens = word_hashes(texts)
    ends = np.cumsum(lens + 1) - 1
    out = np.full(len(hashes) + len(lens), END, np.uint64)
    out[np.delete(np.arange(len(out)), ends)] = hashes
    return out, (lens + 1).astype(np.int32)


def _block_row(block_id: int, parts: list[tuple]) -> pa.RecordBatch:
    vocab, codes = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    row = {
        "block_id": [block_id],
        "doc_ids": [pa.concat_arrays([p[0] for p in parts]).to_pylist()],
        "lens": [np.concatenate([p[3] for p in parts])],
        "held": [pa.concat_arrays([p[1] for p in parts]).to_pylist()],
        "n_tokens": [len(codes)],
        "vocab": [pack_sorted(vocab)],
        "codes": [pack(codes.astype(np.uint32))],
    }
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for b in slices(batches, 2):
            tokens, lens = tokenize(b.column(2))
            if parts and size + len(tokens) > limit:
                yield _block_row((part << 24) + seq, parts)
                seq, parts, size = seq + 1, [], 0
            parts.append((b.column(0), b.column(1), tokens, lens))
            size += len(tokens)
        if parts:
            yield _block_row((part << 24) + seq, parts)

    return run


def before(a: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """What stands before each token; ``first`` before a text's first one."""
    out = np.empty_like(a)
    out[1:] = a[:-1]
    out[starts] = first
    return out


class Block:
    """A block's words, bigrams and trigrams, each sorted by hash, and where they stand."""

    def __init__(self, lens, held, vocab: bytes, codes: bytes):
        self.lens = np.asarray(lens, np.int64)
        self.vocab, self.codes = unpack_sorted(vocab), unpack(codes, np.uint32)
        self.starts = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(~np.asarray(held, bool), self.lens)
        word = self.vocab[self.codes]
        prev = before(word, self.starts, START)
        # The lowest bit of a bigram's hash tells that it ends a text and has no continuation.
        pair = mix(prev, word) & ~np.uint64(1) | (word == END)
        three = mix(before(pair, self.starts, START), word)
        del prev, word
        self.inner = np.ones(len(self.codes), bool)
        self.inner[self.starts] = False  # the first token has no pair before it
        self.pairs, at = np.unique(pair, return_inverse=True)
        self.pair_at = at.astype(np.uint32)
        del pair, at
        three = three[self.inner]
        self.triples, at = np.unique(three, return_inverse=True)
        self.triple_at = np.zeros(len(self.codes), np.uint32)
        self.triple_at[self.inner] = at

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and training counts of the three orders."""
        used = [(self.vocab, self.codes, self.train), (self.pairs, self.pair_at, self.train), (self.triples, self.triple_at, self.train & self.inner)]
        return [(keys, np.bincount(at[own], minlength=len(keys)).astype(np.uint32)) for keys, at, own in used]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range of each key; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[int, list] = {}
                for order, (keys, counts) in enumerate(Block(row["lens"], row["held"], row["vocab"], row["codes"]).counts()):
                    own = bucket_of(keys, buckets)
                    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
                    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
                        cell = out.setdefault(int(own[a]), [b""] * 6)
                        cell[2 * order : 2 * order + 2] = pack_sorted(keys[a:b]), pack(counts[a:b])
                names = ["bucket", "block_id", "k1", "c1", "k2", "c2", "k3", "c3"]
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                rows = [(i, row["block_id"], *cell) for i, cell in sorted(out.items())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _discount(n1: float, n2: float) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.01), 0.99) if n1 + n2 else 0.5


def _stats(order: int, keys: np.ndarray, total: np.ndarray) -> list[float]:
    """Sum, distinct, seen once, seen twice; for histories also what their smoothing needs."""
    seen = total[total > 0]
    out = [float(seen.sum()), float(len(seen)), float((seen == 1).sum()), float((seen == 2).sum())]
    if order < 3:
        states = seen
        if order == 2:
            going = total[(keys & np.uint64(1)) == 0]
            out.append(float((going == 1).sum()))
            states = going[going > 1]
        out += [float((states.astype(float) ** x).sum()) for x in BETAS]
    return out


def _count(group: pa.Table) -> pa.Table:
    """Add up a bucket and answer its blocks; the statistics of its keys."""
    group = group.sort_by("block_id")
    blocks, stats, answers = group["block_id"].to_pylist(), [], []
    for order in (1, 2, 3):
        keys = [unpack_sorted(x) for x in group[f"k{order}"].to_pylist()]
        uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate([unpack(x, np.uint32) for x in group[f"c{order}"].to_pylist()]), minlength=len(uniq)).astype(np.int64)
        stats += _stats(order, uniq, total)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        answers.append([pack(x) for x in np.split(total[inv], cuts)])
    bucket, n = group["bucket"][0].as_py(), len(blocks)
    columns = {"block_id": pa.array([*blocks, None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32())}
    columns |= {f"a{k}": pa.array([*a, None], pa.binary()) for k, a in enumerate(answers, start=1)}
    return pa.table(columns | {"stats": pa.array([*[None] * n, stats], pa.list_(pa.float64()))})


def _growth(sums: np.ndarray, distinct: float) -> float:
    return float(np.interp(np.log(distinct), np.log(sums), BETAS)) if distinct > 0 and (sums > 0).all() else 1.0


class Smoothing:
    """Corpus-wide figures of the model, from the sums of :func:`_stats` over the buckets."""

    def __init__(self, stats: list[float]):
        m = len(BETAS)
        one, two, three = stats[: 4 + m], stats[4 + m : 9 + 2 * m], stats[9 + 2 * m :]
        self.n, self.v = int(one[0]), int(one[1])
        self.d1, self.d2 = _discount(one[2], one[3]), _discount(two[2], two[3])
        self.beta2 = _growth(np.array(one[4:]), two[1])
        # A pair seen once that goes on has one trigram, seen once, and no state.
        self.d3 = _discount(three[2] - two[4], three[3])
        self.beta3 = _growth(np.array(two[5:]), three[1] - two[4])

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, c - self.d1, self.d1 * self.v) / self.n

    def back(self, c: np.ndarray, order: int = 2) -> np.ndarray:
        """Weight of the failure arc of a state counted ``c`` times."""
        d, beta = (self.d2, self.beta2) if order == 2 else (self.d3, self.beta3)
        return np.clip(d * np.maximum(c, 1) ** (beta - 1.0), 1e-6, 1 - 1e-6)


def _walk(b: Block, docs: slice, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, m: Smoothing) -> np.ndarray:
    """log10 probability of some documents of the block.

    They walk in step; each carries its state (2: a pair's, 1: a word's, 0: the
    empty one) and its running sum.
    """
    lens = b.lens[docs]
    starts = np.cumsum(lens) - lens
    own = slice(b.starts[docs][0], b.starts[docs][0] + lens.sum())
    end = int(np.searchsorted(b.vocab, END))
    first = c1[end]  # the start state was left once per training document
    codes, pair_at, inner = b.codes[own], b.pair_at[own], b.inner[own]
    here, pair = c1[codes], c2[pair_at]
    uni, history = m.unigram(c1)[codes], before(here, starts, first)
    back = m.back(history)
    low = back * uni + (1 - back) * pair / np.maximum(history, 1)  # p(w|h)
    arc2, flat, fail2, step2 = pair > 0, np.log10(uni), np.log10(back), np.log10(low)
    history, joint = before(pair, starts, 0), np.where(inner, c3[b.triple_at[own]] if len(c3) else 0, 0)
    back = m.back(history, 3)
    arc3, fail3 = joint > 0, np.log10(back)
    step3 = np.log10(back * low + (1 - back) * joint / np.maximum(history, 1))
    after = np.where((pair > 1) & (codes != end), 2, here > 0).astype(np.int8)
    order = np.argsort(-lens, kind="stable")
    start, long = starts[order], -np.sort(-lens)
    total, state = np.zeros(len(order)), np.full(len(order), int(first > 0), np.int8)
    for t in range(int(long[0])):
        live = int(np.searchsorted(-long, -t, side="left"))
        at = start[:live] + t
        s = state[:live]
        word = np.where(s > 0, np.where(arc2[at], step2[at], fail2[at] + flat[at]), flat[at])
        total[:live] += np.where(s == 2, np.where(arc3[at], step3[at], fail3[at] + word), word)
        state[:live] = after[at]
    out = np.empty(len(order))
    out[order] = total
    return out


def traverse(b: Block, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, m: Smoothing) -> np.ndarray:
    """log10 probability of each document of the block, runs of about ``WALK_TOKENS`` tokens at a time."""
    run = b.starts // WALK_TOKENS
    edges = [*np.flatnonzero(np.append(True, run[1:] != run[:-1])).tolist(), len(run)]
    return np.concatenate([_walk(b, slice(lo, hi), c1, c2, c3, m) for lo, hi in zip(edges, edges[1:])])


def _score(m: Smoothing):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split(" ")[0] for x in SCORE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        row = {k: left[k][0] for k in left.column_names}
        lens, held, ids = (row[k].values for k in ("lens", "held", "doc_ids"))
        b = Block(lens.to_numpy(), held.to_numpy(zero_copy_only=False), row["vocab"].as_py(), row["codes"].as_py())
        right = right.sort_by("bucket")
        c1, c2, c3 = (np.concatenate([unpack(a, np.int64) for a in right[k].to_pylist()]) for k in ("a1", "a2", "a3"))
        score = traverse(b, c1, c2, c3, m)
        cw = c1[b.codes]
        base = np.add.reduceat(np.log10((cw + 1) / (m.n + m.v + 1)), b.starts)
        known = np.add.reduceat((cw > 0).astype(np.int64), b.starts)
        data = [ids, held, b.lens, known, np.full(len(b.lens), m.n), base, score]
        return pa.table([pa.array(x, t) for x, t in zip(data, types, strict=True)], names=names)

    return run


def score_documents(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Score every text by a model learnt from the rows where ``held_out`` is false."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    blocks, _ = materialize(rows.mapInArrow(_blocks(block_tokens), BLOCK_SCHEMA), "lm-blocks")
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks")).first()
    buckets = max(4 * shuffle_partitions(spark), -(-(size.tokens or 0) // BUCKET_TOKENS))
    asked = blocks.mapInArrow(_ask(buckets), "bucket int, block_id long, k1 binary, c1 binary, k2 binary, c2 binary, k3 binary, c3 binary")
    answers, _ = materialize(asked.groupBy("bucket").applyInArrow(_count, ANSWER_SCHEMA), "lm-answers")
    width = 12 + 1 + 2 * len(BETAS)
    sums = answers.where("stats is not null").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width))).first()
    model = Smoothing([x or 0.0 for x in sums])
    back = answers.where("block_id is not null").drop("stats")
    parts = max(1, 2 * size.blocks)  # a task meets a block or two, however many there are
    own, got = blocks.repartition(parts, "block_id"), back.repartition(parts, "block_id")
    return own.groupBy("block_id").cogroup(got.groupBy("block_id")).applyInArrow(_score(model), SCORE_SCHEMA)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
