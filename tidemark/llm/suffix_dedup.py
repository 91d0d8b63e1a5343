"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts at another place
of the table. Suffixes are told apart by *buckets*: the initial bucket of a place
is its 8-gram, and a bucket is refined by the bucket identifier of a later
offset, ``id(16 bytes) = pair(id8(i), id8(i + 8))``, then 32, 64, 128 and 256
bytes with the identifiers just made, and any other length by overlapping ones.
Identifiers are names by hash, the same in every task, so a refinement itself is
local; what needs an exchange is how many suffixes a bucket holds, and one with a
single suffix is done.

Not every suffix has to take part in the first rounds. The *anchor* of a
``LENGTH``-byte string is the place in it whose 128-byte bucket is least; equal
strings have equal anchors, and the strings of one anchor start at neighbouring
places: a *run*. For runs, then for their parts of ``PART`` starts, then for
single starts:

* the bytes that all strings of the part share are its inner bucket. With one
  member, none of the strings is repeated, and the part is dropped;
* all bytes of its strings are its outer bucket. With two members or more all
  its strings are repeated, and their starts are settled;
* an inner bucket with several outer buckets is refined in the next round. Its
  settled members send one witness for each outer bucket, the others all.

So a passage that two documents share costs a few rows where it begins and ends,
whatever its length and the number of its copies. Rows of one bucket are only
counted and joined to the count, which is salted for large buckets; they are
never brought together. A 32-bit check of the bytes themselves stands beside the
64-bit identifiers wherever a start is settled.

Texts travel in compressed blocks of about ``BLOCK`` bytes or one longer text,
and are worked through in pieces of ``PIECE`` bytes.

Edge cases: null and empty texts have no bytes and keep none; texts under
``LENGTH`` bytes keep all; repeated rows are copies of each other, each losing
all that is long enough; null and repeated ids are kept as they come, a row is
known by its place; periodic texts repeat themselves; an empty table gives no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, slices, spread_join, table
from .words import mix

LENGTH = 400
GRAM = 128
PART = 32
BLOCK = 1 << 20
PIECE = 1 << 17
#: Low bits of the identifiers give way to the place, so that the first of equal ones is least.
PLACE_BITS = np.uint64(24)
BLOCK_SCHEMA = "block long, ids array<long>, lens array<long>, text binary"
PART_SCHEMA = "at long, size int, anchor int, inner long, outer long, check int"
DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers; few passes over arrays that stay in a core's cache."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    y = b + np.uint64(0x7F4A7C15F39CC060)
    x ^= y
    x *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(x, np.uint64(32), out=y)
    x ^= y
    return x


def identifiers(data: np.ndarray, most: int = 256) -> dict[int, np.ndarray]:
    """Bucket identifiers of the strings of 8, 16, ... ``most`` bytes at each place where they fit."""
    n = max(len(data) - 7, 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = {8: np.ndarray((n,), "<u8", padded, strides=(1,)).astype(np.uint64)}
    size = 8
    while size < most:
        short = out[size]
        m = max(len(short) - size, 0)
        out[2 * size] = pair(short[:m], short[size : size + m])
        size *= 2
    return out


def names(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Identifiers of strings of 256 to 768 bytes, each from those at three of its offsets."""
    out = np.empty(len(starts), np.uint64)
    piece = starts // PIECE
    for p in np.unique(piece).tolist():
        own = np.flatnonzero(piece == p)
        base = p * PIECE
        ids = identifiers(data[base : base + PIECE + 768])[256]
        at, spare = starts[own] - base, lens[own] - 256
        out[own] = mix(mix(ids[at], ids[at + spare // 2]), mix(ids[at + spare], lens[own].astype(np.uint64)))
    return out


def checks(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 bits of another hash, of the bytes themselves."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) & 0x7FFFFFFF for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int32, len(starts))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, lens: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, anchor and anchor's identifier of each run of the texts laid end to end."""
    found = [np.empty((3, 0), np.int64)]
    keys = [np.empty(0, np.uint64)]
    ends = np.cumsum(lens)
    for base in range(0, max(len(data) - length + 1, 0), PIECE):
        ids = identifiers(data[base : base + PIECE + length - 1], GRAM)[GRAM]
        place = np.arange(len(ids), dtype=np.uint64)
        anchor = (least(ids >> PLACE_BITS << PLACE_BITS | place, length - GRAM + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        inside = np.ones(len(anchor), bool)
        for end in ends[np.searchsorted(ends, base, side="right") :].tolist():
            if end - length + 1 >= base + len(anchor):
                break
            inside[max(end - length + 1 - base, 0) : end - base] = False  # strings over the end of a text
        start = np.flatnonzero(inside)
        anchor = anchor[start]
        if len(start):
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
            last = start[np.append(new[1:], len(start)) - 1]
            found.append(np.stack([start[new], last, anchor[new]]) + base)
            keys.append(ids[anchor[new]])
    (lo, hi, anchor), key = np.concatenate(found, axis=1), np.concatenate(keys)
    # A run that a piece ends goes on in the next one.
    begins = np.append(True, (anchor[1:] != anchor[:-1]) | (lo[1:] != hi[:-1] + 1)) if len(lo) else np.empty(0, bool)
    first = np.flatnonzero(begins)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi, anchor[first], key[first]


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.to_pylist()]


def _pack(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            texts = [t for _, own in held for t in own]
            ids = [i for own, _ in held for i in own]
            row = [[(part << 12) + seq], [ids], [[len(t) for t in texts]], [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["block", "ids", "lens", "text"])

        for b in slices(batches, 1, rows=100_000, size=limit):
            texts = _bytes(b.column(1))
            more = sum(map(len, texts))
            if held and size + more > limit << (seq >> 10):  # a partition of many blocks gets larger ones: their numbers have 12 bits
                yield block()
                seq, held, size = seq + 1, [], 0
            held.append((b.column(0).to_pylist(), texts))
            size += more
        if held:
            yield block()

    return run


class Block:
    """The texts of a block, end to end."""

    def __init__(self, row: dict):
        self.block, self.ids, self.lens = row["block"], row["ids"], np.array(row["lens"], np.int64)
        self.raw = memoryview(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(self.lens.sum()) or 1))
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(self.lens)

    def rows(self, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, inner: np.ndarray, outer: pa.Array, check: pa.Array) -> pa.RecordBatch:
        at = (self.block << 31) + start
        columns = [pa.array(at, pa.int64()), pa.array((last - start + 1).astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(inner.view(np.int64)), outer, check]
        return pa.RecordBatch.from_arrays(columns, names=["at", "size", "anchor", "inner", "outer", "check"])

    def named(self, start: np.ndarray, end: np.ndarray, fits: np.ndarray, part: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Outer identifiers and checks of the strings; null where they do not fit.

        The number of the part is in the identifier: parts of two anchors can have one
        string at one place, which must not count as two.
        """
        ids, check = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        ids[fits] = mix(names(self.data, start[fits], (end - start)[fits]), part[fits].astype(np.uint64)).view(np.int64)
        check[fits] = checks(self.raw, start[fits], end[fits])
        return pa.array(ids, mask=~fits), pa.array(check, mask=~fits)

    def whole_runs(self) -> pa.RecordBatch:
        lo, hi, anchor, key = runs(self.data, self.lens)
        return self.rows(lo, hi, anchor, key, *self.named(lo, hi + LENGTH, np.ones(len(lo), bool), np.zeros(len(lo), np.int64)))

    def parts(self, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, width: int) -> pa.RecordBatch:
        """The runs cut at distances from their anchors that ``width`` divides."""
        low, high = (anchor - last) // width, (anchor - start) // width
        own = np.repeat(np.arange(len(start)), high - low + 1)
        p = np.arange(len(own)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[own]
        anchor = anchor[own]
        near, far = anchor - width * p, anchor - width * p - width + 1  # greatest and least start of the part
        inner = mix(names(self.data, near, np.full(len(near), LENGTH - width + 1)), p.astype(np.uint64))
        first = self.ends - self.lens
        text = np.searchsorted(self.ends, anchor, side="right")
        fits = (far >= first[text]) & (near + LENGTH <= self.ends[text])
        outer, check = self.named(far, near + LENGTH, fits, p)
        return self.rows(np.maximum(far, start[own]), np.minimum(near, last[own]), anchor, inner, outer, check)

    def digests(self, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size - 1 + LENGTH, -1)
        gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
        removed, spans, kept = [], [], []
        for a, b in zip((self.ends - self.lens).tolist(), self.ends.tolist(), strict=True):
            own = gone[a:b]
            removed.append(int(np.count_nonzero(own)))
            spans.append(int(np.count_nonzero(own[1:] > own[:-1])) + int(own[:1].any()))
            kept.append(self.data[a:b][~own].tobytes())
        columns = [pa.array(self.ids, pa.int64()), pa.array(self.lens), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        columns += [pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row).whole_runs()


def _starts(row: dict) -> tuple[np.ndarray, ...]:
    found = row["found"] or []
    at = np.array([f["at"] for f in found], np.int64)
    return at & 0x7FFFFFFF, np.array([f["size"] for f in found], np.int64), np.array([f["anchor"] for f in found], np.int64)


def _next(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                start, size, anchor = _starts(row)
                yield Block(row).parts(start, start + size - 1, anchor, width)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            start, size, _ = _starts(row)
            yield Block(row).digests(start, size)


def _by_block(rows: DataFrame) -> DataFrame:
    """Starts by block: bounded by the bytes of the block."""
    anchor = "anchor" if "anchor" in rows.columns else F.lit(0).alias("anchor")
    return rows.select(F.shiftright("at", 31).alias("block"), "at", "size", anchor).groupBy("block").agg(F.collect_list(F.struct("at", "size", "anchor")).alias("found"))


def refine(parts: DataFrame, single: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Settled starts (at, size), and the parts for the next round (at, size, anchor).

    ``single``: parts of one start, whose inner and outer strings are the same.
    """
    with scratch(parts.sparkSession) as keep:
        shared, _ = materialize(parts.groupBy("inner").agg(F.count("*").alias("c")).where("c > 1"), "suffix-shared")
        held, _ = materialize(spread_join(parts, shared, "inner", "c"), "suffix-held")
        fit = held.where("outer IS NOT NULL").withColumn("pair", F.struct("outer", "check"))
        same, _ = materialize(fit.groupBy("pair").agg(F.count("*").alias("c"), F.min("at").alias("first")).where("c > 1"), "suffix-same")
        joined = spread_join(fit, same, "pair", "c", "left").drop("pair")
        rest = held.where("outer IS NULL").withColumn("first", F.lit(None).cast("long"))
        met, at = materialize(joined.unionByName(rest), "suffix-met")
        keep.append(at)
        if single:
            return met.where("first IS NOT NULL").select("at", "size"), None
        own = F.coalesce("first", "at")  # an outer bucket by its first member
        several = met.groupBy("inner").agg(F.count("*").alias("c"), F.min(own).alias("a"), F.max(own).alias("b")).where("a < b")
        mixed, _ = materialize(several.select("inner", "c"), "suffix-mixed")
        sent = met.where(own == F.col("at"))
        onward, at = materialize(spread_join(sent, mixed, "inner", "c").select("at", "size", "anchor"), "suffix-next")
        keep.append(at)
    return met.where("first IS NOT NULL").select("at", "size"), onward


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row; ``kept`` are the bytes that remain."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with scratch(spark) as keep:
        blocks, at = materialize(rows.mapInArrow(_pack(block), BLOCK_SCHEMA), "suffix-blocks")
        keep.append(at)
        parts, first = materialize(blocks.select("block", "ids", "lens", "text").mapInArrow(_first, PART_SCHEMA), "suffix-runs")
        settled = []
        for width in (PART, 1, 0):
            with scratch(spark) as own:
                done, onward = refine(parts, single=not width)
                done, at = materialize(done, "suffix-settled")
                own.append(at)
                settled.append(done)
                if width:
                    nearby = blocks.join(_by_block(onward), "block")
                    parts, at = materialize(nearby.mapInArrow(_next(width), PART_SCHEMA), "suffix-parts")
                    own.append(at)
        found, at = materialize(_by_block(settled[0].unionByName(settled[1]).unionByName(settled[2])), "suffix-found")
        keep.append(at)
    return blocks.join(found, "block", "left").mapInArrow(_digest, DIGEST_SCHEMA)


def op11_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
