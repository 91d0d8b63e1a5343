"""Stored indexes of chunks: word postings and cells of vectors.

Both are tables derived from chunks, kept beside them (rows carry the session,
so a replaced session replaces its rows) and always possible to rebuild.

**Postings.** A row holds a word's occurrences in up to ``BLOCK`` chunks of one
session: ids, and positions as gaps. A task writes the rows of ``RUN`` words of
text at a time, in order of words, so nothing is shuffled, sorted or held beyond
that, and no row grows with a session. A file is a list of such runs: its page
index lets a search read the words it asks for; a frequent word's rows are in all
runs.

**Cells.** Centroids come from k-means over at most ``TRAIN`` vectors (those with
the smallest hashes; a documented bound), and every vector is in the cell of its
nearest centroid. A search reads each query's ``probes`` nearest cells. How many
are enough is measured: stored vectors drawn by hash are searched exactly and in
1, 2, 4, ... cells until their mean recall reaches ``RECALL``; if only all cells
do, the search is exact.

**Trigrams.** Each chunk's distinct trigrams are stored, rarest first, by their
number. Texts that share a share ``t`` of their trigrams differ in number by a
factor of ``1 / t`` at most, which page indexes turn into rows never read, and
their rarest ``m - ceil(t * m) + 1`` trigrams meet, so only such pairs are
compared in full. Rarity is that of a bounded sample of chunks (``ORDER_CHUNKS``);
any fixed order gives the same results.

Edge cases: chunks without text have no postings; null, empty, zero or
non-finite vectors are in cell -1, which is always read, so that scores are those
of the exact channel; without usable vectors there is that one cell; repeated ids
have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, trigrams, words
from ..schema import CELLS, POSTINGS
from . import channels

BLOCK = 4096
#: Words of text that a task turns into postings, or into trigrams, at a time.
RUN, GRAM_RUN = 1_000_000, 250_000
TRAIN = 20_000
CELL_ROWS = 1_000
MAX_CELLS = 4096
ITERATIONS = 8
AUDITED = 50
AUDIT_POOL = 30
RECALL = 0.9
ORDER_CHUNKS, ORDER_GRAMS = 2_000, 50_000
#: So many words of a batch are also given to the scan as a list.
LISTED = 1_000


# -- words ------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose lists in ``column`` hold at most ``most`` items, or that have one row."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()[1:].astype(np.int64)
        at, before = 0, int(batch.column(column).offsets[0].as_py()) if batch.num_rows else 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def _coded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct items of the lists, each item as a place among them, and the lists' lengths."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(offsets)


def _places(values: pa.Array) -> np.ndarray:
    """The place of each value in their order (of UTF-8 bytes, null first)."""
    order = pc.sort_indices(values, null_placement="at_start").to_numpy()
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values))
    return out


def _posted(block: int):
    """Each run's words with the chunks that hold them and the positions as gaps; the words were cut by the engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2, RUN):
            terms, code, lens = _coded(batch.column(2))
            if not len(code):
                continue
            n = batch.num_rows
            session, row_at = batch.column(0).dictionary_encode("encode"), _places(batch.column(1))
            by_row = np.argsort(row_at)
            own = _places(session.dictionary)[session.indices.to_numpy()]
            # Each session's chunks, by id, in groups of a block.
            grouped = np.lexsort((row_at, own))
            turn = np.arange(n) - np.searchsorted(own[grouped], own[grouped], "left")
            part = np.empty(n, np.int64)
            part[grouped] = np.cumsum(np.append(False, (own[grouped][1:] != own[grouped][:-1]) | (turn[1:] // block != turn[:-1] // block)))
            parts = int(part.max()) + 1
            key = (_places(terms)[code] * parts + np.repeat(part, lens)) * n + np.repeat(row_at, lens)
            order = np.argsort(key, kind="stable")  # occurrences stay in order
            at = (np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens))[order] + 1
            key, code = key[order], code[order]
            chunk = np.append(True, key[1:] != key[:-1])
            gap = np.where(chunk, at, np.diff(at, prepend=0)).astype(np.int32)
            starts = np.flatnonzero(chunk)
            held, key = by_row[key[starts] % n], key[starts] // n
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            gaps = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gap)), pa.int32()), pa.array(gap))
            docs = pa.StructArray.from_arrays([batch.column(1).take(pa.array(held)), gaps], names=["id", "gaps"])
            columns = [terms.take(pa.array(code[starts[heads]])), batch.column(0).take(pa.array(held[heads])), pa.ListArray.from_arrays(pa.array(np.append(heads, len(starts)), pa.int32()), docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "session_id", "docs"])

    return run


def postings(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``term, session_id, docs`` of all words of the chunks, each run in order of words."""
    return chunks.where("content IS NOT NULL").select("session_id", "id", words("content").alias("words")).mapInArrow(_posted(block), POSTINGS)


def lexical(stored: DataFrame, allowed: DataFrame, queries: DataFrame, keep=None) -> DataFrame:
    """The word channel from :func:`postings`: ``query_id, id, rank, score``.

    ``allowed``: the ids that the filters leave. No text is read.
    """
    asked = queries.select("query_id", "pool", query_terms("text").alias("terms")).where(F.size("terms") > 0)
    wanted = asked.select("query_id", "pool", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    listed = [r.term for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        stored = stored.where(F.col("term").isin(listed))
    hits = stored.join(wanted, "term").select("query_id", "pool", "n", "term", F.explode("docs").alias("d")).select("query_id", "pool", "n", "term", "d.id", "d.gaps")
    met = hits.groupBy("query_id", "id").agg(F.first("pool").alias("pool"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("term", "gaps"))).alias("found"))
    full = met.where(F.size("found") == F.col("n")).join(allowed.select("id"), "id", "left_semi")
    full = keep(full) if keep else full
    one = full.where("n = 1").withColumn("score", F.lit(0.1) * F.size(F.col("found")[0]["gaps"]))
    many = full.where("n > 1").withColumn("score", channels.cover_scores(F.col("found")["gaps"], gaps=True))
    scored = one.unionByName(many).select("query_id", "id", "pool", "score")
    return channels.top(scored, F.col("score").desc(), F.col("id"))


# -- trigrams ---------------------------------------------------------------


#: Sets of trigrams on their way from a task: one string, as each has three characters.
PACKED = "m int, session_id string, id string, packed string"
UNPACKED = "regexp_extract_all(packed, '(?s)...', 0)"


def _sets(place: dict[str, int]):
    """Rarest first: trigrams without a place are rarer than all that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2, GRAM_RUN):
            terms, code, lens = _coded(batch.column(2))
            shared: dict[str, str] = {}  # one object for each trigram
            of = [tuple(shared.setdefault(g, g) for g in channels.local_trigrams(w)) for w in terms.to_pylist()]
            sizes, rows, end = [], [], 0
            for size in lens.tolist():
                own = set().union(*(of[c] for c in np.unique(code[end : end + size]).tolist()))
                end += size
                sizes.append(len(own))
                rows.append("".join(sorted(own, key=lambda g: (place.get(g, 0), g))))
            columns = [pa.array(sizes, pa.int32()), batch.column(0), batch.column(1), pa.array(rows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["m", "session_id", "id", "packed"])

    return run


def gram_order(chunks: DataFrame, most: int = ORDER_CHUNKS, size: int = ORDER_GRAMS) -> dict[str, int]:
    """Places (from 1, the most frequent last) of at most ``size`` trigrams, by ``most`` chunks, those with the smallest hashes of ids."""
    own = chunks.where("content IS NOT NULL")
    ids = own.select("id").orderBy(F.xxhash64("id"), "id").limit(most).distinct()  # no text is sorted
    drawn = own.join(F.broadcast(ids), "id", "left_semi").limit(most).select("session_id", "id", words("content").alias("w"))
    counts = drawn.mapInArrow(_sets({}), PACKED).select(F.explode(F.expr(UNPACKED)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.col("n").desc(), "gram").limit(size).collect()
    return {r.gram: len(rows) - k for k, r in enumerate(rows)}


def gram_sets(chunks: DataFrame, place: dict[str, int]) -> DataFrame:
    """``m, session_id, id, grams`` of the chunks that have any, in order of ``m``."""
    rows = chunks.where("content IS NOT NULL").select("session_id", "id", words("content").alias("w"))
    return rows.mapInArrow(_sets(place), PACKED).where("m > 0").sortWithinPartitions("m").select("m", "session_id", "id", F.expr(UNPACKED).alias("grams"))


def trigram(stored: DataFrame, place: dict[str, int], allowed: DataFrame, queries: DataFrame, threshold: float, keep=None) -> DataFrame:
    """The trigram channel from :func:`gram_sets` in the order ``place``: ``query_id, id, rank, score``. No text is read."""
    if threshold <= 0:
        raise ValueError("stored trigrams need a threshold above 0")
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = [(r.query_id, r.pool, sorted(r.own, key=lambda g: (place.get(g, 0), g))) for r in channels.collected(queries.withColumn("own", trigrams("text")).where(F.size("own") > 0), "query_id", "pool", "own")]
    rows = [(q, pool, len(own), own, own[: len(own) - ceil(threshold * len(own) - 1e-9) + 1]) for q, pool, own in asked]
    wanted = queries.sparkSession.createDataFrame(rows, f"query_id {kind}, pool int, n int, own array<string>, first array<string>")
    low, high = (min((n for _, _, n, _, _ in rows), default=0), max((n for _, _, n, _, _ in rows), default=0))
    near = stored.where((F.col("m") >= int(threshold * low)) & (F.col("m") <= int(high / threshold) + 1))
    rarest = F.slice("grams", F.lit(1), (F.col("m") - F.ceil(F.lit(threshold) * F.col("m") - 1e-9) + 1).cast("int"))
    heads = near.select("id", "m", F.explode(rarest).alias("gram"))
    ask = wanted.select("query_id", "n", F.explode("first").alias("gram"))
    fits = (F.col("m") >= F.lit(threshold) * F.col("n") - 1e-9) & (F.col("m") <= F.col("n") / threshold + 1e-9)
    pairs = heads.join(ask, "gram").where(fits).select("query_id", "id").distinct()
    met = pairs.join(near.select("id", "m", "grams"), "id").join(wanted.select("query_id", "pool", "n", "own"), "query_id")
    shared = F.size(F.array_intersect("grams", "own"))
    scored = met.select("query_id", "id", "pool", (shared / (F.col("n") + F.col("m") - shared)).alias("score")).where(F.col("score") >= threshold)
    scored = scored.join(allowed.select("id"), "id", "left_semi")  # last, so that no set is shuffled for it
    return channels.top(keep(scored) if keep else scored, F.col("score").desc(), F.col("id"))


# -- vectors ----------------------------------------------------------------


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length and ``dim`` numbers; a row that has none is all zeros."""
    out = np.zeros((len(column), dim), np.float32)
    lens = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(lens.sum())).to_numpy(zero_copy_only=False).astype(np.float32)
    whole = lens == dim
    out[whole] = flat[np.repeat(whole, lens)].reshape(-1, dim)
    size = np.linalg.norm(out.astype(np.float64), axis=1)
    good = np.isfinite(size) & (size > 0)
    out[~good] = 0
    out[good] = out[good] / size[good, None]
    return out


def k_means(x: np.ndarray, cells: int, iterations: int = ITERATIONS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows; a cell that runs empty starts again from the row worst served."""
    r = np.random.default_rng(seed)
    centre = x[r.choice(len(x), cells, replace=False)].copy()
    for _ in range(iterations):
        cos = x @ centre.T
        own = cos.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        total[empty] = x[np.argsort(cos.max(axis=1))[: len(empty)]]
        centre = total / np.maximum(np.linalg.norm(total, axis=1), 1e-9)[:, None]
    return centre


def train(vectors: DataFrame, dim: int, most: int = TRAIN, cells: int | None = None) -> np.ndarray:
    """Centroids from at most ``most`` of the vectors (``id, embedding``)."""
    n = vectors.count()
    picked = vectors.where(F.size("embedding") == dim).select("embedding", F.xxhash64("id").alias("h"), "id")
    rows = picked.orderBy("h", "id").limit(most).select("embedding").collect()  # bounded: most * dim numbers
    if not rows:
        return np.zeros((0, dim), np.float32)
    x = units(pa.array([r.embedding for r in rows], pa.list_(pa.float32())), dim)
    x = x[x.any(axis=1)]
    cells = cells or int(min(MAX_CELLS, max(1, -(-n // CELL_ROWS))))
    return k_means(x, min(cells, len(x))) if len(x) else np.zeros((0, dim), np.float32)


def _assign(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch.column(2), centre.shape[1])
            cell = (x @ centre.T).argmax(axis=1) if len(centre) else np.zeros(len(x), np.int64)
            cell = np.where(x.any(axis=1), cell, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), batch.column(2)], names=["cell", "session_id", "id", "embedding"])

    return run


def cells(chunks: DataFrame, centre: np.ndarray) -> DataFrame:
    """``cell, session_id, id, embedding`` of the chunks with vectors, in order of cells."""
    rows = chunks.where("embedding IS NOT NULL").select("session_id", "id", F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(_assign(centre), CELLS).sortWithinPartitions("cell")


def _probe(ids: list, matrix: np.ndarray, pools: np.ndarray, by_cell: dict[int, np.ndarray], types: list[pa.DataType], masks=None):
    """Each batch's nearest rows for the queries that probe their cells."""
    size = np.sqrt((matrix * matrix).sum(axis=1))
    dim = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            out: tuple[list, list, list] = [], [], []
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                asked = by_cell.get(c, by_cell[-1]) if c < 0 else by_cell.get(c)
                if asked is None or not len(asked):
                    continue
                own = batch.take(pa.array(rows))
                keys = np.array(own.column(1).to_pylist(), object)
                x = np.array([v if len(v) == dim else [np.nan] * dim for v in own.column(2).to_pylist()], np.float64).reshape(len(rows), dim)
                n = np.sqrt((x * x).sum(axis=1))[:, None] * size[asked]
                with np.errstate(invalid="ignore", divide="ignore"):
                    cos = np.where(n > 0, (x @ matrix[asked].T) / n, 0.0)
                seen = masks(ids, *(own.column(k) for k in (3, 4, 5))) if masks else {}
                for k, q in enumerate(asked.tolist()):
                    keep = channels.nearest(cos[:, k], pools[q], seen.get(q))
                    out[0].extend([ids[q]] * len(keep))
                    out[1].extend(keys[keep])
                    out[2].extend(cos[keep, k])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["query_id", "id", "score"])

    return run


@dataclass
class Cells:
    """Stored cells, their centroids, and how many a query reads (``probes``)."""

    rows: DataFrame
    centre: np.ndarray
    probes: int

    def dense(self, allowed: DataFrame, queries: DataFrame, probes: int | None = None, masks=None) -> DataFrame:
        """The dense channel over the cells nearest to each query: ``query_id, id, rank, score``."""
        asked = [r for r in channels.collected(queries, "query_id", "embedding", "pool") if r.embedding is not None]
        kind = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, id string, score double"
        if not asked:
            return channels.top(queries.sparkSession.createDataFrame([], f"{schema}, pool int"), F.col("id"))
        matrix = np.array([r.embedding for r in asked], np.float64)
        probes = min(probes or self.probes, len(self.centre))
        near = np.argsort(-(matrix @ self.centre.T), axis=1, kind="stable")[:, :probes]
        by_cell = {-1: np.arange(len(asked))} | {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        rows = self.rows if len(by_cell) > len(self.centre) else self.rows.where(F.col("cell").isin([int(c) for c in by_cell]))
        types = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.string(), pa.float64()]
        bare = rows.select("cell", "id", "embedding")
        usable = bare.join(allowed.select("id", *channels.META), "id").select("cell", "id", "embedding", *channels.META) if masks else bare.join(allowed.select("id"), "id", "left_semi").select("cell", "id", "embedding")
        best = _probe([r.query_id for r in asked], matrix, np.array([r.pool for r in asked]), by_cell, types, masks)
        found = usable.mapInArrow(best, schema)
        return channels.top(found.join(queries.select("query_id", "pool"), "query_id"), F.col("score").desc(), F.col("id"))

    def audit(self, audited: int = AUDITED, pool: int = AUDIT_POOL, least: float = RECALL) -> tuple[int, list[tuple[int, float]]]:
        """The number of cells to read, and the recalls measured on the way."""
        drawn = self.rows.where("cell >= 0").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(audited)
        queries = drawn.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(pool).alias("pool"))
        everything = self.rows.select("id")
        true = {(r.query_id, r.id) for r in self.dense(everything, queries, len(self.centre)).collect()}  # at most audited * pool rows
        measured, probes = [], 1
        while probes < len(self.centre):
            found = {(r.query_id, r.id) for r in self.dense(everything, queries, probes).collect()}
            measured.append((probes, len(found & true) / max(len(true), 1)))
            if measured[-1][1] >= least:
                return probes, measured
            probes *= 2
        return max(len(self.centre), 1), measured


@dataclass
class Index:
    """What a search may read in place of texts and whole vector columns."""

    postings: DataFrame | None = None
    cells: Cells | None = None
    grams: DataFrame | None = None
    order: dict[str, int] = field(default_factory=dict)
