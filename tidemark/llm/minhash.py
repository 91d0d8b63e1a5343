"""Near-duplicate documents by a multi-index Hamming join of b-bit signatures.

1. A map over the texts gives each row its set of word shingles (as a digest
   of 128 bits and a size) and a signature: ``VALUES`` min-hash values cut to 16
   bits. Rows of one digest are one *class*, which gets a number.
2. Two sets of similarity s differ in about ``(1 - s) * VALUES`` values. The
   distance limit ``t`` is the least one that a pair at the threshold exceeds
   with probability ``MISS`` at most (binomial tail). The values are split into
   ``m = t // (ERRORS + 1) + 1`` chunks; by the pigeonhole principle two
   signatures within distance ``t`` agree in some chunk up to ``ERRORS``
   values, so every class files one key for each way to leave ``ERRORS``
   values out of a chunk, and all pairs within ``t`` share a key.
3. Classes that share a key are compared with one pivot of the key (its most
   frequent class), not with each other. Pairs within ``t`` are confirmed on the
   full sets, and the links give first components; a large group of mutual
   copies costs one comparison for each class.
4. Two classes that share a key also share its pivot, so what is left to compare
   lies inside the pivots' groups that still hold several components. Groups
   are cut into blocks of about ``BLOCK`` classes. A task gets two blocks: first
   their signatures, to mark classes within ``t`` of another component, then the
   sets of the marked ones, whose intersections it counts by matrix products.
   It returns the links of a spanning forest only. No pair within ``t`` between
   components goes unconfirmed, and no list of pairs is ever made.
5. Components come from alternating star steps; each class takes the smallest
   id of its component.

Sets are rebuilt from text only for classes that take part in a comparison, once
each: a text with the id of a class counts if it has the class's digest. The
ids of those classes are broadcast up to ``BROADCAST`` of them and joined by
shuffle beyond. Joins on a key's pivot, a class or a component are salted where
one of them has very many rows. Sets hold 64-bit hashes of shingles.

Edge cases: null, empty or blank text has no shingles and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows without id
are linked with nothing and get a null component; rows that repeat an id are
judged each by its own text, and rows that repeat id and text are one node.
Very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, scratch, slices, spread_join, table
from .graph import components
from .words import shingles, word_hashes

VALUES = 40
ERRORS = 1
MISS = 1e-4
BLOCK = 256
BLOCK_SHINGLES = 200_000
BROADCAST = 500_000
HEAVY_SETS = 256  # rows with a set each that one key may bring to a task

SIGN_SCHEMA = "doc_id long, mark long, n_shingles long, digest binary, signature binary"


def distance_limit(percent: int, values: int = VALUES, miss: float = MISS) -> int:
    """Least t with P(distance > t) <= miss for a pair at the threshold."""
    p = (1 - percent / 100) * (1 - 2**-16)
    tail = 1.0
    for t in range(values + 1):
        tail -= comb(values, t) * p**t * (1 - p) ** (values - t)
        if tail <= miss:
            return t
    return values


def chunks(t: int, values: int = VALUES, errors: int = ERRORS) -> list[np.ndarray]:
    return np.array_split(np.arange(values), min(values // (errors + 1), t // (errors + 1) + 1))


def _constants(values: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 63, values, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, values, np.uint64)


def signatures(sets: np.ndarray, sizes: np.ndarray, values: int = VALUES) -> np.ndarray:
    """One row of 16-bit values for each text with a shingle."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), values), np.uint16)
    for k, (a, b) in enumerate(zip(*_constants(values), strict=True)):
        x = (sets ^ b) * a
        x ^= x >> np.uint64(31)
        low = np.minimum.reduceat(x * a, starts) if len(starts) else np.empty(0, np.uint64)
        out[:, k] = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def _digests(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) if n else None for n, e in zip(sizes, ends, strict=True)]


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            sets, sizes = shingles(*word_hashes(b.column(2)), shingle)
            rows = iter(signatures(sets, sizes))
            signs = [next(rows).tobytes() if n else None for n in sizes]
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(_digests(sets, sizes), pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "digest", "signature"])

    return run


def _sets(shingle: int):
    """Sets of the texts that have the digest of their class, one for each class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, 2):
            sets, sizes = shingles(*word_hashes(b.column(2)), shingle)
            own = np.zeros(b.num_rows, bool)
            for k, (node, want, digest) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _digests(sets, sizes), strict=True)):
                if digest == want and node not in seen:
                    seen.add(node)
                    own[k] = True
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "shingles"]).filter(pa.array(own))

    return run


def _keys(parts: list[np.ndarray], errors: int):
    kept = [(k, [i for i in part if i not in out]) for k, part in enumerate(parts) for out in combinations(part.tolist(), min(errors, len(part) - 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                if not b.num_rows:
                    continue
                rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
                own = []
                for j, (_, at_) in enumerate(kept):
                    x = np.full(len(rows), j + 1, np.uint64)
                    for i in at_:
                        x = (x ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                        x ^= x >> np.uint64(32)
                    own.append(x)
                keys = np.stack(own, axis=1).ravel().view(np.int64)
                repeat = np.repeat(np.arange(b.num_rows), len(kept))
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(repeat)), b.column(2).take(pa.array(repeat))], names=["key", "node", "weight"])

    return run


def _near(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
                yield b.filter(pa.array((x != y).sum(axis=1) <= limit)).select([0, 1])

    return run


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell's two blocks; one block meets itself on the diagonal."""
    own = group["own"].to_numpy()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _mark(limit: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        sign = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(group.num_rows, -1)
        n, root = group["n"].to_numpy(), group["root"].to_numpy()
        hit = np.zeros(group.num_rows, bool)
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            far = np.zeros((len(a), len(right)), np.int16)
            for k in range(sign.shape[1]):
                far += sign[a, k][:, None] != sign[right, k]
            low, high = np.minimum(n[a][:, None], n[right]), np.maximum(n[a][:, None], n[right])
            met = (far <= limit) & (root[a][:, None] != root[right]) & (100 * low >= percent * high)
            hit[a] |= met.any(axis=1)
            hit[right] |= met.any(axis=0)
        return group.select(["p", "node"]).filter(pa.array(hit))

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    places = []
    for sets in (x, y):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        keep = common[col] == flat if len(common) else np.zeros(len(flat), bool)
        places.append((row[keep], col[keep]))
    for at in range(0, len(common), width):
        part = []
        for (row, col), sets in zip(places, (x, y), strict=True):
            m = np.zeros((len(sets), min(width, len(common) - at)), np.float32)
            inside = (col >= at) & (col < at + width)
            m[row[inside], col[inside] - at] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _link(percent: int):
    def run(group: pa.Table) -> pa.Table:
        left, right = _sides(group)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            flat = group["shingles"].combine_chunks()
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            size, root, node = np.diff(ends), group["root"].to_numpy(), group["node"].to_numpy()
            both = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
            linked = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (root[left][:, None] != root[right])
            parent: dict[int, int] = {}

            def top(v: int) -> int:
                while parent.setdefault(v, v) != v:
                    parent[v] = v = parent[parent[v]]
                return v

            for a, b in zip(*np.nonzero(linked), strict=True):
                u, v = int(left[a]), int(right[b])
                x, y = top(int(root[u])), top(int(root[v]))
                if x != y:
                    parent[x] = y
                    found.append((int(node[u]), int(node[v])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


class Join:
    """The state of one near-duplicate join. ``docs`` and ``classes`` are stored tables."""

    def __init__(self, df: DataFrame, shingle: int, percent: int, id_col: str, text_col: str):
        self.spark, self.shingle, self.percent = df.sparkSession, shingle, percent
        self.limit = distance_limit(percent)
        self.texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        signed = self.texts.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_sign(shingle), SIGN_SCHEMA)
        self.docs, _ = materialize(signed, "minhash-docs")
        full = self.docs.where("digest is not null and doc_id is not null")
        classes = full.groupBy("digest", "signature", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.count("*").alias("weight"))
        self.classes, self.classes_at = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    def stars(self) -> DataFrame:
        """Pairs (p, node) of a key's pivot and its other classes."""
        keys = self.classes.select("node", "signature", "weight").mapInArrow(_keys(chunks(self.limit), ERRORS), "key long, node long, weight long")
        # Primitive buffers keep this a hash aggregation; ties of a weight go by hash.
        order = F.shiftleft(F.least("weight", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 21))
        pivots = keys.groupBy("key").agg(F.count("*").alias("c"), F.max_by("node", order).alias("p")).where("c > 1")
        pivots, _ = materialize(pivots, "minhash-pivots")
        return materialize(spread_join(keys, pivots, "key", "c").where("node <> p").select("p", "node").distinct(), "minhash-stars")[0]

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, shingles of the given (distinct) classes, written once."""
        nodes = nodes.join(self.classes, "node").select("node", F.col("id").alias("doc_id"), "digest").persist()
        try:
            n = nodes.count()
            ids = F.broadcast(nodes) if n <= BROADCAST else nodes
            texts = self.texts.join(ids, "doc_id").select("node", "digest", "text")
            sets, _ = materialize(texts.mapInArrow(_sets(self.shingle), "node long, shingles array<long>"), "minhash-sets")
            # Rows that repeat id and text give a set in each task that meets them.
            return sets if sets.count() == n else materialize(sets.dropDuplicates(["node"]), "minhash-sets")[0]
        finally:
            nodes.unpersist()

    def confirm(self, stars: DataFrame) -> DataFrame:
        """The links (u, v) among pairs of pivots and classes."""
        a, b = (self.classes.select(F.col("node").alias(k), F.col("signature").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        pairs = stars.select(F.col("p").alias("a"), F.col("node").alias("b"))
        met = spread_join(pairs, pairs.groupBy("a").agg(F.count("*").alias("c")).join(a, "a"), "a", "c")
        sized = met.join(b, "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        near, _ = materialize(sized.select("a", "b", "sa", "sb").mapInArrow(_near(self.limit), "a long, b long"), "minhash-near", stars.count())
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sa, sb = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"x{k}")) for k in "ab")
        both = spread_join(near, near.groupBy("a").agg(F.count("*").alias("c")).join(sa, "a"), "a", "c", heavy=HEAVY_SETS).join(sb, "b")
        met = both.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("i"), (F.size("xa") + F.size("xb")).alias("s"))
        return materialize(met.where(f"100 * i >= {self.percent} * (s - i)").select(F.col("a").alias("u"), F.col("b").alias("v")), "minhash-links", near.count(), 5000)[0]

    def cells(self, groups: DataFrame) -> DataFrame:
        """Rows (p, i, j, own, node, n, root): each class of a group in every cell of its block."""
        size = groups.groupBy("p").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        size = size.select("p", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"), "c")
        own = spread_join(groups, size, "p", "c").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "root")

    def rest(self, stars: DataFrame, links: DataFrame) -> DataFrame:
        """The links between components inside the pivots' groups."""
        groups = stars.unionByName(stars.select("p", F.col("p").alias("node")).distinct())
        known = self.classes.select("node", "n").join(components(links), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
        groups, _ = materialize(groups.join(known, "node").select("p", "node", "n", "root"), "minhash-groups", 2 * stars.count())
        signs = self.cells(groups).join(self.classes.select("node", "signature"), "node").select("p", "i", "j", "own", "node", "n", "root", "signature")
        marked, _ = materialize(signs.groupBy("p", "i", "j").applyInArrow(_mark(self.limit, self.percent), "p long, node long").distinct(), "minhash-marked", groups.count())
        sets = self.sets(marked.select("node").distinct())
        left, _ = materialize(groups.join(marked, ["p", "node"]), "minhash-left", marked.count())
        again = self.cells(left).join(sets, "node").select("p", "i", "j", "own", "node", "root", "shingles")
        return materialize(again.groupBy("p", "i", "j").applyInArrow(_link(self.percent), "u long, v long"), "minhash-more", marked.count(), 2000)[0]

    def run(self) -> DataFrame:
        """doc_id, mark, n_shingles, root, component_id of every row; root is null where nothing can be linked."""
        with scratch(self.spark) as keep:
            stars = self.stars()
            links = self.confirm(stars)
            links = links.unionByName(self.rest(stars, links))
            roots = self.classes.join(components(links), "node", "left").select("digest", "id", "weight", F.coalesce("root", "node").alias("root"))
            roots, _ = materialize(roots, "minhash-roots")
            low = roots.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("c"))
            least, at = materialize(spread_join(roots, low, "root", "c").select("digest", "root", "component_id", "weight"), "minhash-least")
            keep.append(at)
        remove(self.spark, self.classes_at)
        linked = spread_join(self.docs.where("digest is not null"), least, "digest", "weight", "left")
        alone = self.docs.where("digest is null").select("*", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
        columns = ["doc_id", "mark", "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in ("root", "component_id"))]
        return linked.select(*columns).unionByName(alone.select(*columns))


def near_duplicates(df: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of linked documents."""
    found = Join(df, shingle, percent, id_col, text_col).run()
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the columns as they were.

    It is one of the smallest id; among several texts of that id, the one with
    the least hash; among rows that repeat both, any one. Rows that are linked
    with nothing (no words, no id) all stay.
    """
    j = Join(df, shingle, percent, id_col, text_col)
    member = j.run().where("root is not null")
    heads = member.where("doc_id = component_id").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("c"))
    heads, _ = materialize(heads, "minhash-heads")
    first = heads.groupBy("root").agg(F.min("mark").alias("low"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    gone = member.where("doc_id <> component_id").select("doc_id", "mark").distinct()
    gone = gone.unionByName(heads.join(first, "root").where("mark <> low").select("doc_id", "mark"))
    again, _ = materialize(heads.where("c > 1").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")), "minhash-again")

    def same(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.toDF("_gone", "_mark")
        return rows.join(ids, (rows[id_col].cast("long") == ids["_gone"]) & (F.xxhash64(rows[text_col]) == ids["_mark"]), how)

    kept = same(df, gone, "left_anti")
    if again.isEmpty():
        return kept
    row = F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row")
    one = same(kept, again, "left_semi").groupBy(F.col(id_col).alias("_gone"), F.xxhash64(text_col).alias("_mark")).agg(row).select("_row.*")
    return same(kept, again, "left_anti").unionByName(one)


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
