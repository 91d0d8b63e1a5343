"""Near-duplicate vectors by NN-descent.

1. Vectors become unit vectors in double precision; equal ones form a class
   with a multiplicity, so copies are never compared among themselves.
2. The neighbour graph starts from ``TABLES`` or more random-hyperplane tables: classes
   that fall in one cell (cells over ``CELL`` members are dealt at random) keep
   their best neighbours of the cell.
3. NN-descent: each class's neighbours and reverse neighbours meet, each pair
   of them is compared, and every class keeps its best ``K``. Rounds go on until
   they find no new link or ``ROUNDS`` are over.
4. Graph edges at or over the threshold, recomputed in double precision, give
   components. A list whose ``K`` entries are all links is *saturated*: the
   lists of its component are enlarged to the whole component, whose members
   are compared in blocks that return counts only. Before, every class within
   a saturated component's radius plus the threshold's angle of the
   component's pivot (the triangle inequality: no other class can link with a
   member) is compared with the members, and components that link are joined.
5. Audit: all classes with a row whose id is divisible by 50 are compared with
   all classes in blocks, which takes n * n / 50 products. A class's recall is
   the share of its linked classes that were counted, whatever their copies;
   means are taken by number of links (``STRATA``), and the least one counts.
   While it is under ``RECALL``, more tables and rounds follow, ``AUDITS`` times
   at most; then all classes are compared in blocks, which is exact and
   quadratic. Where under ``LINKED`` audited classes are linked, classes drawn by
   hash are audited too (one of ``DRAWN``; all, up to ``SMALL`` classes). The
   recall that held is a column: 1 after an exact comparison, null if no audited
   class has a link, so that nothing was measured.

The number of tables grows with the bits of a cell, so that a pair at the
threshold shares no cell with a probability of ``MISS`` at most.

Reverse neighbours beyond ``K`` are left out of a round's meetings by hash, as
in the published method; saturated components are complete whatever was left
out.

Edge cases: null, zero or non-finite vectors (null components included) link
with nothing; vectors of different lengths compare as if padded with zeros;
rows without id link with nothing and get a null component; repeated rows count
as other rows; an empty table gives no rows. Labels and extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components

K = 10
TABLES = 8
CELL = 256
ROUNDS = 3
MISS = 0.02
STRATA = (2, K)  # upper ends of the numbers of links audited together
AUDITS = 3
#: Linked classes that an audit should meet, the size at which it asks all classes instead, and else its share (one of so many).
LINKED, SMALL, DRAWN = 300, 20_000, 10
RECALL = 0.97
BLOCK = 256
WIDE = 4096  # classes of a block where two different sets meet
SLACK = 1e-4  # single precision, for the search only


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            v = np.zeros((len(lens), dim))
            v[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
            top = np.abs(v).max(axis=1, initial=0.0)
            usable = np.isfinite(v).all(axis=1) & (top > 0)
            v[usable] /= top[usable, None]  # the norm of huge or tiny components stays finite
            v[usable] /= np.sqrt(np.einsum("ij,ij->i", v[usable], v[usable]))[:, None]
            units = [x.tobytes() if ok else None for x, ok in zip(v, usable, strict=True)]
            nodes = [u and int.from_bytes(xxhash.xxh3_64_digest(u), "little", signed=True) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "node", "unit"])

    return run


def _matrix(column, dtype=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.empty((0, 1))


def _cells(dim: int, bits: int, tables: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {t: np.random.default_rng(1000 + t).normal(size=(dim, bits)) for t in tables}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            for t, p in planes.items():
                key = ((x @ p > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key * 4096 + t), b.column(0)], names=["cell", "node"])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.frombuffer(u).astype(np.float32).tobytes() for u in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["node", "v"])


def _edges(node: np.ndarray, cos: np.ndarray, keep: np.ndarray) -> pa.Table:
    a, b = np.nonzero(keep)
    return pa.table({"node": node[a], "near": node[b], "cos": cos[a, b].astype(np.float32)})


def _cell_best(k: int):
    def run(group: pa.Table) -> pa.Table:
        x, node = _matrix(group["v"], np.float32), group["node"].to_numpy()
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        keep = np.zeros(cos.shape, bool)
        if len(node) > 1:
            best = np.argpartition(-cos, min(k, len(node) - 1) - 1, axis=1)[:, :k]
            np.put_along_axis(keep, best, True, axis=1)
            np.fill_diagonal(keep, False)
        return _edges(node, cos, keep)

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Pairs of each centre's neighbours that beat the last entry of the first one's list."""
    group = group.sort_by("centre")
    centre = group["centre"].to_numpy()
    x, node, least = _matrix(group["v"], np.float32), group["u"].to_numpy(), group["least"].to_numpy()
    edge = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
    size = np.diff(np.append(edge, len(centre)))
    out = []
    for m in np.unique(size):  # centres with as many neighbours form one product
        at = edge[size == m][:, None] + np.arange(m)
        cos = np.matmul(x[at], x[at].transpose(0, 2, 1))
        c, i, j = np.nonzero(cos > least[at][:, :, None])
        a, b = at[c, i], at[c, j]
        other = node[a] != node[b]
        out.append((node[a][other], node[b][other], cos[c, i, j][other]))
    n, near, cos = (np.concatenate(p) for p in zip(*out, strict=True))
    return pa.table({"node": n, "near": near, "cos": cos.astype(np.float32)})


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = np.einsum("ij,ij->i", _matrix(b.column(2)), _matrix(b.column(3)))
                yield b.filter(pa.array(cos >= threshold)).select([0, 1])

    return run


def _tiles(group: pa.Table, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the group's left rows (some at a time) and right rows, and their cosines."""
    side, x = group["side"].to_numpy(), _matrix(group["unit"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(right):
        for at in range(0, len(left), rows):
            yield left[at : at + rows], right, x[left[at : at + rows]] @ x[right].T


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            cos = np.einsum("ij,ij->i", _matrix(b.column(1)), _matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cos)], names=["root", "cos"])


def _reach(threshold: float):
    """Classes of other components that may link with a member of the pivot's component."""
    theta = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def run(group: pa.Table) -> pa.Table:
        root, node = group["root"].to_numpy(), group["node"].to_numpy()
        radius = np.arccos(np.clip(group["cos"].to_numpy(), -1, 1))
        out = [(root[:0], node[:0])]
        for left, right, cos in _tiles(group):
            near = np.arccos(np.clip(cos, -1, 1)) <= radius[left][:, None] + theta
            a, b = np.nonzero(near & (root[left][:, None] != root[right]))
            out.append((root[left[a]], node[right[b]]))
        roots, nodes = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table({"root": roots, "node": nodes})

    return run


def _join(threshold: float):
    """One link of each left class that links with a right one."""

    def run(group: pa.Table) -> pa.Table:
        node, out = group["node"].to_numpy(), []
        out.append((node[:0], node[:0]))
        for left, right, cos in _tiles(group):
            linked = cos >= threshold
            any_ = linked.any(axis=1)
            out.append((node[left[any_]], node[right[linked[any_].argmax(axis=1)]]))
        u, v = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.table({"u": u, "v": v})

    return run


def _block_counts(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        own, i, j = group["own"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x, weight, node = _matrix(group["unit"]), group["weight"].to_numpy(), group["node"].to_numpy()
        total, degree = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        if len(left) and len(right):
            linked = x[left] @ x[right].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            total[left] += linked @ weight[right]
            degree[left] += linked.sum(axis=1)
            if i != j:
                total[right] += linked.T @ weight[left]
                degree[right] += linked.sum(axis=0)
        return pa.table({"node": node, "n": total, "m": degree})

    return run


def _span(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that join all that ``linked`` joins: a forest."""
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, free = linked.any(axis=1), linked.any(axis=0)
    while left.any():
        new = np.array([left.argmax()])
        left[new] = False
        while len(new):
            found = np.flatnonzero(linked[new].any(axis=0) & free)
            free[found] = False
            rows.append(new[linked[np.ix_(new, found)].argmax(axis=0)])
            columns.append(found)
            new = np.flatnonzero(linked[:, found].any(axis=1) & left)
            left[new] = False
            rows.append(new)
            columns.append(found[linked[np.ix_(new, found)].argmax(axis=1)] if len(new) else new)
    return np.concatenate(rows), np.concatenate(columns)


LINKS = "node long, near long, n long, m long"


def _links(threshold: float, span: bool):
    """Left classes' linked rows and classes (n, m) and, with ``span``, links (node, near) that join what is linked."""

    def run(group: pa.Table) -> pa.Table:
        node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
        counts, joins = [], []
        for left, right, cos in _tiles(group):
            linked = (cos >= threshold) & (node[left][:, None] != node[right])
            counts.append(pa.table({"node": node[left], "n": linked @ weight[right], "m": linked.sum(axis=1)}))
            if span:
                a, b = _span(linked)
                joins.append(pa.table({"node": node[left[a]], "near": node[right[b]]}))
        schema = pa.schema([(k, pa.int64()) for k in ("node", "near", "n", "m")])
        return pa.concat_tables([schema.empty_table(), *counts, *joins], promote_options="default").select(schema.names)

    return run


class Search:
    def __init__(self, df: DataFrame, threshold: float, id_col: str, vector_col: str, k: int = K):
        self.threshold, self.k = threshold, k
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        self.dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
        self.dim = max(self.dim, 1)
        self.rows, _ = materialize(rows.mapInArrow(_unit(self.dim), "vec_id long, node long, unit binary"), "nn-rows")
        full = self.rows.where("node is not null and vec_id is not null")
        classes = full.groupBy("node").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
        self.classes, _ = materialize(classes, "nn-classes")
        self.n = self.classes.count()
        self.single = self.classes.select("node", "unit").mapInArrow(_single, "node long, v binary")
        self.graph: DataFrame | None = None

    def _lists(self, edges: DataFrame) -> DataFrame:
        """The best ``k`` of each class: node, list of (cos, near)."""
        best = F.slice(F.reverse(F.array_sort(F.collect_set(F.struct("cos", "near")))), 1, self.k)
        once = edges.groupBy("node", "near").agg(F.max("cos").alias("cos"))
        return materialize(once.groupBy("node").agg(best.alias("list")), "nn-graph")[0]

    def _flat(self) -> DataFrame:
        return self.graph.select("node", F.explode("list").alias("e")).select("node", F.col("e.near").alias("near"), F.col("e.cos").alias("cos"))

    def tables(self) -> tuple[int, int]:
        """Bits of a cell, and how many tables leave a pair at the threshold apart with probability ``MISS`` at most."""
        bits = max(0, int(np.log2(max(self.n / (CELL / 2), 1))))
        share = (1 - np.arccos(np.clip(self.threshold, -1, 1)) / np.pi) ** bits
        return bits, max(TABLES, int(np.ceil(np.log(MISS) / np.log1p(-share)))) if share < 1 else TABLES

    def start(self, turn: int) -> None:
        bits, n = self.tables()
        tables = range(turn * n, (turn + 1) * n)
        cells = self.classes.select("node", "unit").mapInArrow(_cells(self.dim, bits, tables), "cell long, node long")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("c"))
        dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("c") / CELL)))
        met = dealt.join(self.single, "node").select("cell", "part", "node", "v")
        found = met.groupBy("cell", "part").applyInArrow(_cell_best(self.k // 2), "node long, near long, cos float")
        self.graph = self._lists(found if self.graph is None else found.unionByName(self._flat()))

    def links_found(self) -> int:
        return self._flat().where(F.col("cos") >= self.threshold - SLACK).count()

    def descend(self) -> None:
        """One round of neighbours-of-neighbours."""
        from pyspark.sql import Window

        ahead = self._flat().select(F.col("node").alias("centre"), F.col("near").alias("u"))
        turn = Window.partitionBy("centre").orderBy(F.xxhash64("centre", "u"))
        back = ahead.select(F.col("u").alias("centre"), F.col("centre").alias("u")).withColumn("r", F.row_number().over(turn)).where(f"r <= {self.k}").drop("r")
        meet = ahead.unionByName(back).distinct()
        least = self.graph.select(F.col("node").alias("u"), F.when(F.size("list") < self.k, F.lit(-2.0)).otherwise(F.element_at("list", -1)["cos"]).cast("float").alias("least"))
        known = self.single.withColumnRenamed("node", "u").join(least, "u", "left").select("u", "v", F.coalesce("least", F.lit(-2.0).cast("float")).alias("least"))
        buckets = max(1, -(-self.n // 1024))
        full = meet.join(known, "u").withColumn("bucket", F.pmod(F.xxhash64("centre"), F.lit(buckets)))
        found = full.groupBy("bucket").applyInArrow(_meet, "node long, near long, cos float")
        self.graph = self._lists(found.unionByName(self._flat()))

    def against(self, left: DataFrame, n: int, right: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over each block of ``left`` (``n`` rows) beside each block of ``right`` (classes)."""
        blocks = [-(-k // WIDE) or 1 for k in (n, self.n)]
        own, other = (F.pmod(F.xxhash64("node"), F.lit(b)).cast("int") for b in blocks)
        across = [F.explode(F.sequence(F.lit(0), F.lit(b - 1))) for b in blocks]
        both = left.select("*", F.lit(0).alias("side"), own.alias("i"), across[1].alias("j"))
        both = both.unionByName(right.select("*", F.lit(1).alias("side"), across[0].alias("i"), other.alias("j")), allowMissingColumns=True)
        return both.groupBy("i", "j").applyInArrow(run, schema)

    def bridges(self, roots: DataFrame, crowded: DataFrame) -> DataFrame | None:
        """Links that join saturated components (``crowded``) to whatever has a link with a member; None without any."""
        crowded, _ = materialize(crowded, "nn-crowded")
        if not (n := crowded.count()):
            return None
        units = self.classes.select("node", "unit")
        members = roots.join(crowded, "root").join(units, "node").select("root", "node", "unit")
        pivots = units.withColumnRenamed("node", "root").join(crowded, "root").select("root", F.col("unit").alias("pivot"))
        radius = members.join(pivots, "root").select("root", "unit", "pivot").mapInArrow(_cosines, "root long, cos double").groupBy("root").agg(F.min("cos").alias("cos"))
        left = pivots.join(radius, "root").select("root", F.col("root").alias("node"), F.col("pivot").alias("unit"), "cos")
        right = units.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "unit")
        near, _ = materialize(self.against(left, n, right, _reach(self.threshold), "root long, node long"), "nn-near")
        sizes = near.groupBy("root").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("a"))
        sizes = sizes.join(roots.groupBy("root").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("b")), "root")
        own, across = (lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
        outer = near.join(sizes, "root").select("root", "node", F.lit(0).alias("side"), own("a").alias("i"), across("b").alias("j"))
        inner = roots.join(sizes, "root").select("root", "node", F.lit(1).alias("side"), across("a").alias("i"), own("b").alias("j"))
        met = outer.unionByName(inner).join(units, "node").select("root", "i", "j", "node", "side", "unit")
        more, _ = materialize(met.groupBy("root", "i", "j").applyInArrow(_join(self.threshold), "u long, v long"), "nn-bridges")
        return None if more.isEmpty() else more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def resolve(self) -> DataFrame:
        """vec_id, n_links, component_id of every row."""
        close = self._flat().where(F.col("cos") >= self.threshold - SLACK).select(F.least("node", "near").alias("u"), F.greatest("node", "near").alias("v")).distinct()
        a, b = (self.classes.select(F.col("node").alias(k), F.col("unit").alias(f"x{k}")) for k in "uv")
        met = close.join(a, "u").join(b, "v").select("u", "v", "xu", "xv")
        links, _ = materialize(met.mapInArrow(_exact(self.threshold), "u long, v long"), "nn-links", self.n * self.k)
        roots = components(links)
        full = self.graph.where((F.size("list") == self.k) & (F.element_at("list", -1)["cos"] >= self.threshold - SLACK)).select("node")
        crowded = roots.join(full, "node").select("root").distinct()
        more = self.bridges(roots, crowded)
        if more is not None:
            links = links.unionByName(more)
            roots = components(links)
            crowded = roots.join(full, "node").select("root").distinct()
        sizes = roots.join(crowded, "root").groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = roots.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node").join(self.classes.select("node", "unit", "weight"), "node")
        crowd = cells.groupBy("root", "i", "j").applyInArrow(_block_counts(self.threshold), "node long, n long, m long")
        sparse = roots.join(crowded, "root", "left_anti").select("node")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        weights = self.classes.select(F.col("node").alias("v"), "weight")
        few = both.join(sparse.withColumnRenamed("node", "u"), "u", "left_semi").join(weights, "v").select(F.col("u").alias("node"), F.col("weight").alias("n"), F.lit(1).cast("long").alias("m"))
        return self._rows(crowd.unionByName(few), roots)

    def exact(self) -> DataFrame:
        """The same from the comparison of all classes with all."""
        every = self.classes.select("node", "unit", "weight")
        met, _ = materialize(self.against(every, self.n, every, _links(self.threshold, True), LINKS), "nn-exact")
        roots = components(met.where("near is not null").select(F.col("node").alias("u"), F.col("near").alias("v")))
        return self._rows(met.where("near is null"), roots)

    def _rows(self, counts: DataFrame, roots: DataFrame) -> DataFrame:
        """From parts of the counts of classes (node, n, m) and components to rows; :attr:`known` keeps the sums."""
        counts = counts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        known = self.classes.join(counts, "node", "left").join(roots, "node", "left").select("node", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("root", "node").alias("root"))
        known, _ = materialize(known, "nn-counts")
        self.known = known
        low = known.groupBy("root").agg(F.min("id").alias("component_id"))
        by_node = known.join(low, "root").select("node", "n_links", "component_id")
        usable = F.col("node").isNotNull() & F.col("vec_id").isNotNull()
        linked = self.rows.where(usable).join(by_node, "node").select("vec_id", "n_links", "component_id")
        alone = self.rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return linked.unionByName(alone)

    def audited(self, asked: DataFrame) -> list[tuple[int, float]]:
        """By stratum: how many of the ``asked`` classes are linked, and their mean share of linked classes that :meth:`resolve` counted."""
        every = self.classes.select("node", "unit", "weight")
        asked, _ = materialize(every.join(asked, "node"), "nn-asked")
        met = self.against(asked, asked.count(), every, _links(self.threshold, False), LINKS)
        true = met.groupBy("node").agg(F.sum("m").alias("true")).where(F.col("true") > 0).join(self.known.select("node", "m"), "node")
        stratum = sum((F.col("true") > top).cast("int") for top in STRATA)
        found = true.groupBy(stratum.alias("s")).agg(F.count("*").alias("n"), F.avg(F.least("m", "true") / F.col("true")).alias("r")).collect()
        return [(x.n, x.r) for x in found]

    def recall(self) -> float | None:
        """Least mean recall over the strata of the audited classes; None if no audited class has a link.

        Those with an id divisible by 50 are asked first. Where under ``LINKED`` of
        them are linked, classes drawn by hash are asked too, and in a table of up
        to ``SMALL`` classes all of them, so that there a recall of 1 without any
        link is measured as well.
        """
        ids = self.rows.where("node is not null and vec_id % 50 = 0").select("node").distinct()
        found = self.audited(ids)
        if sum(n for n, _ in found) < LINKED:
            if self.n <= SMALL:
                found = self.audited(self.classes.select("node")) or [(0, 1.0)]
            else:
                found = self.audited(ids.unionByName(self.classes.where(F.pmod(F.xxhash64("node"), F.lit(DRAWN)) == 0).select("node")).distinct())
        return min((r for _, r in found), default=None)


def near_vectors(df: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, and how it was found: ``recall`` of the audit, ``exact``."""
    s = Search(df, threshold, id_col, vector_col)
    for turn in range(AUDITS):
        s.start(turn)
        before = -1
        for _ in range(ROUNDS):
            s.descend()
            if (now := s.links_found()) == before:
                break
            before = now
        found, _ = materialize(s.resolve(), "nn-found")
        exact, recall = False, s.recall()
        if recall is None or recall >= RECALL:
            break
    else:
        found, _ = materialize(s.exact(), "nn-found")
        exact, recall = True, 1.0
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"), F.lit(recall).cast("double").alias("recall"), F.lit(exact).alias("exact"))


def op7_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
