"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex
_LOCAL: dict[str, str] = {}
_SWEPT: set[str] = set()
_SCOPES = threading.local()

HEAVY = 2_000
HOT_KEYS = 1_000_000
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; a temporary folder takes
    its place. On a cluster, where executors would write to disks of their own,
    its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        base = _LOCAL["dir"]
    return f"{base.rstrip('/')}/tidemark-{_RUN}"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`materialize` wrote and nothing reads any more."""
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def materialize(df: DataFrame, name: str, rows: int | None = None, per_file: int = 25_000) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that outlives a lost executor. ``rows``: at most so
    many come out, so ``rows / per_file`` files do. Returns the new DataFrame and
    its path.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _SWEPT:
        _SWEPT.add(base)
        atexit.register(_sweep, spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that this thread writes inside are deleted at the end, but those in the list it yields.

    Tables that stay belong to the scope around, if there is one.
    """
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    keep: list[str] = []
    _SCOPES.open.append([])
    try:
        yield keep
    finally:
        own = _SCOPES.open.pop()
        remove(spark, *(p for p in own if p not in keep))
        if _SCOPES.open:
            _SCOPES.open[-1] += [p for p in own if p in keep]


def _sweep(spark: SparkSession, base: str) -> None:
    try:
        remove(spark, base)
    except Exception:  # the session is gone already; the folder is a scratch one
        pass


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", heavy: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key`` without bringing all rows of a heavy key to one task.

    ``right`` has one row a key, whose ``weight`` (dropped) is how many rows of
    ``left`` have it, or more. Keys beyond ``heavy`` (``HEAVY``) rows are salted: their rows of
    ``right`` are repeated, the rows of ``left`` dealt in turn. The numbers of salts
    are broadcast; as weights add up, the limit leaves ``HOT_KEYS`` of them at most.
    ``left`` should be a stored table, whose rows keep their order if a task is repeated.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    limit = max(heavy or HEAVY, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return left.join(right.drop(weight), key, how)
    parts = F.ceil(F.col(weight) / limit).cast("int")
    hot = right.where(F.col(weight) > limit).select(key, parts.alias("_parts"))
    turn = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", turn).drop("_parts")
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(weight)
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of at most ``rows`` rows and about ``size`` bytes of the text column (one longer text is alone)."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
        start = used = 0
        for k, n in enumerate(lens):
            if k > start and (used + n > size or k - start == rows):
                yield batch.slice(start, k - start)
                start, used = k, 0
            used += n
        if start < batch.num_rows:
            yield batch.slice(start)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id counts as "")."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
