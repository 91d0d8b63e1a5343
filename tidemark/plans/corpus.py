"""The test tables seen as managed tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as indexes
from ..schema import CELLS, GRAM_SETS, POSTINGS

NOW = datetime(2024, 2, 1)
MODEL, DIM = "model-a", 64

#: A client's batch: id, text, the row of ``embeddings`` that stands for its vector.
BATCH = [(0, "the on", 0), (1, "was the ha", 1), (2, "latest for", 2), (3, "zqx vkq", 3), (4, "of", 4)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as stored chunks, with vectors and times where ids match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = docs.join(vectors, "doc_id", "left").join(times, "doc_id", "left")
    return rows.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
        F.col("source").alias("session_id"),
        F.col("lang").alias("source_type"),
        F.col("text").alias("content"),
        "embedding",
        F.when(F.col("doc_id") % 10 == 9, "model-b").otherwise("model-a").alias("embedding_model"),
        F.when(F.col("doc_id") % 11 != 0, F.col("ts")).alias("timestamp_start"),
        F.when(F.col("doc_id") % 33 != 0, F.col("ts")).alias("created_at"),
        "doc_id",
    )


CHUNKS = """chunks AS (
  SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS id, d.source AS session_id, d.lang AS source_type, d.text AS content, e.embedding,
    CASE WHEN d.doc_id % 10 = 9 THEN 'model-b' ELSE 'model-a' END AS embedding_model,
    CASE WHEN d.doc_id % 11 <> 0 THEN v.ts END AS timestamp_start, CASE WHEN d.doc_id % 33 <> 0 THEN v.ts END AS created_at, d.doc_id
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN events v ON v.event_id = d.doc_id)"""


def _marks(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells the present state of the tables that chunks come from."""
    out = []
    for name in ("documents", "embeddings", "events"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        own = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((own.getModificationTime(), own.getLen()))
    return tuple(out)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or a temporary one of a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


class Stored:
    """:func:`chunks` and their indexes as a store keeps them, each built at its first use in a session, as ingest would have."""

    cells = None  # registered searches compare all vectors

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.at = spark, sf_dir, scratch(spark, "index")

    def _table(self, name: str, rows: DataFrame, schema) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}")

    @cached_property
    def rows(self) -> DataFrame:
        """The chunks as a table: their texts pass a join once, not in each channel of each search."""
        rows = chunks(self.spark, self.sf_dir)
        return self._table("chunks", rows, rows.schema)

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings", indexes.postings(self.rows), POSTINGS)

    @cached_property
    def order(self) -> dict[str, int]:
        return indexes.gram_order(self.rows)

    @cached_property
    def grams(self) -> DataFrame:
        return self._table("grams", indexes.gram_sets(self.rows, self.order), GRAM_SETS)

    @cached_property
    def all_cells(self) -> indexes.Cells:
        centre = indexes.train(self.rows.where("embedding IS NOT NULL").select("id", "embedding"), DIM)
        return indexes.Cells(self._table("cells", indexes.cells(self.rows, centre), CELLS), centre, len(centre))


_BUILT: dict[tuple, Stored] = {}


def index(spark: SparkSession, sf_dir: str) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir, _marks(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = Stored(spark, sf_dir)
    return _BUILT[key]


def queries(spark: SparkSession, sf_dir: str, limit: int = 5, offset: int = 0) -> DataFrame:
    asked = spark.createDataFrame(BATCH, "query_id int, text string, vec_id long")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return asked.join(vectors, "vec_id", "left").select("query_id", "text", "embedding", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


_ROWS = ", ".join(f"({q}, '{t}', {v})" for q, t, v in BATCH)
QUERIES = f"""queries AS (
  SELECT b.query_id, b.text, e.embedding FROM (VALUES {_ROWS}) b(query_id, text, vec_id) LEFT JOIN embeddings e ON e.vec_id = b.vec_id)"""
