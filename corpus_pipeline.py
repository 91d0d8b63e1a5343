"""From raw documents to packed sequences: four stages over one table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the rows are written
as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, packing, quality, toxicity
from tidemark.llm.common import materialize, remove, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more."""
    return minhash.keep_first(docs, shingle=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-duplicates", drop_copies), ("packing", pack)]

#: SQL cannot express the trained classifier, zstandard or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, at = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(at)
        if before:
            remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
