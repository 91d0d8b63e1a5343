"""Managed tables, their column types, and the constants of the contract."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


CHUNKS = _struct(
    ("id", T.StringType()),
    ("session_id", T.StringType()),
    ("source_type", T.StringType()),
    ("content", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("embedding_model", T.StringType()),
    ("timestamp_start", T.TimestampType()),
    ("timestamp_end", T.TimestampType()),
    ("turn_index_start", T.IntegerType()),
    ("turn_index_end", T.IntegerType()),
    ("channel", T.StringType()),
    ("metadata", T.StringType()),
    ("created_at", T.TimestampType()),
)

CHECKPOINTS = _struct(
    ("file_path", T.StringType()),
    ("file_mtime", T.TimestampType()),
    ("file_size", T.LongType()),
    ("processed_offset", T.LongType()),
    ("processed_at", T.TimestampType()),
    ("source_type", T.StringType()),
    ("chunks_created", T.IntegerType()),
    ("facts_created", T.IntegerType()),
)

FACTS = _struct(
    ("id", T.StringType()),
    ("session_id", T.StringType()),
    ("category", T.StringType()),
    ("content", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("embedding_model", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("task_summary", T.StringType()),
    ("metadata", T.StringType()),
    ("created_at", T.TimestampType()),
)

#: Indexes derived from chunks; always possible to rebuild, so in no ledger and no backup.
POSTINGS = _struct(("term", T.StringType()), ("session_id", T.StringType()), ("docs", T.ArrayType(_struct(("id", T.StringType()), ("gaps", T.ArrayType(T.IntegerType()))))))
CELLS = _struct(("cell", T.IntegerType()), ("session_id", T.StringType()), ("id", T.StringType()), ("embedding", T.ArrayType(T.FloatType())))
CENTROIDS = _struct(("cell", T.IntegerType()), ("centroid", T.ArrayType(T.FloatType())), ("probes", T.IntegerType()))
GRAM_SETS = _struct(("m", T.IntegerType()), ("session_id", T.StringType()), ("id", T.StringType()), ("grams", T.ArrayType(T.StringType())))
GRAM_ORDER = _struct(("gram", T.StringType()), ("place", T.IntegerType()))
DERIVED = {"chunk_gram_sets": GRAM_SETS, "chunk_gram_order": GRAM_ORDER, "chunk_postings": POSTINGS, "chunk_cells": CELLS, "chunk_centroids": CENTROIDS}

TABLES = {"session_chunks": CHUNKS, "ingestion_state": CHECKPOINTS, "session_facts": FACTS}

# Fixed values of the retrieval contract.
HALF_LIFE_DAYS = 30.0
NO_TIME_PRIOR = 0.25
SAME_CONTENT_COSINE = 0.85
RRF_K = 60
DEFAULT_LIMIT, MAX_PAGE_LIMIT, MAX_SEARCH_LIMIT, MAX_OFFSET = 5, 20, 256, 255
MIN_POOL, MAX_POOL, POOL_FACTOR = 30, 1000, 5
MAX_QUERY_CHARS, MAX_EXACT_CHARS = 8000, 20
MAX_FILTER_VALUES, MAX_SOURCE_TYPE_LEN, MAX_SESSION_ID_LEN = 50, 50, 128
#: Queries of one batch: a client's, small enough to be broadcast.
MAX_BATCH = 10_000
EMBED_DIM, MAX_EMBED_CHARS = 1024, 32000
TRIGRAM_THRESHOLD = 0.3

# Fixed values of the ingest contract.
CHUNK_TOKENS, CHUNK_OVERLAP = 400, 80
MIN_MESSAGE_CHARS, MIN_ITEM_CHARS = 5, 10
CLASSIFY_LINES, CLASSIFY_CHARS = 20, 200
CHAT_TYPES = (0, 19)
RETENTION_DAYS = {"sessions": 90, "store": 90, "chat": 30}
