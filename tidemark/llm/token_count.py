"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts longer than ``SEGMENT`` characters are split at safe boundaries: before
a blank that follows a character that is no whitespace marker. No piece holds
a marker after another character, so the two sides encode independently, and
the blank is replaced by the leading marker that the library gives the second
side. Segments are encoded in batches of about ``BATCH_BYTES`` bytes whatever
the number of rows. A model whose pieces break the condition is encoded
without splitting.

Edge cases: null and empty texts have no tokens; a text without a safe
boundary stays whole; null ids are kept; repeated rows are counted each.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SEGMENT = 32_768
BATCH_BYTES = 1 << 20
CROSSES = re.compile("[^▁]▁")
SAFE = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces of about ``size`` characters that encode independently."""
    out, at = [], 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def balanced(parts: list[str], size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive parts of about ``size`` bytes each."""
    start = used = 0
    for k, p in enumerate(parts):
        n = len(p) if p.isascii() else len(p.encode())
        if k > start and used + n > size:
            yield start, k
            start, used = k, 0
        used += n
    if start < len(parts):
        yield start, len(parts)


def _count(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = 1 << 62 if any(CROSSES.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())) else SEGMENT
        for batch in slices(batches, 1, rows=10_000):
            parts, owner = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = segments(text or "", size)
                parts += own
                owner += [k] * len(own)
            lens = [len(x) for a, b in balanced(parts) for x in sp.encode(parts[a:b], num_threads=1)]
            total = np.bincount(np.array(owner, np.int64), weights=lens, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_count(model_file), "doc_id long, n_bytes long, n_tokens long")


def op8_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
