"""Quality rules with compression bands.

Two base rules come first (too few words; too many words in repeated windows
of eight). Texts that pass are compressed with zstandard, whole and in fixed
chunks of ``CHUNK`` bytes, and the ratio of compressed to plain bytes must lie
inside the band for that length: below it text is repetitive, above it
incompressible (encoded or random data). Short texts compress badly whatever
they say, so ``BANDS`` depends on length and texts under its first length have
no band. A document is rejected when its whole ratio is outside its band, or
when chunks outside theirs hold more than ``BAD_SHARE`` of its bytes.

One map over the rows, no shuffle. Work inside a batch is vectorised over
slices bounded by rows and bytes, so very long texts are judged whole.

Edge cases: null text has no words, all counts are 0 and it fails the base
rule, like an empty one; null ids are kept; repeated rows are judged each; an
empty table gives no rows. Extra columns are ignored by :func:`quality` and
kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .words import fresh, mix, split_words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
LEVEL = 3
CHUNK = 2048
BAD_SHARE = 0.5
#: From this many bytes on: the smallest and the largest ratio allowed.
BANDS = ((128, 0.30, 1.10), (256, 0.28, 0.95), (512, 0.26, 0.85), (1024, 0.24, 0.80), (2048, 0.22, 0.75), (8192, 0.20, 0.72), (32768, 0.18, 0.70))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, min_chunk_ratio double, max_chunk_ratio double, bad_share double, reason string"
)


def repeat_words(codes: np.ndarray, lens: np.ndarray, window: int) -> np.ndarray:
    """Words of each text inside windows that the text holds twice or more."""
    if len(codes) < window:
        return np.zeros(len(lens), np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    n = len(codes) - window + 1
    h = doc[:n].astype(np.uint64)
    for k in range(window):
        h = mix(h, codes[k : k + n])
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    _, inv, count = np.unique(h[inside], return_inverse=True, return_counts=True)
    twice = inside[count[inv] > 1]
    edge = np.bincount(twice, minlength=len(codes) + 1) - np.bincount(twice + window, minlength=len(codes) + 1)
    return np.bincount(doc, weights=np.cumsum(edge)[:-1] > 0, minlength=len(lens)).astype(np.int64)


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def band(n: int) -> tuple[float, float]:
    own = [(lo, hi) for least, lo, hi in BANDS if n >= least]
    return own[-1] if own else (0.0, float("inf"))


def compression(data: bytes, z: zstandard.ZstdCompressor) -> tuple[bool, float | None, float | None, float | None, float | None, str | None]:
    """(inside the bands, whole ratio, least and greatest chunk ratio, share of bytes in bad chunks, reason)."""
    if not data:
        return True, None, None, None, None, None
    whole = len(z.compress(data)) / len(data)
    lo, hi = band(len(data))
    if whole < lo or whole > hi:
        return False, whole, None, None, None, "repetitive" if whole < lo else "incompressible"
    parts = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
    ratios = [len(z.compress(p)) / len(p) for p in parts]
    bands = [band(len(p)) for p in parts]
    low = sum(len(p) for p, r, b in zip(parts, ratios, bands, strict=True) if r < b[0])
    high = sum(len(p) for p, r, b in zip(parts, ratios, bands, strict=True) if r > b[1])
    share = (low + high) / len(data)
    good = share <= BAD_SHARE
    return good, whole, min(ratios), max(ratios), share, None if good else "repetitive chunks" if low >= high else "incompressible chunks"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=LEVEL)
    for b in slices(batches, 1):
        texts = fresh(b.column(1))
        words, n = split_words(texts)
        repeated = repeat_words(words.indices.to_numpy().astype(np.uint64), n, WINDOW)
        chars = pc.subtract(pc.utf8_length(texts), pc.count_substring_regex(texts, "[ \t-\r]")).cast(pa.int64())
        symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64())
        plain = texts.to_pylist()
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
        found = [(False, None, None, None, None, "base") if f else compression(t.encode(), z) for f, t in zip(failed, plain, strict=True)]
        good, *rest = zip(*found, strict=True)
        columns = [b.column(0), pa.array(n.astype(np.int64)), chars, symbols, pa.array([dup_lines(t) for t in plain], pa.int64()), pa.array(repeated)]
        columns += [pa.array(failed), pa.array(good), *(pa.array(x, t) for x, t in zip(rest, [pa.float64()] * 4 + [pa.string()], strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in SCHEMA.split(", ")])


def quality(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios and verdict of every row (``SCHEMA``)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_judge, SCHEMA)


def _keep(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            ids = pa.array(np.arange(b.num_rows))
            for found in _judge([pa.RecordBatch.from_arrays([ids, b.column(at)], names=["doc_id", "text"])]):
                yield b.filter(found.column(7))

    return run


def keep_good(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    return df.mapInArrow(_keep(df.columns.index(text_col)), df.schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
