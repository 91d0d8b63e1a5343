"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary holds a whitespace marker after another character
or a line feed, so no merge crosses the start of a marker run or either side
of a line feed. A text (with the library's leading marker) is cut there, each
distinct chunk is segmented once by the library, and the ids are joined back
by position. The condition is checked when a model is loaded; a model that
breaks it is encoded text by text.

The table lives in the task, so encoding needs no shuffle; it is emptied when
it holds ``TABLE_CHUNKS`` chunks, and chunks over ``LONG_CHUNK`` characters
stay out of it (they are segmented whenever they occur).

Edge cases: null and empty texts have no ids and decode to ""; null ids are
kept; repeated rows come out as often as they go in; very long texts are encoded
whole, in slices bounded by bytes; literal U+2581 counts as
a marker, as in the library. Extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

MODEL = "piece_bpe_32k.model"
TABLE_CHUNKS = 200_000
LONG_CHUNK = 64
CHUNK = re.compile("\n|[ ▁]+[^ ▁\n]*|[^ ▁\n]+")
CROSSES = re.compile("[^▁]▁|\n")


class ChunkTable:
    """Segments each distinct chunk once: chunk -> (ids as int32 bytes, text)."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.whole = any(CROSSES.search(p) for p in pieces) or self.sp.encode("\n") != [self.sp.piece_to_id("▁"), self.sp.piece_to_id("<0x0A>")]
        self.table: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        # A line feed before the chunk keeps the leading marker away from it.
        ids = self.sp.encode(["\n" + c for c in chunks], num_threads=1)
        texts = self.sp.decode(ids, num_threads=1)
        return [(array("i", i[2:]).tobytes(), t[1:]) for i, t in zip(ids, texts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        if self.whole:
            ids = [self.sp.encode(t) for t in texts]
            return [array("i", i).tobytes() for i in ids], [self.sp.decode(i) for i in ids]
        cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
        if len(self.table) > TABLE_CHUNKS:
            self.table = {}
        missing = list(set().union(*cut).difference(self.table))
        new = dict(zip(missing, self._segment(missing), strict=True)) if missing else {}
        get = (self.table | new).__getitem__ if len(new) > TABLE_CHUNKS else None
        if get is None:
            self.table.update(new)
            get = self.table.__getitem__
        found = [[get(c) for c in chunks] for chunks in cut]
        for c in new:
            if len(c) > LONG_CHUNK:
                self.table.pop(c, None)
        return [b"".join([e[0] for e in f]) for f in found], ["".join([e[1] for e in f])[1:] for f in found]


def _encode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_file)
        for b in slices(batches, 1):
            ids, texts = chunks.encode([t or "" for t in b.column(1).to_pylist()])
            ends = [0]
            for i in ids:
                ends.append(ends[-1] + len(i) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_documents(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded``: the library's ids of each text and its decoding of them."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(model_file), "doc_id long, ids array<int>, decoded string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
