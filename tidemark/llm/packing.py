"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising. Ids are those of the ``tokenizers`` library for the given file. For
a plain byte-level BPE file (ids in merge order, the usual pattern, no
normaliser) the file's vocabulary is handed to ``tiktoken``'s faster merge loop
over the same pattern; texts that hold an added token, or that its pattern
engine gives up on, go through the library, and so does every text for any
other kind of file. Documents longer than a sequence are cut into full pieces;
the remainder, if any, is the first piece.

Packing. Only piece lengths travel: pieces are spread evenly over partitions
of about ``PIECES`` pieces by a hash of their columns and their place in the
stored table, so equal rows do not meet, and each partition runs a
bounded-space online best fit: windows of ``WINDOW`` pieces arrive one after
another, longest piece first; open bins lie in stacks by free space, a bitset
marks the stacks in use, the tightest bin that fits is one shift and one
lowest-set-bit away, and when ``OPEN_BINS`` bins are open the fullest closes
first. A full piece fills a sequence at once. At most ``OPEN_BINS`` bins end
underfull in each partition.

Edge cases: null or empty text is the end id alone; null ids make pieces of
their own; repeated rows (same id) are packed each, their pieces told apart by
sequence and offset; very long texts are encoded whole, in slices bounded by
bytes; an empty table gives no sequences. Extra columns are
ignored by the tokeniser and kept by :func:`best_fit`.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, table

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 4096
PIECES = 100_000
WINDOW = 8192
#: The pattern of a byte-level tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and merge ranks of a plain byte-level BPE file, else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), model.get("type")) != ("ByteLevel", False, True, "BPE"):
        return None
    if any((spec.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or {vocab.get(c) for c in byte} != set(range(256)):
        return None
    return {bytes(byte[c] for c in piece): k for piece, k in vocab.items() if piece not in added}


class Encoder:
    """Text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        spec = json.loads(self.library.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = byte_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and not any(a in text for a in self.added):
            try:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            except ValueError:  # a run of white space too long for its pattern engine
                pass
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _pieces(tokenizer_file: str, size: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_file)
        for b in slices(batches, 1):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                rows += [(doc_id, k, s, e - s, ids[4 * s : 4 * e]) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(df: DataFrame, tokenizer_file: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids of each piece, as little-endian 32-bit."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_file, size, end_id), PIECE_SCHEMA)


class Bins:
    """Open bins in stacks by free space, with a bitset of the stacks in use."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def _pop(self, free: int) -> int:
        bin_ = self.stacks[free].pop()
        if not self.stacks[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.open >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest
            free, bin_ = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.stacks[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - free


def _place(at: int, size: int, limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, Bins(size, limit)
        for batch in batches:
            for start in range(0, batch.num_rows, window):
                b = batch.slice(start, window)
                lengths = b.column(at).to_pylist()
                found = [(0, 0)] * len(lengths)
                for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
                    found[k] = bins.place(lengths[k])
                own = [pa.array([base + x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def best_fit(pieces: DataFrame, *, size: int = SEQUENCE, open_bins: int = OPEN_BINS, per_partition: int = PIECES, length_col: str = "length", window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (in place of columns of that name) to rows of lengths from 1 to ``size``.

    Takes one pass over a stored table of pieces: the count sizes the
    partitions, and the sort makes a task's repetition give the same bins.
    """
    pieces = pieces.drop("sequence_id", "offset")
    parts = max(1, -(-pieces.count() // per_partition))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    place = _place(pieces.columns.index(length_col), size, open_bins, window)
    at = max(pieces.columns, key=len) + "_at"  # a name that no column has
    dealt = pieces.withColumn(at, F.monotonically_increasing_id())
    spread = F.xxhash64(at, *pieces.columns)
    return dealt.repartition(parts, spread).sortWithinPartitions(spread, at).drop(at).mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer_file: str, *, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; a row per piece, with the crc32 of its ids."""
    cut = token_pieces(df, tokenizer_file, size=size, end_id=end_id, id_col=id_col, text_col=text_col)
    lengths, _ = materialize(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return best_fit(lengths, size=size)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
