"""Byte-pair tokens of a session, encoded item by item with the results of one joint encoding.

A byte-pair encoder first splits a text by a pattern and merges bytes inside
each part only, so a text may be cut wherever the pattern always cuts. Between
two items there is white space with a line feed. Patterns differ in where they
cut it: ``before`` the whole run, or ``after`` its last line feed (where
punctuation takes the line feeds after it). ``BytePairs`` finds out which holds
by splitting samples of all contexts, and refuses a pattern for which neither
does. Each piece is then encoded in an Arrow function; it carries the ends of
its tokens in bytes, so tokens that end inside a character are kept exactly.

Edge cases: null and blank items have no tokens of their own, and their white
space goes to the pieces beside them; a session of white space alone has no
tokens; special tokens inside a text are ordinary text. An item of any length
is one row, as it is in the source.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError

# Split patterns as published with the vocabularies.
PATTERNS = {
    "gpt2": r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    "cl100k": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+""",
}
LEFT = ("a", "\u00c9", "7", "12345", ".", "!?", "'", "/", "\u8a9e", "a'", "[x]", "e\u0301")
RIGHT = ("[user] a", "a", "\u00c9", "7", ".", "/", "'s", "'", "\u8a9e", "\u0301", "(")
BLANKS = (" ", "\n", "\r", "\t", "\u00a0", "\u3000")
TOKENS = "text binary, ends array<int>, own array<int>"


def cut_at(gap: str, rule: str) -> int:
    """Where a white run between items is cut."""
    return 0 if rule == "before" else max(gap.rfind("\n"), gap.rfind("\r")) + 1


class BytePairs:
    """A vocabulary file of base64 tokens and ranks, and the pattern (or its name in ``PATTERNS``) that it goes with."""

    def __init__(self, path: str, pattern: str = "gpt2"):
        try:
            with open(path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        except (OSError, ValueError) as e:
            raise ConfigError("the vocabulary can't be read", code="invalid_vocabulary") from e
        self.pattern = PATTERNS.get(pattern, pattern)
        self.rule = self._rule()

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("chunks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _rule(self) -> str:
        """The rule that agrees with the pattern on every sampled context."""
        import regex

        parts = regex.compile(self.pattern)
        gaps = ["".join(g) for n in (1, 2, 3) for g in itertools.product(BLANKS, repeat=n) if "\n" in g]
        for rule in ("before", "after"):
            if all(
                parts.findall(left + gap + right) == parts.findall(left + gap[: cut_at(gap, rule)]) + parts.findall(gap[cut_at(gap, rule) :] + right)
                for left, gap, right in itertools.product(LEFT, gaps, RIGHT)
            ):
                return rule
        raise ConfigError("the pattern has no cut between items", code="invalid_pattern")


def pieces(items: DataFrame, session: list[str], order: list[Column], rule: str) -> DataFrame:
    """``seq, piece, skip, chars`` of every item that is not blank; a session's pieces, joined, are its text.

    ``skip`` characters of a piece stand before the item's own ``chars`` characters.
    """
    own = Window.partitionBy(*session).orderBy("seq")
    rows = items.withColumn("seq", F.row_number().over(Window.partitionBy(*session).orderBy(*order)))
    raw = F.concat(F.when(F.col("seq") > 1, "\n").otherwise(""), F.coalesce("item", F.lit("")))
    rows = rows.withColumn("raw", raw).withColumn("head", F.regexp_extract("raw", r"^(?U)\s*", 0)).withColumn("blank", F.length("head") == F.length("raw"))
    rows = rows.withColumn("tail", F.when(F.col("blank"), "").otherwise(F.regexp_extract("raw", r"(?U)(?<!\s)\s+\z", 0)))
    rows = rows.withColumn("core", F.expr("substr(raw, length(head) + 1, length(raw) - length(head) - length(tail))"))
    # A group is a run of blank items with the item after it; its last row sees the whole gap.
    rows = rows.withColumn("around", F.concat(F.coalesce(F.lag("tail").over(own), F.lit("")), "head"))
    rows = rows.withColumn("g", F.coalesce(F.sum((~F.col("blank")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("gap", F.array_join(F.collect_list("around").over(Window.partitionBy(*session, "g").orderBy("seq")), ""))
    rows = rows.withColumn("final", F.lead("seq").over(own).isNull()).where(~F.col("blank") | F.col("final"))
    at = F.length(F.regexp_extract("gap", r"^(?s).*[\r\n]", 0)) if rule == "after" else F.lit(0)
    rows = rows.withColumn("at", F.when(F.lag("seq").over(own).isNull(), 0).otherwise(at))
    rest = F.expr("substr(gap, at + 1)")
    following = F.lead(F.when(F.col("blank"), F.col("gap")).otherwise(F.expr("substr(gap, 1, at)"))).over(own)
    done = rows.withColumn("piece", F.concat(rest, "core", F.coalesce(following, "tail"))).withColumn("skip", F.length(rest)).withColumn("chars", F.length("core"))
    return done.where(~F.col("blank")).select(*session, "seq", "ts", "turn_index", "piece", "skip", "chars")


def _encode(pairs: BytePairs, kept: list[str]):
    ranks, pattern = pairs.ranks, pairs.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import tiktoken

        enc = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, k in ranks.items():
            size[k] = len(token)

        def tokens(text: str, skip: int, chars: int):
            data = text.encode()
            ends = np.cumsum(size[np.array(enc.encode_ordinary(text), np.int64)])
            if len(data) != (ends[-1] if len(ends) else 0):
                raise ValueError("the vocabulary does not cover all bytes")
            starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters that start up to a byte
            return data, ends.astype(np.int32), np.clip(starts[ends - 1] - skip, 0, chars).astype(np.int32)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                named = {f.name: part.column(k) for k, f in enumerate(part.schema)}
                cut = [tokens(*x) for x in zip(*(named[c].to_pylist() for c in ("piece", "skip", "chars")), strict=True)]
                columns = [pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.list_(pa.int32())), pa.array([c[2] for c in cut], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(named[c] for c in kept), *columns], names=[*kept, "text", "ends", "own"])

    return run


def spans(items: DataFrame, session: list[str], order: list[Column], pairs: BytePairs) -> DataFrame:
    """Pieces as bytes with, at each token, its end (``ends``) and the item's characters begun so far (``own``)."""
    cut = pieces(items, session, order, pairs.rule)
    kept = [*session, "seq", "ts", "turn_index"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*kept).schema)
    return cut.mapInArrow(_encode(pairs, kept), f"{types}, {TOKENS}").withColumn("n", F.size("ends").cast("long"))


def upto(column: str, k: Column) -> Column:
    """The running value before token ``k``."""
    return F.coalesce(F.get(F.col(column), (k - 1).cast("int")), F.lit(0))


def decoded(parts: Column) -> Column:
    """Bytes joined, as text; what is left of a character that a window cuts is U+FFFD."""
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["body"])), "")).cast("string"))
