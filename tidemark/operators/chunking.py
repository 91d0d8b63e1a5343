"""Overlapping token windows over the joined items of a session.

A session's text is its items with a line feed between. Each item is tokenised
apart, with the line feed before it, into strings whose concatenation is that
text; by default (``regex`` tokenizer) a token is a word with the white space
before it. Tokens are numbered by a running sum over the items, and each item
sends its tokens to the windows that they fall into, so no row ever holds more
than an item or a window and the work is linear in a session's length.

``BytePairs`` as the tokenizer gives the windows of a joint byte-pair encoding
(see ``bytepair``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHUNK_OVERLAP, CHUNK_TOKENS
from . import bytepair


def tokens(text: Column | str) -> Column:
    """Lossless tokens: runs of white space with the word after them."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"\s*\S+|\s+"), F.lit(0))


def windows(n: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Starts of the windows over ``n`` tokens: one if they fit, else every ``size - overlap``."""
    stride = size - overlap
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))


def spans(items: DataFrame, session: list[str], order: list[Column], tokenizer=tokens) -> DataFrame:
    """Items numbered in their session (``seq``), with their ``tokens`` and how many stand before, in all, and in the session."""
    if isinstance(tokenizer, bytepair.BytePairs):
        cut = bytepair.spans(items, session, order, tokenizer)
    else:
        numbered = items.withColumn("seq", F.row_number().over(Window.partitionBy(*session).orderBy(*order)))
        text = F.when(F.col("seq") > 1, F.concat(F.lit("\n"), F.col("item"))).otherwise(F.col("item"))
        cut = numbered.select(*session, "seq", "ts", "turn_index", tokenizer(text).alias("tokens")).withColumn("n", F.size("tokens").cast("long"))
    own = Window.partitionBy(*session)
    before = F.coalesce(F.sum("n").over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before", before).withColumn("total", F.sum("n").over(own))


def chunk(items: DataFrame, session: list[str], *, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, tokenizer=tokens, order: list[Column] | None = None) -> DataFrame:
    """Chunks of each session: content, times and turns of its first and last item.

    ``items``: the session columns, item, ts, turn_index. ``tokenizer``: a function
    from text to an array of strings, or ``BytePairs``.
    """
    stride, pairs = size - overlap, isinstance(tokenizer, bytepair.BytePairs)
    placed = spans(items, session, order or [F.col("turn_index").asc_nulls_last(), F.col("ts").asc_nulls_last(), F.col("item")], tokenizer)
    last = F.floor(F.greatest(F.col("total") - overlap - 1, F.lit(0)) / stride)
    low = F.greatest(F.floor((F.col("before") - size) / stride) + 1, F.lit(0))
    high = F.least(F.floor((F.col("before") + F.col("n") - 1) / stride), last)

    def part(k: Column) -> Column:
        """The item's tokens in window ``k``, cut before rows are multiplied."""
        start = F.greatest(k * stride - F.col("before"), F.lit(0))
        end = F.least(k * stride + size - F.col("before"), F.col("n"))
        # A line feed alone, the item's separator, does not make the item one of the window's.
        if pairs:
            low, high = bytepair.upto("ends", start), bytepair.upto("ends", end)
            body, met = F.substring("text", low + 1, high - low), bytepair.upto("own", end) > bytepair.upto("own", start)
        else:
            body = F.array_join(F.slice("tokens", (start + 1).cast("int"), (end - start).cast("int")), "")
            met = F.length(body) > ((start == 0) & (F.col("seq") > 1)).cast("int")
        return F.struct(k.alias("k"), F.struct("seq", body.alias("body"), met.alias("met"), "ts", "turn_index").alias("part"))

    flat = placed.where("n > 0").select(*session, "total", F.explode(F.transform(F.sequence(low, high), part)).alias("x"))
    whole = flat.groupBy(*session, F.col("x.k").alias("k")).agg(F.array_sort(F.collect_list("x.part")).alias("parts"), F.max("total").alias("n"))
    met = F.filter("parts", lambda x: x["met"])
    rows = whole.withColumn("own", F.when(F.size(met) > 0, met).otherwise(F.col("parts")))
    first, final = F.element_at("own", 1), F.element_at("own", -1)
    return rows.select(
        *session,
        F.col("k").cast("int").alias("chunk_no"),
        (F.col("k") * stride).cast("int").alias("token_start"),
        F.least(F.col("k") * stride + size, F.col("n")).cast("int").alias("token_end"),
        (bytepair.decoded(F.col("parts")) if pairs else F.array_join(F.transform("parts", lambda x: x["body"]), "")).alias("content"),
        first["ts"].alias("timestamp_start"),
        final["ts"].alias("timestamp_end"),
        first["turn_index"].alias("turn_index_start"),
        final["turn_index"].alias("turn_index_end"),
    )
