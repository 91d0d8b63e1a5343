"""Filters and arguments of a search, validated before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import DEFAULT_LIMIT, MAX_BATCH, MAX_FILTER_VALUES, MAX_OFFSET, MAX_POOL, MAX_QUERY_CHARS, MAX_SEARCH_LIMIT, MAX_SESSION_ID_LEN, MAX_SOURCE_TYPE_LEN, MIN_POOL, POOL_FACTOR

#: The one accepted form of a time (fixed value).
UTC_TIME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|\+00:00)")


def _values(name: str, given, longest: int) -> tuple[str, ...]:
    if given is None:
        return ()
    if not isinstance(given, list | tuple):
        raise QueryError(f"{name}: a list of strings is needed", code="invalid_filter_type")
    if len(given) > MAX_FILTER_VALUES:
        raise QueryError(f"{name}: at most {MAX_FILTER_VALUES} values", code="filter_count_exceeded")
    for v in given:
        if not isinstance(v, str) or not 0 < len(v) <= longest:
            raise QueryError(f"{name}: strings of 1 to {longest} characters", code="invalid_filter_value")
    if len(set(given)) < len(given):
        raise QueryError(f"{name}: a value occurs twice", code="duplicate_filter_value")
    return tuple(sorted(given))


def _time(name: str, given) -> datetime | None:
    if given is None:
        return None
    if isinstance(given, str):
        if not UTC_TIME.fullmatch(given):
            raise QueryError(f"{name}: RFC 3339 in UTC, with seconds", code="invalid_time_format")
        try:
            return datetime.fromisoformat(given.replace("Z", "+00:00"))
        except ValueError as e:
            raise QueryError(f"{name}: no such time", code="invalid_time_format") from e
    if not isinstance(given, datetime):
        raise QueryError(f"{name}: a time or its text", code="invalid_time_format")
    if given.utcoffset() != timedelta(0):
        raise QueryError(f"{name}: must be in UTC", code="invalid_timezone")
    return given


@dataclass(frozen=True)
class SearchFilters:
    """Canonical filters; also validated when constructed directly."""

    source_types: tuple[str, ...] = ()
    session_ids: tuple[str, ...] = ()
    time_from: datetime | None = None
    time_to: datetime | None = None

    def __post_init__(self):
        for name, longest in (("source_types", MAX_SOURCE_TYPE_LEN), ("session_ids", MAX_SESSION_ID_LEN)):
            given = getattr(self, name)
            if not isinstance(given, tuple):
                raise QueryError(f"{name}: a sorted tuple is needed", code="invalid_filter_type")
            if _values(name, given, longest) != given:
                raise QueryError(f"{name}: a sorted tuple is needed", code="invalid_filter_type")
        for name in ("time_from", "time_to"):
            if isinstance(getattr(self, name), str):
                raise QueryError(f"{name}: must be a time in UTC", code="invalid_timezone")
            _time(name, getattr(self, name))
        if self.time_from and self.time_to and self.time_from >= self.time_to:
            raise QueryError("time_from must be before time_to", code="invalid_time_range")

    @classmethod
    def of(cls, *, source_types=None, session_ids=None, time_from=None, time_to=None) -> SearchFilters:
        return cls(_values("source_types", source_types, MAX_SOURCE_TYPE_LEN), _values("session_ids", session_ids, MAX_SESSION_ID_LEN), _time("time_from", time_from), _time("time_to", time_to))

    @property
    def timed(self) -> bool:
        return self.time_from is not None or self.time_to is not None

    def __bool__(self) -> bool:
        return bool(self.source_types or self.session_ids or self.timed)

    def predicate(self) -> Column:
        """One condition on the base table, so the scan gets it before any rank or limit."""
        out = F.lit(True)
        if self.source_types:
            out = out & F.col("source_type").isin(*self.source_types)
        if self.session_ids:
            out = out & F.col("session_id").isin(*self.session_ids)
        if self.timed:
            out = out & F.col("timestamp_start").isNotNull()
        if self.time_from is not None:
            out = out & (F.col("timestamp_start") >= F.lit(self.time_from))
        if self.time_to is not None:
            out = out & (F.col("timestamp_start") < F.lit(self.time_to))
        return out

    def keep(self, hits: DataFrame, chunks: DataFrame) -> DataFrame:
        """The hits themselves: the base table was filtered for all queries alike."""
        return hits

    def decays(self, intent: Column) -> Column:
        """Whether age counts: for a search bounded in time, else by the query's intent."""
        return F.lit(True) if self.timed else intent

    def guard(self, rows: DataFrame) -> DataFrame:
        """Fail the query if a scored row escapes the filters.

        The condition names the score too, so the optimizer cannot move it below
        the join to rows that are no candidates.
        """
        if not self:
            return rows
        fine = F.coalesce(self.predicate(), F.lit(False)) | F.col("score").isNull()
        return rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("filter_leakage")).cast("boolean")))


class QueryFilters:
    """A filter for each query of a batch (a query without one is not filtered).

    Filters are rows, joined to what each channel finds before its pool is cut. The
    scan gets the union of their bounds: where every query names sources, sessions
    or times, rows outside all of them are never read. The batch is a client's,
    so the rows may be broadcast.
    """

    def __init__(self, filters: dict, queries: DataFrame):
        self.filters = {q: f for q, f in filters.items() if f}
        self.kind = queries.schema["query_id"].dataType.simpleString()
        self.spark = queries.sparkSession
        asked = {r.query_id for r in queries.select("query_id").limit(MAX_BATCH + 1).collect()}
        if len(asked) > MAX_BATCH:
            raise QueryError(f"at most {MAX_BATCH} queries a batch", code="query_count_exceeded")
        if not set(filters) <= asked:
            raise QueryError("a filter names no query of the batch", code="invalid_filter_value")
        self.all = bool(asked) and asked <= set(self.filters)

    def __bool__(self) -> bool:
        return bool(self.filters)

    @cached_property
    def rows(self) -> DataFrame:
        """query_id and the bounds of its filter (null: none)."""
        rows = [(q, list(f.source_types) or None, list(f.session_ids) or None, f.time_from, f.time_to) for q, f in self.filters.items()]
        return self.spark.createDataFrame(rows, f"query_id {self.kind}, f_sources array<string>, f_sessions array<string>, f_from timestamp, f_to timestamp")

    def predicate(self) -> Column:
        """The union of the bounds, each given only where every query has one."""
        out, own = F.lit(True), list(self.filters.values())
        if not self.all:
            return out
        for column, given in (("source_type", [f.source_types for f in own]), ("session_id", [f.session_ids for f in own])):
            if all(given):
                out = out & F.col(column).isin(*sorted(set().union(*given)))
        if all(f.timed for f in own):
            out = out & F.col("timestamp_start").isNotNull()
        if all(f.time_from for f in own):
            out = out & (F.col("timestamp_start") >= F.lit(min(f.time_from for f in own)))
        if all(f.time_to for f in own):
            out = out & (F.col("timestamp_start") < F.lit(max(f.time_to for f in own)))
        return out

    @staticmethod
    def _fits() -> Column:
        def bound(limit: str, test: Column) -> Column:
            return F.col(limit).isNull() | F.coalesce(test, F.lit(False))

        return (
            bound("f_sources", F.array_contains("f_sources", F.col("source_type")))
            & bound("f_sessions", F.array_contains("f_sessions", F.col("session_id")))
            & bound("f_from", F.col("timestamp_start") >= F.col("f_from"))
            & bound("f_to", F.col("timestamp_start") < F.col("f_to"))
        )

    def keep(self, hits: DataFrame, chunks: DataFrame) -> DataFrame:
        """The hits (query_id, id, ...) whose chunk meets the filter of their query."""
        own = chunks.select("id", "source_type", "session_id", F.col("timestamp_start"))
        columns = hits.columns
        bare = hits.drop("source_type", "session_id", "timestamp_start")
        met = bare.join(own, "id").join(F.broadcast(self.rows), "query_id", "left").where(self._fits())
        return met.select(*columns)

    def decays(self, intent: Column) -> Column:
        timed = [q for q, f in self.filters.items() if f.timed]
        return F.col("query_id").isin(timed) | intent if timed else intent

    def guard(self, rows: DataFrame) -> DataFrame:
        """Fail the query if a scored row escapes its query's filter."""
        if not self:
            return rows
        fine = self._fits() | F.col("score").isNull()
        met = rows.join(F.broadcast(self.rows), "query_id", "left")
        return met.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("filter_leakage")).cast("boolean"))).select(*rows.columns)

    @property
    def masks(self):
        """For tasks of the dense channel: see :func:`_masks`."""
        return partial(_masks, self.filters)


def _masks(filters: dict, ids: list, source: pa.Array, session: pa.Array, at: pa.Array) -> dict[int, np.ndarray]:
    """Which rows of a block each of the queries ``ids`` may meet, by its place; a query without filter has no mask."""
    out = {}
    for k, q in enumerate(ids):
        if (f := filters.get(q)) is None:
            continue
        own = np.ones(len(source), bool)
        for values, column in ((f.source_types, source), (f.session_ids, session)):
            if values:
                own &= pc.is_in(column, value_set=pa.array(values, column.type)).to_numpy(zero_copy_only=False)
        for test, limit in ((pc.greater_equal, f.time_from), (pc.less, f.time_to)):
            if limit is not None:
                own &= pc.fill_null(test(at, pa.scalar(limit, at.type)), False).to_numpy(zero_copy_only=False)
        out[k] = own
    return out


def query_text(text) -> str:
    if not isinstance(text, str) or not text.strip():
        raise QueryError("a query needs text", code="invalid_query")
    if len(text.strip()) > MAX_QUERY_CHARS:
        raise QueryError(f"at most {MAX_QUERY_CHARS} characters", code="query_too_long")
    return text.strip()


def bounds(limit=DEFAULT_LIMIT, offset=0) -> tuple[int, int]:
    """Limit (cut to its ceiling) and offset."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise QueryError("limit must be a positive integer", code="invalid_limit")
    if isinstance(offset, bool) or not isinstance(offset, int):
        raise QueryError("offset must be an integer", code="invalid_offset")
    if not 0 <= offset <= MAX_OFFSET:
        raise QueryError(f"offset must be from 0 to {MAX_OFFSET}", code="offset_out_of_bounds")
    return min(limit, MAX_SEARCH_LIMIT), offset


def window_and_pool(limit: int, offset: int) -> tuple[int, int]:
    """Result window and the candidates that each channel may bring."""
    window = min(limit + offset, MAX_SEARCH_LIMIT)
    return window, min(max(POOL_FACTOR * window, MIN_POOL), MAX_POOL)


def compatible(model: str, dim: int, needs_vector: bool) -> Column:
    """Rows whose vectors can meet the query's: dense needs one, the others tolerate none."""
    same, size = F.col("embedding_model") == model, F.size("embedding") == dim
    if needs_vector:
        return same & F.col("embedding").isNotNull() & size
    return same & (F.col("embedding").isNull() | size)
