"""Hybrid search: one plan for a batch of queries, and the single-query API."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.intent import recent
from ..functions.vector import check_vector
from ..operators import channels, fusion
from ..operators import index as indexes
from ..operators.filters import QueryFilters, SearchFilters, bounds, compatible, query_text
from ..schema import EMBED_DIM, MAX_PAGE_LIMIT, MAX_POOL, MAX_SEARCH_LIMIT, MIN_POOL, POOL_FACTOR, TRIGRAM_THRESHOLD

BASE = ("session_id", "source_type", "timestamp_start", "created_at", "embedding_model")
CHANNELS = ("dense", "lexical", "exact")
#: So many candidates of a batch are broadcast (some 60 MB).
MAX_SENT = 1_000_000


@dataclass(frozen=True)
class Stages:
    """Which stages take part; a stage left out adds nothing to the plan."""

    dense: bool = True
    lexical: bool = True
    exact: bool = True
    temporal: bool = True
    dedup: bool = True

    def __post_init__(self):
        if any(not isinstance(v, bool) for v in vars(self).values()):
            raise QueryError("stages are true or false", code="invalid_stage")
        if not (self.dense or self.lexical or self.exact):
            raise QueryError("no candidate channel is left", code="invalid_stage")


#: The ablation matrix.
CONFIGS = {
    "dense-only": Stages(True, False, False, False, False),
    "lexical-only": Stages(False, True, False, False, False),
    "rrf": Stages(True, True, False, False, False),
    "+exact": Stages(True, True, True, False, False),
    "+temporal": Stages(True, True, True, True, False),
    "+dedup": Stages(),
}


@dataclass
class Search:
    """The stages of a search over a batch of queries, each a DataFrame.

    ``queries``: query_id, text, embedding, limit, offset. ``now`` is fixed once
    for the whole batch.
    """

    chunks: DataFrame
    queries: DataFrame
    model: str
    now: datetime
    dim: int = EMBED_DIM
    filters: SearchFilters | QueryFilters = field(default_factory=SearchFilters)
    stages: Stages = field(default_factory=Stages)
    trigram_threshold: float = TRIGRAM_THRESHOLD
    index: indexes.Index | None = None

    @cached_property
    def asked(self) -> DataFrame:
        window = F.least(F.col("limit") + F.col("offset"), F.lit(MAX_SEARCH_LIMIT)).cast("int")
        pool = F.least(F.greatest(window * POOL_FACTOR, F.lit(MIN_POOL)), F.lit(MAX_POOL)).cast("int")
        return self.queries.withColumn("window", window).withColumn("pool", pool)

    @cached_property
    def few(self) -> bool:
        """Whether all candidates are few enough to go to the texts; else the texts meet them in a shuffle."""
        return len(CHANNELS) * sum(r.pool for r in channels.collected(self.asked, "pool")) <= MAX_SENT

    def base(self, needs_vector: bool) -> DataFrame:
        return self.chunks.where(self.filters.predicate() & compatible(self.model, self.dim, needs_vector))

    # Channels are kept: at most a pool for each query, read by fusion, fallback,
    # summary and by every variant of the search.

    @property
    def _keep(self):
        """Where filters differ by query: what takes a channel's hits to those that their queries may find."""
        return (lambda hits: self.filters.keep(hits, self.base(False))) if isinstance(self.filters, QueryFilters) and self.filters else None

    @cached_property
    def dense(self) -> DataFrame:
        masks = self.filters.masks if self._keep else None
        if self.index and self.index.cells:
            return self.index.cells.dense(self.base(True), self.asked, masks=masks).persist()
        return channels.dense(self.base(True), self.asked, masks).persist()

    @cached_property
    def words(self) -> DataFrame:
        if self.index and self.index.postings is not None:
            return indexes.lexical(self.index.postings, self.base(False), self.asked, self._keep).persist()
        return channels.lexical(self.base(False), self.asked, self._keep).persist()

    @cached_property
    def unmatched(self) -> DataFrame:
        """Queries without a lexical hit: the trigram channel is for them alone."""
        return self.asked.join(self.words.select("query_id").distinct(), "query_id", "left_anti")

    @cached_property
    def grams(self) -> DataFrame:
        if self.index and self.index.grams is not None and self.trigram_threshold > 0:
            return indexes.trigram(self.index.grams, self.index.order, self.base(False), self.unmatched, self.trigram_threshold, self._keep).persist()
        return channels.trigram(self.base(False), self.unmatched, self.trigram_threshold, self._keep).persist()

    @cached_property
    def lexical(self) -> DataFrame:
        return self.words.unionByName(self.grams)

    @cached_property
    def exact(self) -> DataFrame:
        return channels.exact(self.base(False), self.asked, self._keep).persist()

    def variant(self, stages: Stages) -> Search:
        """The same search with other stages, sharing the channels."""
        other = replace(self, stages=stages)
        for name in ("asked", "few", "dense", "words", "grams", "lexical", "exact"):
            needed = {"dense": stages.dense, "exact": stages.exact, "asked": True, "few": True}.get(name, stages.lexical)
            if needed:
                other.__dict__[name] = getattr(self, name)
        return other

    def release(self) -> None:
        """Drop the kept channels."""
        for name in ("dense", "words", "grams", "exact"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def pools(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in CHANNELS if getattr(self.stages, name)}

    @cached_property
    def fused(self) -> DataFrame:
        """Fused candidates with the columns of their chunks (joined after the pools are cut)."""
        found = fusion.fuse(self.pools)
        rows = self.chunks.select("id", "content", "embedding", *BASE)
        return self.filters.guard(rows.join(F.broadcast(found) if self.few else found, "id"))

    @cached_property
    def ranked(self) -> DataFrame:
        rows = self.fused.join(self.asked.select("query_id", "text", "window", "limit", "offset"), "query_id")
        timed = F.lit(False)
        if self.stages.temporal:
            timed = self.filters.decays(recent("text"))
        return fusion.rank(fusion.apply_decay(rows, F.lit(self.now), timed))

    @cached_property
    def kept(self) -> DataFrame:
        rows = fusion.dedup(self.ranked) if self.stages.dedup else self.ranked.withColumn("kept", F.lit(True))
        return fusion.cut(rows, F.col("window"))

    @cached_property
    def results(self) -> DataFrame:
        """The page of every query, with explanations."""
        return fusion.explain(self.filters.guard(fusion.page(self.kept, F.col("limit"), F.col("offset"))))

    @cached_property
    def summary(self) -> DataFrame:
        """A row for each query: what each channel ran and brought."""
        parts = {name: rows.select("query_id") for name, rows in self.pools.items()}
        parts["fused"] = self.fused.select("query_id")
        if self.stages.lexical:
            parts["words"] = self.words.select("query_id")
        within = (F.col("place") > F.col("offset")) & (F.col("place") <= F.col("offset") + F.col("limit"))
        parts["selected"], parts["returned"] = self.kept.select("query_id"), self.kept.where(within).select("query_id")
        flat = None
        for name, rows in parts.items():
            # Counted before the union, so its inputs need not share a partitioning.
            one = rows.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("part"), "n").repartition(1)
            flat = one if flat is None else flat.unionByName(one)
        n = {name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("n"))), F.lit(0)) for name in ("dense", "lexical", "exact", "fused", "words", "selected", "returned")}
        counts = flat.groupBy("query_id").agg(
            *(n[name].alias(f"{name}_fetched") for name in ("dense", "lexical", "exact")),
            n["fused"].alias("fused_candidate_count"),
            n["selected"].alias("selected_count"),
            n["returned"].alias("returned_count"),
            n["words"].alias("_words"),
        )
        out = self.asked.select("query_id", F.col("pool").alias("pool_limit")).join(counts, "query_id", "left").fillna(0)
        for name in ("dense", "lexical", "exact"):
            out = out.withColumn(f"{name}_at_pool_limit", F.col(f"{name}_fetched") >= F.col("pool_limit"))
        method = F.when(F.col("_words") > 0, "ts_rank_cd").otherwise("trigram_fallback") if self.stages.lexical else F.lit("none")
        return out.withColumn("lexical_method", method).drop("_words")

    def trace(self) -> DataFrame:
        """Events of the stages: stage, query_id, id, rank, score, reason."""
        def event(stage, rows, reason, rank="rank"):
            return rows.select(F.lit(stage).alias("stage"), "query_id", "id", F.col(rank).alias("rank"), F.col("score").cast("double").alias("score"), F.lit(reason).alias("reason"))

        parts = [event(name, rows, "candidate") for name, rows in self.pools.items()]
        parts.append(event("fused", fusion.rank(self.fused), "fused"))
        if self.stages.temporal:
            parts.append(event("temporal", self.ranked, "ranked"))
        if self.stages.dedup:
            judged = fusion.dedup(self.ranked)
            parts += [event("dedup", judged.where("kept"), "kept"), event("dedup", judged.where("not kept"), "duplicate")]
        parts.append(event("final", self.results, "returned", "place"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


RESULT = ("content", "score", "timestamp_start", "session_id", "source_type", "embedding_model")


@dataclass(frozen=True)
class SearchPage:
    results: list
    limit: int
    offset: int
    has_more: bool
    next_offset: int | None
    explain_summary: dict | None = None


def _one(chunks: DataFrame, text: str, vector, limit: int, offset: int, filters, stages, model, now, dim, threshold, index=None) -> Search:
    stages = stages or Stages()
    vector = check_vector(vector, dim) if stages.dense else None
    schema = "query_id int, text string, embedding array<double>, limit int, offset int"
    queries = chunks.sparkSession.createDataFrame([(0, text, vector, limit, offset)], schema)
    return Search(chunks, queries, model, now or datetime.now(UTC), dim, filters or SearchFilters(), stages, threshold, index)


def search(chunks: DataFrame, query: str, embed=None, limit: int = 5, offset: int = 0, *, filters: SearchFilters | None = None, stages: Stages | None = None, model: str = "default", now=None, dim: int = EMBED_DIM, explain: bool = False, trigram_threshold: float = TRIGRAM_THRESHOLD, index: indexes.Index | None = None):
    """Rows of one query. ``embed`` maps text to a vector and is called only when dense is on."""
    text = query_text(query)
    limit, offset = bounds(limit, offset)
    vector = embed(text) if (stages or Stages()).dense and embed is not None else None
    if (stages or Stages()).dense and embed is None:
        raise QueryError("no embedder is configured", code="embedding_unavailable")
    s = _one(chunks, text, vector, limit, offset, filters, stages, model, now, dim, trigram_threshold, index)
    columns = [*RESULT, F.size("embedding").alias("embedding_dimension"), "id", *(["explain"] if explain else [])]
    try:
        rows = s.results.orderBy("place").select(*columns).collect()
        return (rows, s.summary.first().asDict()) if explain else rows
    finally:
        s.release()


def search_page(chunks: DataFrame, query: str, embed=None, limit: int = 5, offset: int = 0, **options) -> SearchPage:
    """One page; a row more than asked tells whether there is another page."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_PAGE_LIMIT:
        raise QueryError(f"limit must be from 1 to {MAX_PAGE_LIMIT}", code="limit_out_of_bounds")
    limit, offset = bounds(limit, offset)
    found = search(chunks, query, embed, offset + limit + 1, 0, **options)
    rows, summary = found if options.get("explain") else (found, None)
    more = len(rows) > offset + limit and offset + limit <= 255
    return SearchPage(rows[offset : offset + limit], limit, offset, more, offset + limit if more else None, summary)


def run_search(chunks: DataFrame, embed, query, limit=5, offset=0, source_types=None, session_ids=None, time_from=None, time_to=None, explain=False, **options) -> dict:
    """The remote-call form: plain values in and out, errors as codes."""
    try:
        filters = SearchFilters.of(source_types=source_types, session_ids=session_ids, time_from=time_from, time_to=time_to)
        limit = min(limit, MAX_PAGE_LIMIT) if isinstance(limit, int) and not isinstance(limit, bool) else limit
        page = search_page(chunks, query, embed, limit, offset, filters=filters, explain=explain, **options)
    except QueryError as e:
        return {"error": {"code": e.code}}
    except Exception as e:  # the message may hold data
        return {"error": {"code": "search_unavailable", "type": type(e).__name__}}
    rows = []
    for r in page.results:
        d = r.asDict(recursive=True)
        own = {k: d[k] for k in ("timestamp_start", "session_id", "source_type", "embedding_model", "embedding_dimension")}
        stamp = own.pop("timestamp_start")
        row = {"content": d["content"], "score": d["score"], "provenance": own | {"timestamp": stamp.isoformat() if stamp else None}}
        rows.append(row | ({"explain": d["explain"]} if explain else {}))
    out = {"results": rows, "limit": page.limit, "offset": page.offset, "has_more": page.has_more, "next_offset": page.next_offset}
    if filters:
        out["filters_applied"] = {"source_types": list(filters.source_types), "session_ids": list(filters.session_ids), "time_from": filters.time_from and filters.time_from.isoformat(), "time_to": filters.time_to and filters.time_to.isoformat()}
    if explain:
        out["explain_summary"] = page.explain_summary
    return out

