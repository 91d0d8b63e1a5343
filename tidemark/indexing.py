"""The indexes of a store: built once, kept with every commit, read by searches.

They are the derived tables of a store. A store that had chunks before it had
indexes is searched without them until :func:`rebuild`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .operators import index
from .schema import EMBED_DIM
from .store import Store


def _centre(store: Store) -> tuple[np.ndarray | None, int]:
    """Centroids (at most ``MAX_CELLS``) and probes; None where cells were never built."""
    if "chunk_centroids" not in store.current():
        return None, 0
    rows = store.table("chunk_centroids").orderBy("cell").collect()
    return (np.array([r.centroid for r in rows], np.float32), rows[0].probes) if rows else (None, 0)


def stored(store: Store) -> index.Index:
    """The indexes that the store has; parts it lacks are left to the scanning channels."""
    have = store.current()
    centre, probes = _centre(store)
    cells = index.Cells(store.table("chunk_cells"), centre, probes) if centre is not None else None
    part = {k: store.table(f"chunk_{k}") if f"chunk_{k}" in have else None for k in ("postings", "gram_sets")}
    return index.Index(part["postings"], cells, part["gram_sets"], _order(store))


def _order(store: Store) -> dict[str, int]:
    """Places of trigrams, ``ORDER_GRAMS`` at most; none where they were never counted."""
    return {r.gram: r.place for r in store.table("chunk_gram_order").collect()} if "chunk_gram_order" in store.current() else {}


def rebuild(store: Store, dim: int = EMBED_DIM, cells: int | None = None) -> dict:
    """Build postings, trigrams and cells of all chunks and publish them together; what the audit of the cells measured."""
    with store.writing():
        chunks = store.table("session_chunks")
        folders = {"chunk_postings": [store.write("chunk_postings", index.postings(chunks))]}
        order = index.gram_order(chunks)
        folders |= {"chunk_gram_sets": [store.write("chunk_gram_sets", index.gram_sets(chunks, order))]}
        folders |= {"chunk_gram_order": [store.write("chunk_gram_order", store.spark.createDataFrame(list(order.items()), "gram string, place int"))]}
        centre = index.train(chunks.where("embedding IS NOT NULL").select("id", "embedding"), dim, cells=cells)
        measured: list = []
        if len(centre):
            folder = store.write("chunk_cells", index.cells(chunks, centre))
            probes, measured = index.Cells(store.read("chunk_cells", [folder]), centre, len(centre)).audit()
            rows = [(k, [float(x) for x in c], probes) for k, c in enumerate(centre)]
            folders |= {"chunk_cells": [folder], "chunk_centroids": [store.write("chunk_centroids", store.spark.createDataFrame(rows, "cell int, centroid array<float>, probes int"))]}
        store.publish(folders)
        return {"cells": len(centre), "probes": probes if len(centre) else 0, "recall": measured}


def changed(store: Store, rows: DataFrame, keys: DataFrame | None) -> dict[str, list[str]]:
    """The index folders after a commit of chunks ``rows`` (in place of the sessions ``keys``, None: beside all)."""
    have, out = store.current(), {}
    fresh = store.table("session_chunks").isEmpty()
    for name, made in (("chunk_postings", index.postings), ("chunk_gram_sets", lambda rows: index.gram_sets(rows, _order(store)))):
        if name in have or fresh:
            out[name] = store.placed(name, store.write(name, made(rows)), keys, "session_id")
    centre, _ = _centre(store)
    if centre is not None:
        out["chunk_cells"] = store.placed("chunk_cells", store.write("chunk_cells", index.cells(rows, centre)), keys, "session_id")
    return out


def without(store: Store, keys: DataFrame) -> dict[str, list[str]]:
    """The index folders without the sessions ``keys``."""
    return {name: store.removed(name, keys, "session_id") for name in ("chunk_postings", "chunk_gram_sets", "chunk_cells") if name in store.current()}
