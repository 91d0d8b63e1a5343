"""Command line: migrate, health, ingest, reindex, query, privacy, backup, restore."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from . import config, indexing, session
from .embedding import query_embedder, stored_vectors
from .errors import CodedError, ConfigError, IngestError
from .functions.vector import hashed_local
from .ingest import Run
from .operators import lifecycle
from .operators.filters import SearchFilters
from .plans.search import search_page
from .store import Store


def _root(path: str) -> str:
    """A source folder as checkpoints name it."""
    if path.startswith("file:"):
        return "file:/" + path[5:].lstrip("/")
    return path if "://" in path else "file:" + os.path.abspath(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--config")
    p.add_argument("--warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("migrate").add_argument("--target", type=int)
    sub.add_parser("health")
    sub.add_parser("reindex")
    i = sub.add_parser("ingest")
    i.add_argument("source", choices=["sessions", "chat", "store"])
    i.add_argument("--file", help="one chat file")
    i.add_argument("--force", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=5)
    q.add_argument("--offset", type=int, default=0)
    q.add_argument("--source-type", action="append")
    q.add_argument("--session-id", action="append")
    q.add_argument("--from", dest="time_from")
    q.add_argument("--to", dest="time_to")
    q.add_argument("--explain", action="store_true")
    v = sub.add_parser("privacy")
    v.add_argument("action", choices=["delete", "export", "retention", "providers"])
    v.add_argument("--scope", default="all", choices=lifecycle.SCOPES)
    v.add_argument("--older-than", type=int)
    v.add_argument("--dest")
    v.add_argument("--confirm", action="store_true")
    for name in ("backup", "restore"):
        sub.add_parser(name).add_argument("path")
    return p


def _query(args, settings, store, out, err) -> None:
    filters = SearchFilters.of(source_types=args.source_type, session_ids=args.session_id, time_from=args.time_from, time_to=args.time_to)
    embed = (lambda t: hashed_local(t, settings.embedding_dim)) if settings.embedding_provider == "hashed" else query_embedder(store.spark, settings)
    page = search_page(store.table("session_chunks"), args.text, embed, args.limit, args.offset, filters=filters, explain=args.explain, model=settings.embedding_model, dim=settings.embedding_dim, trigram_threshold=settings.trigram_threshold, index=indexing.stored(store))
    for n, r in enumerate(page.results, start=args.offset + 1):
        text = r.content if len(r.content) <= 500 else r.content[:500] + "..."
        print(f"#{n} score={r.score:.4f} session={r.session_id} source={r.source_type} time={r.timestamp_start}\n{text}\n", file=out)
        if args.explain:
            print(f"#{n} {r.explain.asDict(recursive=True)}", file=err)
    if not page.results:
        print("no results", file=out)
    if args.explain:
        print(page.explain_summary, file=err)
    if page.has_more:
        print(f"more from offset {page.next_offset}", file=out)


def _privacy(args, settings, store, out) -> None:
    bound = lifecycle.bindings(store.table("ingestion_state"))
    if args.action == "providers":
        for r in lifecycle.disclosures(store.spark).collect():
            print(f"{r.component}: {r.provider}{' (local)' if r.local_only else ''}", file=out)
        return
    places = {"sessions": settings.sessions_root, "chat": settings.chat_root, "store": settings.store_path}
    if args.scope != "all" and not places[args.scope]:
        settings.source(args.scope)  # says that it is not configured
    if args.scope == "all" and not any(places.values()):
        raise ConfigError("no source is configured", code="source_not_configured")
    roots = tuple(_root(r) for r in (settings.sessions_root, settings.chat_root) if r)
    own = lifecycle.resolve(bound, args.scope, roots)
    if args.action == "retention":
        days = {"sessions": settings.retention_sessions, "store": settings.retention_store, "chat": settings.retention_chat}
        for r in lifecycle.retention_report(own, F.current_timestamp(), days).collect():
            print(f"{r.scope}: {r.n} bindings, {r.expired} expired after {r.retention_days} days", file=out)
        return
    sessions = own.select("session_id")
    if args.older_than is not None:
        sessions = lifecycle.old_enough(own, F.current_timestamp(), args.older_than)
    if args.action == "export":
        lifecycle.require_unclaimed(bound, args.scope)
        print(lifecycle.write_export(lifecycle.export_rows(store.table("session_chunks"), sessions, store.table("session_facts")), args.dest, confirm=args.confirm), file=out)
        return
    lifecycle.require_unclaimed(bound, args.scope)
    tables = {n: store.table(n) for n in ("session_chunks", "session_facts")}
    _, counts = lifecycle.delete(tables, sessions)
    for r in counts.collect():
        print(f"{r.table}: {'deleted' if args.confirm else 'would delete'} {r.would_delete}", file=out)
    if args.confirm:
        store.require_current()
        gone = own.join(sessions.distinct(), "session_id", "left_semi").select("file_path")
        with store.writing():
            folders = {name: store.removed(name, sessions, "session_id") for name in tables}
            store.publish(folders | indexing.without(store, sessions) | {"ingestion_state": store.removed("ingestion_state", gone, "file_path")})


def main(argv: list[str] | None = None, out=None, err=None, spark=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    args = parser().parse_args(argv)
    try:
        settings = config.load(args.config, warehouse=args.warehouse)
        spark = spark or session.build()
        store = Store(spark, settings.warehouse)
        if args.command == "migrate":
            print("applied", *store.migrate(args.target), file=out)
        elif args.command == "health":
            print(store.health(), file=out)
        elif args.command == "ingest":
            store.require_current()
            with store.writing():
                if args.file and args.source != "chat":
                    raise ConfigError("only chat has files to choose from", code="invalid_config_value")
                chosen = {"file": args.file} if args.file else {}
                counters = getattr(Run(spark, store, settings, stored_vectors(spark, settings)), args.source)(force=args.force, dry_run=args.dry_run, **chosen)
                print(*(f"{k}={v}" for k, v in counters.items()), file=out)
        elif args.command == "reindex":
            store.require_current()
            made = indexing.rebuild(store, settings.embedding_dim)
            print(f"cells={made['cells']} probes={made['probes']}", file=out)
        elif args.command == "query":
            _query(args, settings, store, out, err)
        elif args.command == "privacy":
            _privacy(args, settings, store, out)
        elif args.command == "backup":
            print(store.backup(args.path)["digest"], file=out)
        else:
            print(store.restore(args.path)["digest"], file=out)
        return 0
    except IngestError as e:
        print(f"error[{e.code}]: {e}", file=err)
        return 1 if e.code == "ingest_locked" else 2
    except CodedError as e:
        print(f"error[{e.code}]: {e}", file=err)
        return 2


if __name__ == "__main__":
    sys.exit(main())
