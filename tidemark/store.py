"""Managed tables on shared storage: versions, schema ledger, health, snapshots.

A table is a list of immutable folders. A commit writes new folders, then
replaces one pointer file that names the folders of every table; readers follow
the pointer, so a failed or abandoned write is never seen, and a commit of
several tables is atomic. An append adds a folder, and a replacement writes
those folders anew that hold a row to be replaced. All access goes through the
Hadoop file system of the path, local or remote.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IngestError, MigrationError, SnapshotError
from .schema import DERIVED, TABLES

SCHEMAS = TABLES | DERIVED

#: One file names the folders of every table.
POINTER = "_current.json"
#: A table of more folders is written as one.
MAX_FOLDERS = 64
#: A run that holds a lock for longer is taken for dead.
LOCK_SECONDS = 24 * 3600.0


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a small file whole or not at all."""
        temp = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        stream = self.fs.create(self._path(temp), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # One rename that replaces the target, so readers see the old or the new text.
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(self._path(temp)), context.makeQualified(self._path(name)), how)

    def create(self, name: str) -> bool:
        """Make a file that must not exist; false if another writer has it."""
        try:
            self.fs.create(self._path(name), False).close()
            return True
        except Exception:
            return False

    def touch(self, name: str, text: str) -> None:
        """Write a file again in place, so that it is never missing."""
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def age(self, name: str) -> float | None:
        """Seconds since a file was written; none if it is gone."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Exception:
            return None

    def move(self, name: str, to: str) -> bool:
        """Rename a file; false if another has moved it first."""
        try:
            return bool(self.fs.rename(self._path(name), self._path(to)))
        except Exception:
            return False


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = root.rstrip("/")
        self.owned: dict[str, str] = {}
        self.pending: set[str] = set()  # folders written and not published yet

    # -- tables --

    def current(self) -> dict[str, list[str]]:
        """The folders of each table."""
        return json.loads(self.files.read(POINTER)) if self.files.exists(POINTER) else {}

    def version(self, name: str) -> str | None:
        """What names a table's present state; none if it was never written."""
        own = self.current().get(name)
        return None if own is None else "+".join(own)

    def table(self, name: str) -> DataFrame:
        return self.read(name, self.current().get(name, []))

    def read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{name}/{x}" for x in folders))

    def write(self, name: str, rows: DataFrame) -> str:
        """Write rows as a folder that no reader sees before it is published."""
        own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields))
        last = max((int(x.split("-")[1]) for x in self.files.names(name) if x.startswith("v-")), default=-1)
        target = f"v-{last + 1:06d}-{uuid.uuid4().hex[:8]}"
        self.pending.add(f"{name}/{target}")
        own.write.option("compression", "zstd").parquet(f"{self.root}/{name}/{target}")
        return target

    def publish(self, folders: dict[str, list[str]]) -> None:
        """Make folders the present state of their tables, of all at once.

        Another writer's lock is respected: the pointer is read and written, and two
        writers could lose one's change.
        """
        if "writer" not in self.owned and self.files.exists("_locks/writer"):
            raise IngestError("another run holds the lock", code="ingest_locked")
        self.renew("writer")
        self.pending.clear()
        self.files.write(POINTER, json.dumps(self.current() | folders, sort_keys=True))

    def commit(self, name: str, rows: DataFrame) -> str:
        """Write a whole table anew and publish it."""
        target = self.write(name, rows)
        self.publish({name: [target]})
        return target

    def added(self, name: str, rows: DataFrame) -> list[str]:
        """The folders of a table after an append: the old ones stay as they are."""
        return self._compact(name, [*self.current().get(name, []), self.write(name, rows)])

    def replaced(self, name: str, rows: DataFrame, key: str) -> list[str]:
        """The folders of a table whose rows with a key of ``rows`` give way to ``rows``.

        Folders without such a key stay as they are, the others are written anew.
        """
        new = self.write(name, rows)
        return self._without(name, self.read(name, [new]), key) + [new]

    def placed(self, name: str, folder: str, keys: DataFrame | None, key: str) -> list[str]:
        """The folders of a table with a written folder, in place of the rows with one of ``keys`` (None: beside all rows)."""
        old = self.current().get(name, []) if keys is None else self._without(name, keys, key)
        return self._compact(name, [*old, folder])

    def removed(self, name: str, keys: DataFrame, key: str) -> list[str]:
        """The folders of a table without the rows that have one of the keys."""
        return self._without(name, keys, key) or [self.write(name, self.read(name, []))]

    def _without(self, name: str, keys: DataFrame, key: str) -> list[str]:
        folders, gone = self.current().get(name, []), keys.select(key).distinct()
        if not folders:
            return []
        place = F.regexp_extract(F.col("_metadata.file_path"), f"/{name}/(v-[^/]+)/", 1)
        met = self.read(name, folders).select(key, place.alias("folder")).join(gone, key, "left_semi")
        touched = {r.folder for r in met.select("folder").distinct().collect()}  # MAX_FOLDERS at most
        kept = [x for x in folders if x not in touched]
        if touched:
            rest = self.read(name, [x for x in folders if x in touched]).join(gone, key, "left_anti")
            kept.append(self.write(name, rest))
        return self._compact(name, kept)

    def _compact(self, name: str, folders: list[str]) -> list[str]:
        return folders if len(folders) < MAX_FOLDERS else [self.write(name, self.read(name, folders))]

    def vacuum(self, name: str, keep: int = 2) -> list[str]:
        """Delete old folders, the oldest first; never a current one or one of an open commit.

        This store's open commits are known to it; any other writer has the lock
        while its commit is open, and then this is an error.
        """
        with self.writing():
            own = self.current().get(name, [])
            found = [x for x in self.files.names(name) if x.startswith("v-") and x not in own and f"{name}/{x}" not in self.pending]
            gone = found[: max(0, len(found) - keep + 1)]
            for x in gone:
                self.files.delete(f"{name}/{x}")
            return gone

    # -- a single writer --

    def lock(self, name: str, ttl_seconds: float = LOCK_SECONDS) -> bool:
        """Take a lock; false if another holds it. A lock older than ``ttl_seconds`` was left by a run that died.

        Its text names the owner. A stale lock is renamed away first, which one of
        several contenders can do.
        """
        path = f"_locks/{name}"
        if self.files.create(path):
            self.owned[name] = uuid.uuid4().hex
            self.files.write(path, json.dumps({"owner": self.owned[name]}))
            return True
        age = self.files.age(path)
        if age is not None and age > ttl_seconds and self.files.move(path, f"_locks/.stale-{uuid.uuid4().hex}"):
            return self.lock(name, ttl_seconds)
        return False

    def renew(self, name: str) -> None:
        """Show that the owner of a lock still runs."""
        path, own = f"_locks/{name}", self.owned.get(name)
        if own and self.files.exists(path) and own in self.files.read(path):
            self.files.touch(path, json.dumps({"owner": own}))

    @contextmanager
    def writing(self, every: float = LOCK_SECONDS / 8) -> Iterator[None]:
        """Hold the writer's lock, renewed while the block runs; inside another such block nothing is taken."""
        if "writer" in self.owned:
            yield
            return
        if not self.lock("writer"):
            raise IngestError("another run holds the lock", code="ingest_locked")
        done = threading.Event()

        def keep() -> None:
            while not done.wait(every):
                self.renew("writer")

        threading.Thread(target=keep, daemon=True).start()
        try:
            yield
        finally:
            done.set()
            self.unlock("writer")

    def unlock(self, name: str) -> None:
        """Give a lock back; one that another run has taken over stays."""
        path, own = f"_locks/{name}", self.owned.pop(name, None)
        if own and self.files.exists(path) and own in self.files.read(path):
            self.files.delete(path)

    # -- schema ledger --

    def ledger(self) -> list[dict]:
        return json.loads(self.files.read("_ledger.json")) if self.files.exists("_ledger.json") else []

    def migrate(self, target: int | None = None, steps: list[Step] | None = None) -> list[int]:
        """Apply missing steps in order. A step whose text changed since it ran is an error."""
        steps = steps or STEPS
        if not steps:
            raise MigrationError("there are no steps", code="no_migrations")
        if target is not None and target > steps[-1].version:
            raise MigrationError("no such version", code="target_beyond_head")
        if not self.lock("migrations"):
            raise MigrationError("another migration runs", code="migration_locked")
        try:
            done = self.ledger()
            for row in done:
                own = next((s for s in steps if s.version == row["version"]), None)
                if own is None:
                    raise MigrationError("the store is newer", code="database_ahead_of_code")
                if own.checksum != row["checksum"]:
                    raise MigrationError("a step changed", code="migration_checksum_mismatch")
            known, applied = {r["version"] for r in done}, []
            for s in steps:
                if s.version in known or (target is not None and s.version > target):
                    continue
                try:
                    s.run(self)
                except Exception as e:
                    raise MigrationError(f"step {s.version} failed", code="migration_failed") from e
                done.append({"version": s.version, "name": s.name, "checksum": s.checksum})
                self.files.write("_ledger.json", json.dumps(done))
                applied.append(s.version)
            return applied
        finally:
            self.unlock("migrations")

    def health(self, steps: list[Step] | None = None) -> str:
        """ahead, drifted, uninitialized, partial or current."""
        steps, done = steps or STEPS, self.ledger()
        by = {s.version: s for s in steps}
        if any(r["version"] not in by for r in done):
            return "ahead"
        if any(by[r["version"]].checksum != r["checksum"] for r in done):
            return "drifted"
        if not done:
            return "uninitialized"
        if len(done) < len(steps) or any(self.version(t) is None for t in TABLES):
            return "partial"
        return "current"

    def require_current(self) -> None:
        if (state := self.health()) != "current":
            raise MigrationError(f"the store is {state}", code="database_not_current")

    # -- snapshots --

    def digests(self, name: str) -> dict[str, str]:
        """sha256 of each data file of a table's current version, by file name."""
        at = [f"{self.root}/{name}/{x}" for x in self.current().get(name, [])]
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(at)
        rows = files.select(F.element_at(F.split("path", "/"), -1).alias("n"), F.sha2("content", 256).alias("d")).collect()
        return {r.n: r.d for r in rows}

    def backup(self, dest: str) -> dict:
        """Copy every table to a new folder, with a manifest written last."""
        self.require_current()
        out = Store(self.spark, dest)
        if out.files.exists(""):
            raise SnapshotError("the target exists", code="backup_target_exists")
        manifest = {"ledger": self.ledger(), "tables": {}}
        for name in TABLES:
            version = out.commit(name, self.table(name))
            manifest["tables"][name] = {"version": version, "rows": out.table(name).count(), "files": out.digests(name)}
        manifest["digest"] = sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:16]
        out.files.write("_ledger.json", json.dumps(self.ledger()))
        out.files.write("MANIFEST.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def verify_backup(self, src: str) -> dict:
        own = Store(self.spark, src)
        if not own.files.exists(""):
            raise SnapshotError("nothing there", code="backup_missing")
        if not own.files.exists("MANIFEST.json"):
            raise SnapshotError("no manifest", code="manifest_missing")
        try:
            manifest = json.loads(own.files.read("MANIFEST.json"))
        except Exception as e:
            raise SnapshotError("the manifest can't be read", code="manifest_corrupt") from e
        if not {"ledger", "tables", "digest"} <= set(manifest) or set(manifest["tables"]) != set(TABLES):
            raise SnapshotError("the manifest lacks a part", code="manifest_incomplete")
        bare = {k: v for k, v in manifest.items() if k != "digest"}
        if sha256(json.dumps(bare, sort_keys=True).encode()).hexdigest()[:16] != manifest["digest"]:
            raise SnapshotError("the manifest was changed", code="manifest_digest_mismatch")
        if manifest["ledger"] != [{"version": s.version, "name": s.name, "checksum": s.checksum} for s in STEPS]:
            raise SnapshotError("another schema", code="manifest_schema_mismatch")
        for name, own_table in manifest["tables"].items():
            if own.digests(name) != own_table["files"]:
                raise SnapshotError("a file was changed", code="manifest_digest_mismatch")
        return manifest

    def restore(self, src: str) -> dict:
        """Fill this (empty) store from a backup, then check every count."""
        if self.files.exists("") and self.files.names(""):
            raise SnapshotError("the target is not empty", code="invalid_db_name")
        manifest, source = self.verify_backup(src), Store(self.spark, src)
        for name, own in manifest["tables"].items():
            self.commit(name, source.table(name))
            if self.table(name).count() != own["rows"]:
                raise SnapshotError("a count differs", code="restore_verification_failed")
        self.files.write("_ledger.json", json.dumps(manifest["ledger"]))
        return manifest


class Step:
    """A numbered, forward-only schema change."""

    def __init__(self, version: int, name: str, run: Callable[[Store], None], text: str):
        self.version, self.name, self.run = version, name, run
        self.checksum = sha256(text.encode()).hexdigest()[:16]


def _create(store: Store) -> None:
    for name, schema in TABLES.items():
        if store.version(name) is None:
            store.commit(name, store.spark.createDataFrame([], schema))


STEPS = [Step(1, "initial", _create, json.dumps({n: s.jsonValue() for n, s in TABLES.items()}, sort_keys=True))]


def summary(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """Tables and columns of the session's catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(pattern=pattern) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
