"""Session files as a stream of changes: a file comes again when its time or size changes.

Spark's file source remembers paths only. This source keeps what it has sent as
(path, time, size): each trigger that finds changes writes a numbered list of
them to the state folder and the offset is that number, so offsets stay small
and a batch that is repeated reads the same list. Lists of finished batches are
folded into one every ``FOLD`` of them. Listing and state are the driver's, as in Spark's own
file source (some hundred bytes a file); file contents are read by the tasks.

Edge cases: a file that is gone when its batch runs is passed over; one that
changes meanwhile comes again; an empty file comes with an empty value; bytes
that are no UTF-8 come out replaced; an empty or missing folder has no rows.
The state folder must outlive the query, like its checkpoint, and belongs to one query.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "session-changes"
SCHEMA = "path string, mtime timestamp, size bigint, value string"
FOLD = 50
SPLIT_BYTES = 64 << 20


def filesystem(place: str):
    """(file system, path in it, what to put before its paths to name them again)."""
    from pyarrow import fs

    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), place.rstrip("/"), ""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place[5:].strip("/"), "file://"
    scheme, rest = place.split("://", 1)
    found, path = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest.rstrip('/')}")
    return found, path, place[: place.rstrip("/").rfind(path)]


class Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(len(files))
        self.files = files


class State:
    """Numbered lists of changes in a folder: ``base-N`` holds what lists up to N say, ``list-N`` one list each."""

    def __init__(self, place: str):
        self.fs, self.path, _ = filesystem(place)
        self.fs.create_dir(self.path, recursive=True)
        self.base, self.last = 0, 0
        names = self._names()
        bases = [n for kind, n in names if kind == "base"]
        self.base = self.last = max(bases, default=0)
        self.seen = dict(map(self._pair, self._read(f"base-{self.base}"))) if bases else {}
        while ("list", self.last + 1) in names:
            self.last += 1
            self.seen.update(map(self._pair, self._read(f"list-{self.last}")))

    @staticmethod
    def _pair(entry: list) -> tuple:
        return entry[0], (entry[1], entry[2])

    def _names(self) -> set[tuple[str, int]]:
        from pyarrow import fs

        names = [f.base_name.partition("-") for f in self.fs.get_file_info(fs.FileSelector(self.path))]
        return {(kind, int(n)) for kind, _, n in names if n.isdigit()}

    def _read(self, name: str) -> list:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return [json.loads(x) for x in f.read().decode().splitlines()]

    def _write(self, name: str, entries) -> None:
        with self.fs.open_output_stream(f"{self.path}/.{name}") as f:
            f.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        self.fs.move(f"{self.path}/.{name}", f"{self.path}/{name}")

    def add(self, entries: list) -> None:
        self._write(f"list-{self.last + 1}", entries)
        self.last += 1
        self.seen.update(map(self._pair, entries))

    def between(self, start: int, end: int) -> list:
        return [e for n in range(start + 1, end + 1) for e in self._read(f"list-{n}")]

    def fold(self, done: int) -> None:
        """Lists up to ``done`` into the base, which is in place before they go."""
        if done - self.base < FOLD:
            return
        own = dict(map(self._pair, self._read(f"base-{self.base}"))) if self.base else {}
        own.update(map(self._pair, self.between(self.base, done)))
        self._write(f"base-{done}", ([p, *at] for p, at in own.items()))
        old, self.base = self.base, done
        for name in [f"list-{n}" for n in range(old + 1, done + 1)] + ([f"base-{old}"] if old else []):
            self.fs.delete_file(f"{self.path}/{name}")


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.place = options["path"], options["state"]
        self.most = int(options.get("most", 0))
        self.state = None

    def _state(self) -> State:
        if self.state is None:
            self.state = State(self.place)
        return self.state

    def __getstate__(self):
        return self.__dict__ | {"state": None}  # tasks get no state

    def listed(self) -> list:
        from pyarrow import fs

        found, path, prefix = filesystem(self.root)
        files = found.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted([prefix + f.path, f.mtime_ns, f.size] for f in files if f.is_file and ".jsonl" in f.base_name)

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        state = self._state()
        new = [e for e in self.listed() if state.seen.get(e[0]) != (e[1], e[2])]
        if new:
            state.add(new[: self.most] if self.most else new)
        return {"n": state.last}

    def partitions(self, start, end):
        groups, used = [[]], 0
        for e in self._state().between(start["n"], end["n"]):
            if groups[-1] and used + e[2] > SPLIT_BYTES:
                groups.append([])
                used = 0
            groups[-1].append(e)
            used += e[2]
        return [Files(g) for g in groups]

    def read(self, partition):
        found, _, prefix = filesystem(self.root)
        for path, mtime, size in partition.files:
            try:
                with found.open_input_stream(path[len(prefix) :]) as f:
                    value = f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                continue
            yield path, datetime.fromtimestamp(mtime / 1e9, UTC), size, value

    def commit(self, end):
        self._state().fold(end["n"])


class Changes(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ChangesReader(dict(self.options))


def read(spark: SparkSession, root: str, state: str, most: int = 0) -> DataFrame:
    """path, mtime, size, value (a whole file) of new and changed files, ``most`` a trigger if it is not 0."""
    spark.dataSource.register(Changes)
    return spark.readStream.format(NAME).option("path", root).option("state", state).option("most", most).load()
