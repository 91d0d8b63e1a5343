"""Files of a folder and the members of their archives, as rows.

Zip and tar archives (plain or compressed by gzip, bzip2 or xz) are opened by the tasks, also
archives within archives, to ``DEPTH``. A member's path is its archive's path,
``!/`` and its name. The archive itself is a row too, since its own bytes are
what a digest pins.

Edge cases: an archive that can't be read in full gives what could be read and
``error`` on its row; a member that is encrypted or larger than ``most`` bytes
has no text and an ``error``; folders and links in archives are no members; bytes that are
no UTF-8 come out replaced; empty files have no row (Spark's source leaves them out), empty members have one. A file is one row (at most 2 GB, as in Spark's source of binary files),
members leave one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 4
MOST = 1 << 28
SCHEMA = "path string, size bigint, digest string, text string, error string"
ENDINGS = {".zip": "zip", ".whl": "zip", ".jar": "zip", ".tar": "tar", ".tgz": "tar", ".tbz2": "tar", ".txz": "tar", ".tar.gz": "tar", ".tar.bz2": "tar", ".tar.xz": "tar"}


def _open(depth: int, most: int):
    endings = tuple(ENDINGS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import io
        import tarfile
        import zipfile
        import zlib

        broken = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)
        names = ["path", "size", "digest", "text", "error"]

        def kind(path: str):
            return next((k for end, k in endings if path.lower().endswith(end)), None)

        def inside(data: bytes, how: str):
            """(name, size, function that reads it) of each member."""
            if how == "zip":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield i.filename, i.file_size, lambda i=i: z.read(i)
            else:
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for i in t:
                        if i.isfile():
                            yield i.name, i.size, lambda i=i: t.extractfile(i).read()

        def rows(path: str, data: bytes, left: int):
            error, how = None, kind(path)
            if how and left:
                try:
                    for name, size, get in inside(data, how):
                        own = f"{path}!/{name}"
                        if size > most:
                            yield own, size, None, None, "too large"
                            continue
                        try:
                            body = get()
                        except broken as e:
                            yield own, size, None, None, type(e).__name__
                            continue
                        yield from rows(own, body, left - 1)
                except broken as e:
                    error = type(e).__name__
            elif how:
                error = "too deep"
            yield path, len(data), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace"), error

        for b in batches:
            for k in range(b.num_rows):
                for row in rows(b.column(0)[k].as_py(), b.column(1)[k].as_py() or b"", depth):
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return run


def members(files: DataFrame, *, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """path, size, digest (SHA-256), text, error of files (path, content) and the members of those that are archives."""
    return files.select("path", "content").mapInArrow(_open(depth, most), SCHEMA)


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    """``members`` of all files under a folder, paths relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    tail = F.substring_index("path", base + "/", -1) if base else F.col("path")
    whole = F.expr("regexp_replace(path, '^[a-z0-9]+:/*', '')")
    own = F.when(whole.startswith(base + "/"), F.substring(whole, len(base) + 2, 1 << 30)).otherwise(tail)
    return members(found.select(own.alias("path"), "content"), **options)
