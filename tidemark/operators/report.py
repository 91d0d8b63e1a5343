"""Results, reports and manifests of evaluation runs, written on the driver.

The inputs are aggregates: a row for each configuration, group or phase.
"""

from __future__ import annotations

import json
import os
import platform
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvaluationError
from ..schema import CHUNKS


def rows_of(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """An aggregate's rows as plain values. More rows than ``limit`` are an error: none is left out."""
    found = df.limit(limit + 1).toJSON().collect()
    if len(found) > limit:
        raise EvaluationError(f"a part has more than {limit} rows", code="report_too_large")
    return [json.loads(x) for x in found]


def write_json(path: str, value) -> None:
    """Write a document whole or not at all."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True)
        f.write("\n")
    os.replace(temp, path)


def results(configs: DataFrame, groups: DataFrame, phases: DataFrame, leaks: DataFrame | None = None) -> dict:
    """The parts of a run: means by configuration, by group, latency by phase, leaks."""
    parts = {"configs": configs, "groups": groups, "phases": phases} | ({"leaks": leaks} if leaks is not None else {})
    return {name: rows_of(df) for name, df in parts.items()}


def markdown(title: str, found: dict, worst_by: str = "ndcg") -> str:
    """A report: one table for each part, groups with the worst first."""

    def cell(v):
        return "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)

    out = [f"# {title}"]
    for name, rows in found.items():
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("none")
            continue
        columns = list(dict.fromkeys(k for r in rows for k in r))
        if name == "groups" and worst_by in columns:
            rows = sorted(rows, key=lambda r: (r.get(worst_by) is None, r.get(worst_by) or 0))
        out += ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
        out += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(out) + "\n"


def manifest(spark: SparkSession, inputs: dict[str, str], **facts) -> dict:
    """What a run read: size and digest of each input file, and the environment."""
    files = {}
    for name, path in inputs.items():
        found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("n"), "length", F.sha2("content", 256).alias("d")).orderBy("n").collect()
        files[name] = [{"file": r.n, "bytes": r.length, "sha256": r.d} for r in found]
    return {"inputs": files, "python": platform.python_version(), "spark": spark.version, "platform": platform.platform(), **facts}


def corpus_chunks(corpus: DataFrame, vectors: DataFrame, model: str, prefix: str) -> DataFrame:
    """An evaluation corpus as rows of the managed chunk table; a document without a vector fails."""
    met = corpus.join(vectors.select("id", "embedding"), "id", "left")
    vector = F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no vector for "), "id")).cast("array<float>"))
    own = {
        "session_id": F.concat(F.lit(f"{prefix}-"), "session"),
        "source_type": F.col("source_kind"),
        "embedding": vector,
        "embedding_model": F.lit(model),
        "timestamp_start": F.col("timestamp"),
        "timestamp_end": F.col("timestamp"),
        "turn_index_start": F.lit(0),
        "turn_index_end": F.lit(0),
        "created_at": F.current_timestamp(),
    }
    given = set(met.columns)
    return met.select(*(own.get(f.name, F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields))
