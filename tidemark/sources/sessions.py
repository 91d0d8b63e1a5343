"""Session files: discovery, choice of versions, lines, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.messages import message_text

SKIPPED = (".trajectory.jsonl", ".checkpoint.", ".bak")


def is_session(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    out = (name.endswith(".jsonl") | F.contains(name, F.lit(".jsonl.deleted."))) & ~name.endswith(".trajectory-path.json")
    for part in SKIPPED:
        out = out & ~F.contains(name, F.lit(part))
    return out


def choose(files: DataFrame) -> DataFrame:
    """Of each session (name up to the first dot): every active file, the largest deleted one, or the only file."""
    key, gone = F.substring_index("name", ".", 1), F.contains("name", F.lit(".deleted."))
    own = files.where(is_session("name")).withColumn("_key", key).withColumn("_gone", gone)
    own = own.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).withColumn("_r", F.row_number().over(Window.partitionBy("_key", "_gone").orderBy(F.col("size").desc(), "name")))
    return own.where("_n = 1 or not _gone or _r = 1").drop("_key", "_gone", "_n", "_r")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, mtime of the chosen session files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return choose(files).orderBy("path")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (from 1), value of every line; bad bytes come out replaced."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n", -1)).alias("n", "value")).select("path", (F.col("n") + 1).alias("line_no"), F.trim("value").alias("value"))


def messages(rows: DataFrame) -> DataFrame:
    """Messages of session lines: path, turn_index, role, text, timestamp. Invalid lines are passed over."""
    own = rows.where((F.col("value") != "") & (F.get_json_object("value", "$.type") == "message"))
    content = F.from_json("value", "struct<message: struct<content: string>>")["message"]["content"]
    raw = F.from_json("value", "struct<message: map<string, string>>")["message"]["content"]
    is_list = F.trim(content).startswith("[")
    quoted = F.when(is_list, content).otherwise(F.to_json(F.struct(raw.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(raw.alias("v")))) - 6))
    return own.select(
        "path", F.col("line_no").alias("turn_index"), F.get_json_object("value", "$.message.role").alias("role"), message_text(quoted).alias("text"), F.coalesce(F.get_json_object("value", "$.timestamp"), F.get_json_object("value", "$.message.timestamp")).alias("timestamp")
    )
