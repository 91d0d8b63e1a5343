"""Chat archives: one JSON-lines file for each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sessions import lines

MESSAGE = "id string, type int, timestamp string, content string, author struct<global_name: string, username: string>, attachments array<struct<filename: string>>, embeds array<struct<title: string>>"


def messages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Messages of each channel, numbered in the order of their raw timestamps (missing first)."""
    rows = lines(spark, paths).where("value <> ''").withColumn("m", F.from_json("value", MESSAGE))
    rows = rows.where(F.col("m").isNotNull() & F.get_json_object("value", "$").isNotNull())
    channel = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    w = Window.partitionBy("channel").orderBy(F.coalesce("timestamp", F.lit("")), "line_no")
    return rows.select(channel.alias("channel"), "line_no", "m.*").withColumn("turn_index", F.row_number().over(w) - 1)
