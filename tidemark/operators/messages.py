"""Messages of session files, chat archives and session stores as text items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact
from ..functions.times import from_text
from ..schema import CHAT_TYPES, CLASSIFY_CHARS, CLASSIFY_LINES, MIN_MESSAGE_CHARS

SOURCE_NAMES = {"subagent": "subagent", "cron": "cron", "main": "main_user", "cli": "main_user"}


def message_text(content: Column) -> Column:
    """Text of a message whose ``content`` JSON is a string or a list of parts."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(
        parts,
        lambda p: F.when(F.get_json_object(p, "$.type") == "text", F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))),
    )
    joined = F.array_join(F.filter(texts, lambda x: x.isNotNull()), "\n")
    plain = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "struct<v: string>")["v"]
    return F.when(F.trim(content).startswith("["), joined).when(F.trim(content).startswith('"'), plain)


def is_tool_call(role: Column, text: Column) -> Column:
    return (role == "assistant") & F.ltrim(text).startswith("{") & F.contains(F.substring(text, 1, 100), F.lit('"tool_calls"'))


def session_items(rows: DataFrame, *, keep: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Items of user and assistant turns: ``[role] text``, redacted.

    ``rows``: role, text, timestamp (text), turn_index and the ``keep`` columns.
    Tool calls and texts under five characters go.
    """
    body = F.trim("text")
    kept = rows.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull() & ~is_tool_call(F.col("role"), F.col("text")) & (F.length(body) >= MIN_MESSAGE_CHARS))
    item = F.concat(F.lit("["), F.col("role"), F.lit("] "), redact(body))
    return kept.select(*keep, item.alias("item"), from_text("timestamp").alias("ts"), F.col("turn_index").cast("int").alias("turn_index"))


def chat_items(rows: DataFrame, *, keep: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Items of chat messages: ``[YYYY-MM-DD HH:MM] name: content`` with attachments and embeds.

    ``rows``: type, timestamp (text), content, author struct<global_name,
    username>, attachments array<struct<filename>>, embeds array<struct<title>>,
    turn_index and the ``keep`` columns.
    """
    ts = from_text("timestamp")
    stamp = F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.substring("timestamp", 1, 16), F.lit(""))
    name = F.coalesce(F.nullif(F.col("author.global_name"), F.lit("")), F.nullif(F.col("author.username"), F.lit("")), F.lit("unknown"))

    def more(column: str, key: str, label: str) -> Column:
        named = F.filter(F.col(column), lambda x: F.coalesce(x[key], F.lit("")) != "")
        return F.coalesce(F.array_join(F.transform(named, lambda x: F.concat(F.lit(f" [{label}: "), x[key], F.lit("]"))), ""), F.lit(""))

    body = F.concat(F.trim(F.coalesce("content", F.lit(""))), more("attachments", "filename", "attachment"), more("embeds", "title", "embed"))
    item = F.concat(F.lit("["), stamp, F.lit("] "), name, F.lit(": "), redact(F.trim(body)))
    return rows.where(F.col("type").isin(*CHAT_TYPES) & (F.trim(body) != "")).select(*keep, item.alias("item"), ts.alias("ts"), F.col("turn_index").cast("int").alias("turn_index"))


def classify(lines: DataFrame) -> DataFrame:
    """Source type of each file from the head of its first lines (path, line_no, value)."""
    head = lines.where(F.col("line_no") <= CLASSIFY_LINES).select("path", "line_no", F.substring("value", 1, CLASSIFY_CHARS).alias("head"))
    flags = head.groupBy("path").agg(F.bool_or(F.contains("head", F.lit("Subagent"))).alias("sub"), F.bool_or(F.contains("head", F.lit("[cron:")) | F.contains("head", F.lit("cron job"))).alias("cron"))
    return flags.select("path", F.when(F.col("sub"), "subagent").when(F.col("cron"), "cron").otherwise("main_user").alias("source_type"))


def source_type(column: Column | str) -> Column:
    """Vocabulary of a session store mapped to source types."""
    names = F.create_map(*(F.lit(x) for pair in SOURCE_NAMES.items() for x in pair))
    return F.coalesce(names[F.col(column) if isinstance(column, str) else column], F.lit("main_user"))


def session_id(name: Column | str) -> Column:
    """File name up to the first dot, marked when it is a deleted version."""
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(F.substring_index(name, ".", 1), F.when(F.contains(name, F.lit(".deleted.")), F.lit(":deleted")).otherwise(F.lit("")))


def chat_session_id(channel: Column | str) -> Column:
    return F.concat(F.lit("chat-"), F.col(channel) if isinstance(channel, str) else channel)
