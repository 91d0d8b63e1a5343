"""Session stores: sessions and messages in a database, read only.

Filters go into the database where Spark hands them over
(the setting ``PUSHED``, on in ``session.SETTINGS``), and
``columns`` leaves out what a reader does not need. Both only spare work:
without them Spark filters and selects the same rows.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..errors import ConfigError
from ..operators.messages import source_type

SESSIONS = "id string, source string, title string, chat_id string, message_count int, started_at double, last_activity_at double, rewind_count int"
MOST_VALUES = 500
PUSHED = "spark.sql.python.filterPushdown.enabled"
MESSAGES = "id bigint, session_id string, role string, content string, timestamp double, active int, compacted int"


COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as a condition of the database with its values; None if the two might disagree.

    They agree on null tests, on equality with values of the column's kind
    (compared by bytes for text), and on the order of numbers.
    """
    path = getattr(f, "attribute", ())  # a negation has none
    if len(path) != 1 or path[0] not in kinds:
        return None
    column = path[0]
    text = kinds[column] == "string"
    fits = (lambda v: isinstance(v, str)) if text else (lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == v)
    name = f'"{column}" COLLATE BINARY' if text else f'"{column}"'
    if isinstance(f, IsNull | IsNotNull):
        return f'"{column}" IS {"NOT " * isinstance(f, IsNotNull)}NULL', []
    if isinstance(f, In) and f.value and all(map(fits, f.value)):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in COMPARED and fits(f.value) and (isinstance(f, EqualTo) or not text):
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    return None


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Row-id ranges of one table, one range a task; the file must be visible to the executors."""

    def __init__(self, options: dict, kinds: dict[str, str]):
        self.path, self.table, self.kinds = options["path"], options["table"], kinds
        self.parts = int(options.get("partitions", 4))
        self.conditions, self.values = [], []

    def _open(self):
        if not os.path.exists(self.path):
            raise ConfigError("the store does not exist", code="source_not_found")
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.kinds)
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.conditions])
        with self._open() as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', (partition.low, partition.high, *self.values))


class PushingReader(SqliteReader):
    """A reader that takes filters: Spark refuses one where its setting is off."""

    def pushFilters(self, filters):
        for f in filters:
            own = condition(f, self.kinds)
            if own is None or len(self.values) + len(own[1]) > MOST_VALUES:
                yield f
            else:
                self.conditions.append(own[0])
                self.values += own[1]


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite-store"

    def schema(self):
        fields = {"sessions": SESSIONS, "messages": MESSAGES}[self.options["table"]].split(", ")
        asked = self.options.get("columns")
        return ", ".join(f for f in fields if not asked or f.split()[0] in asked.split(","))

    def reader(self, schema):
        kind = PushingReader if self.options.get("pushed") == "true" else SqliteReader
        return kind(dict(self.options), {f.name: f.dataType.simpleString() for f in schema.fields})


def read_table(spark: SparkSession, path: str, name: str, partitions: int = 4, columns: tuple[str, ...] = ()) -> DataFrame:
    """A table of the store, or some of its columns."""
    if not os.path.exists(path):
        raise ConfigError("the store does not exist", code="source_not_found")
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": name, "partitions": partitions, "columns": ",".join(columns), "pushed": spark.conf.get(PUSHED, "false")}
    return spark.read.format("sqlite-store").options(**options).load()


def rewound(sessions: DataFrame, hidden: DataFrame, key: str = "session_id") -> DataFrame:
    """Flag sessions with a hidden message (an EXISTS as a join)."""
    flag = hidden.select(key).distinct().withColumn("_hit", F.lit(True))
    return sessions.join(flag, key, "left").withColumn("rewound", F.coalesce("_hit", F.lit(False))).drop("_hit")


def sessions(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their mapped source, scheduled ones left out, in order of activity."""
    hidden = messages.where("active = 0 and compacted = 0").select(F.col("session_id").alias("id"))
    own = rewound(rows, hidden, "id").withColumn("source_type", source_type("source")).where("source_type <> 'cron'")
    return own.withColumnRenamed("id", "session_id").orderBy(F.col("last_activity_at").asc_nulls_first())


def visible_messages(rows: DataFrame) -> DataFrame:
    """User and assistant messages with text that are active or were compacted."""
    return rows.where(F.col("role").isin("user", "assistant") & F.col("content").isNotNull() & (F.length("content") > 0) & ((F.col("active") == 1) | (F.col("compacted") == 1)))
