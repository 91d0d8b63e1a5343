"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant
turns in alternation, user first, assistant last. Each turn of a conversation
is kept, relabelled to another role, merged into the turn before it, or
preceded by an empty turn; the choice with the least total cost is found by
dynamic programming over the automaton of legal turns (start, system, user,
assistant), and the repaired sequence is rendered.

Ties go to the cheaper local action in the order of ``ROLES``; the repair has
least cost in any case.

Distribution. Turns are sorted by range over (conversation, turn), so one
conversation may lie in several partitions, and each partition is cut into
blocks of at most ``BLOCK`` turns. A block's effect is a 4 x 4 matrix of least
costs from entry to exit state, and matrices chain with (min, +), so long
conversations are resolved from matrices alone - first within each partition,
then over the partitions - before their blocks are replayed, each by itself,
with known entry and exit states. The output has a fragment for each turn, and
a conversation's fragments in order are its rendered text; no task holds a
conversation.

Order within a conversation: turn (nulls last), role (nulls first), hash of the
text, text; ``seq`` numbers the turns so from 0. Edge cases: null
or unknown roles may become any role at a small cost; null text is empty; rows
without conversation id form one conversation; repeated rows stay as turns of
their own and are merged; texts of any length are rendered whole; the template's marks inside a text are broken up, so
they cannot open a turn; an empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT = 1.0, 2.0
RELABEL = {"system": (0.0, 2.0, 4.0), "user": (4.0, 0.0, 3.0), "assistant": (4.0, 3.0, 0.0), None: (3.0, 1.0, 1.0)}
BLOCK = 256
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
MARKS = (("<|im_start|>", "< |im_start|>"), ("<|im_end|>", "< |im_end|>"))

BLOCK_SCHEMA = "conv_id long, part int, block long, whole boolean, first long, turns array<long>, roles array<string>, texts array<string>, costs array<double>"
TURN_SCHEMA = "conv_id long, part int, block long, place int, turn long, seq long, role_in string, role string, action string, inserted array<string>, cost double, rendered string"


def normal_role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else None


def _fillers() -> dict[tuple[int, int], list[int]]:
    """The fewest empty turns that make state b legal after state a."""
    out = {}
    for a in NEXT:
        for b in (SYSTEM, USER, ASSISTANT):
            paths = [[]] if b in NEXT[a] else [[x] for x in NEXT[a] if x != SYSTEM and b in NEXT[x]]
            if paths:
                out[a, b] = paths[0]
    return out


FILL = _fillers()


def options(role: str | None) -> list[tuple[int, int, float, str]]:
    """Moves for a turn: (from state, to state, cost, action)."""
    out = []
    for k, name in enumerate(ROLES, start=1):
        change = RELABEL[role][k - 1]
        label = "keep" if name == role else "relabel"
        for s in NEXT:
            if (s, k) in FILL:
                out.append((s, k, change + INSERT * len(FILL[s, k]), label))
            if s == k:
                out.append((s, k, change + MERGE, "merge" if name == role else "merge+relabel"))
    return out


def _steps() -> dict[str | None, tuple[np.ndarray, dict[tuple[int, int], str]]]:
    out = {}
    for role in (*ROLES, None):
        cost, how = np.full((4, 4), np.inf), {}
        for a, b, c, action in options(role):
            if c < cost[a, b]:
                cost[a, b], how[a, b] = c, action
        out[role] = cost, how
    return out


STEPS = _steps()
#: Empty turns that end a conversation legally, by its last state.
ENDING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)])
UNIT = np.where(np.eye(4, dtype=bool), 0.0, np.inf)


def chain(matrices) -> np.ndarray:
    """(min, +) product."""
    out = UNIT
    for m in matrices:
        out = (out[:, :, None] + m[None]).min(axis=1)
    return out


def states(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """States before the first and after each matrix on a cheapest path; ``leave`` None: the best end."""
    ahead, back = np.where(np.arange(4) == entry, 0.0, np.inf), []
    for m in matrices:
        total = ahead[:, None] + m
        back.append(total.argmin(axis=0))
        ahead = total.min(axis=0)
    path = [int((ahead + END_COST).argmin()) if leave is None else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def repair(roles: list[str | None], entry: int = START, leave: int | None = None) -> list[tuple[int, int]]:
    """(state before, state after) of each turn."""
    path = states([STEPS[r][0] for r in roles], entry, leave)
    return list(zip(path, path[1:], strict=False))


def fragments(roles, texts, entry: int, leave: int | None, last: bool) -> list[tuple[str, str, list[str], float, str]]:
    """(role, action, inserted, cost, rendered) of each turn of a block."""
    out = []
    moves = repair([normal_role(r) for r in roles], entry, leave)
    for n, ((a, b), role, text) in enumerate(zip(moves, roles, texts, strict=True)):
        cost, how = STEPS[normal_role(role)]
        action, name = how[a, b], ROLES[b - 1]
        text = text or ""
        for mark, broken in MARKS:
            text = text.replace(mark, broken)
        if action.startswith("merge"):
            inserted, body = [], JOINT + text
        else:
            inserted = [ROLES[x - 1] for x in FILL[a, b]]
            body = (CLOSE if a != START else "") + "".join(OPEN.format(x) + CLOSE for x in inserted) + OPEN.format(name) + text
        total = float(cost[a, b])
        if last and n == len(moves) - 1:
            more = [ROLES[x - 1] for x in ENDING[b]]
            body += CLOSE + "".join(OPEN.format(x) + CLOSE for x in more)
            inserted, total = inserted + more, total + float(END_COST[b])
        out.append((name, action, inserted, total, body))
    return out


def _flush(conv, part, block, whole, first, rows) -> tuple:
    turns, roles, texts = (list(x) for x in zip(*rows, strict=True))
    costs = chain(STEPS[normal_role(r)][0] for r in roles)
    return conv, part, (part << 32) + block, whole, first, turns, roles, texts, costs.ravel()


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


BLOCK_NAMES = [x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64())]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition; whole: the conversation lies in this block alone."""
    part = TaskContext.get().partitionId()
    held, conv, blocks, first, number, out = [], None, 0, True, 0, []
    none = object()
    conv = none

    def flush(whole: bool):
        nonlocal held, number
        out.append(_flush(conv, part, number, whole, blocks * BLOCK, held))
        number, held = number + 1, []

    for b in slices(batches, 3, 4096):
        for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if c != conv and held:
                flush(not first and not blocks)
                first, blocks = False, 0
            elif len(held) == BLOCK:
                flush(False)
                blocks += 1
            conv = c
            held.append(tuple(row))
        if out:
            yield _batch(out, BLOCK_NAMES, BLOCK_TYPES)
            out = []
    if held:
        flush(False)  # the conversation may go on in the next partition
        yield _batch(out, BLOCK_NAMES, BLOCK_TYPES)


def _product(group: pa.Table) -> pa.Table:
    group = group.sort_by("block")
    m = chain(np.array(x).reshape(4, 4) for x in group["costs"].to_pylist())
    one = group.slice(0, 1).select(["conv_id", "part"])
    turns = pa.array([sum(group["n"].to_pylist())], pa.int64())
    return one.append_column("costs", pa.array([m.ravel()], pa.list_(pa.float64()))).append_column("n", turns)


def _resolve_parts(group: pa.Table) -> pa.Table:
    group = group.sort_by("part")
    path = states([np.array(x).reshape(4, 4) for x in group["costs"].to_pylist()], START, None)
    n, turns = group.num_rows, group["n"].to_numpy()
    out = group.select(["conv_id", "part"]).append_column("base", pa.array(np.cumsum(turns) - turns, pa.int64()))
    return out.append_column("entry", pa.array(path[:-1], pa.int32())).append_column("leave", pa.array(path[1:], pa.int32())).append_column("last", pa.array([k == n - 1 for k in range(n)]))


def _resolve_blocks(group: pa.Table) -> pa.Table:
    group = group.sort_by("block")
    path = states([np.array(x).reshape(4, 4) for x in group["costs"].to_pylist()], group["entry"][0].as_py(), group["leave"][0].as_py())
    n, last = group.num_rows, group["last"][0].as_py()
    before = pc.add(group["first"], group["base"])
    return pa.table({"block": group["block"], "before": before, "entry": pa.array(path[:-1], pa.int32()), "leave": pa.array(path[1:], pa.int32()), "last": pa.array([last and k == n - 1 for k in range(n)])})


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in TURN_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string()]
    for b in batches:
        for at in range(0, b.num_rows, 64):
            rows = []
            for r in b.slice(at, 64).to_pylist():
                entry = START if r["entry"] is None else r["entry"]
                own = fragments(r["roles"], r["texts"], entry, r["leave"], r["last"] is not False)
                rows += [(r["conv_id"], r["part"], r["block"], k, t, (r["before"] or 0) + k, old, *x) for k, (t, old, x) in enumerate(zip(r["turns"], r["roles"], own, strict=True))]
            if rows:
                yield _batch(rows, names, types)


def format_turns(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn (``TURN_SCHEMA``); ``seq`` numbers a conversation's fragments from 0."""
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order[:3], F.xxhash64("text")).sortWithinPartitions(*order[:3], F.xxhash64("text"), F.col("text"))
    blocks, _ = materialize(dealt.mapInArrow(_cut, BLOCK_SCHEMA), "chat-blocks")
    cut = blocks.where("not whole").select("conv_id", "part", "block", "costs", "first", F.size("turns").cast("long").alias("n"))
    parts = cut.groupBy("conv_id", "part").applyInArrow(_product, "conv_id long, part int, costs array<double>, n long")
    ends = parts.groupBy("conv_id").applyInArrow(_resolve_parts, "conv_id long, part int, base long, entry int, leave int, last boolean")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "base", "entry", "leave", "last")
    known = cut.join(ends, cut["conv_id"].eqNullSafe(F.col("c")) & (cut["part"] == F.col("p"))).select("conv_id", "part", "block", "costs", "first", "base", "entry", "leave", "last")
    resolved = known.groupBy("conv_id", "part").applyInArrow(_resolve_blocks, "block long, before long, entry int, leave int, last boolean")
    return blocks.drop("costs").join(resolved, "block", "left").select("conv_id", "part", "block", "turns", "roles", "texts", "before", "entry", "leave", "last").mapInArrow(_replay, TURN_SCHEMA)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = format_turns(table(spark, sf_dir, "conversations"))
    return turns.select(
        "conv_id", "seq", "turn", "role_in", "role", "action", F.array_join("inserted", ",").alias("inserted"), "cost", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256")
    )
