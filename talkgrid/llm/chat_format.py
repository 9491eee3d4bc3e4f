"""Chat formatting by minimum-cost role repair over a legal-turn automaton.

A legal conversation is an optional system turn, then user and assistant turns by turns, ending with the
assistant. For each turn a dynamic program chooses to keep it, relabel it, merge it into the turn before,
and to insert empty turns ahead of it, at the least total cost; the repaired turns are then rendered.

A turn's choices are a small (min, +) matrix over automaton states, and such matrices multiply
associatively. So a conversation is cut into blocks of `BLOCK` turn numbers: each block is reduced to one
matrix, the matrices of a conversation decide where each block starts and ends, and then every block is
solved between those states on its own. No task holds a long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "customer": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "agent": ASSISTANT}
INSERT, RELABEL, RELABEL_UNKNOWN, MERGE_SAME, MERGE_OTHER, MERGE_UNKNOWN = 3, 2, 1, 1, 4, 2
BLOCK, FAR = 1024, 10**9
KEEP_A, RELABEL_A, MERGE_A = "keep", "relabel", "merge"


def role_of(name: str | None) -> int:
    """START stands for an unknown role."""
    return ALIASES.get((name or "").strip().lower(), START)


def _insertions() -> list[list[list[int] | None]]:
    """The shortest run of inserted user and assistant turns from each state to each; None if there is none."""
    out = []
    for s in range(4):
        best: list[list[int] | None] = [None] * 4
        best[s], todo = [], [s]
        while todo:
            p = todo.pop(0)
            for q in NEXT[p]:
                if q != SYSTEM and best[q] is None:
                    best[q] = [*best[p], q]
                    todo.append(q)
        out.append(best)
    return out


INSERTED = _insertions()


def options(state: int, role: int) -> list[tuple[int, int, str, list[int]]]:
    """(cost, next state, action, inserted turns) of a turn with `role` after `state`."""
    found = []
    for q in (SYSTEM, USER, ASSISTANT):
        label = 0 if q == role else RELABEL_UNKNOWN if role == START else RELABEL
        for p in range(4):
            if q in NEXT[p] and INSERTED[state][p] is not None:
                found.append((label + INSERT * len(INSERTED[state][p]), q, KEEP_A if q == role else RELABEL_A, INSERTED[state][p]))
    if state != START:
        found.append((MERGE_SAME if role == state else MERGE_UNKNOWN if role == START else MERGE_OTHER, state, MERGE_A, []))
    return found


def _choices() -> dict[int, list[list[tuple[int, str, list[int]] | None]]]:
    """By role, state and next state: the cheapest option, an earlier one on ties."""
    out = {}
    for role in range(4):
        table: list[list] = [[None] * 4 for _ in range(4)]
        for s in range(4):
            for cost, t, action, inserted in options(s, role):
                if table[s][t] is None or cost < table[s][t][0]:
                    table[s][t] = (cost, action, inserted)
        out[role] = table
    return out


CHOICE = _choices()
STEP = {r: np.array([[FAR if c is None else c[0] for c in row] for row in t], np.int64) for r, t in CHOICE.items()}


def product(roles: list[int]) -> np.ndarray:
    """The (min, +) matrix of a run of turns."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        m = np.minimum((m[:, :, None] + STEP[r][None]).min(axis=1), FAR)
    return m


def end_cost(state: int) -> int:
    return INSERT * len(INSERTED[state][ASSISTANT] or [])


def solve(roles: list[int], entry: int, leave: int) -> list[tuple[str, int, list[int]]]:
    """(action, role, inserted turns before) of each turn, between two states; the lower state on ties."""
    cost = np.full(4, FAR, np.int64)
    cost[entry] = 0
    back = np.empty((len(roles), 4), np.int8)
    for i, r in enumerate(roles):
        total = cost[:, None] + STEP[r]
        back[i] = total.argmin(axis=0)
        cost = np.minimum(total.min(axis=0), FAR)
    out, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        before = int(back[i, state])
        _, action, inserted = CHOICE[roles[i]][before][state]
        out.append((action, state, inserted))
        state = before
    return out[::-1]


def _empty(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n<|im_end|>\n"


def render(steps: list[tuple[str, int, list[int]]], texts: list[str | None], entry: int, tail: list[int] | None) -> list[str]:
    """One piece for each turn; pieces in order, one after another, are the rendered conversation. `tail`: turns
    to insert after the last one, if the conversation ends here."""
    out, is_open = [], entry != START
    for (action, role, inserted), text in zip(steps, texts, strict=True):
        if action == MERGE_A:
            out.append(f"\n\n{text or ''}")
        else:
            out.append(("<|im_end|>\n" if is_open else "") + "".join(map(_empty, inserted)) + f"<|im_start|>{NAMES[role]}\n{text or ''}")
        is_open = True
    if tail is not None and out:
        out[-1] += "<|im_end|>\n" + "".join(map(_empty, tail))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *rest]), strict=True):
            if row[: len(keys)] != now and rows:
                yield now, rows
                rows = []
            now = row[: len(keys)]
            rows.append(row[len(keys) :])
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))])
    rows = ((*key, product([role_of(r[0]) for r in got]).ravel().tolist()) for key, got in _groups(batches, ["conv_id", "block", "part"], ["role"]))
    yield from _batches(rows, schema)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block matrices of whole conversations, in order, to each block's first and last state."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("entry", pa.int8()), ("leave", pa.int8()), ("is_last", pa.bool_())])

    def rows() -> Iterator[tuple]:
        for (conv,), got in _groups(batches, ["conv_id"], ["block", "part", "costs"]):
            cost, ways = np.array([0, FAR, FAR, FAR], np.int64), []
            for _, _, m in got:
                total = cost[:, None] + np.array(m, np.int64).reshape(4, 4)
                ways.append(total.argmin(axis=0))
                cost = np.minimum(total.min(axis=0), FAR)
            state = int(np.argmin(cost + [end_cost(s) for s in range(4)]))
            out = []
            for i in range(len(got) - 1, -1, -1):
                before = int(ways[i][state])
                out.append((conv, got[i][0], got[i][1], before, state, i == len(got) - 1))
                state = before
            yield from reversed(out)

    yield from _batches(rows(), schema)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int32()), ("cost", pa.int32()), ("rendered", pa.string())])

    def rows() -> Iterator[tuple]:
        for (conv, _, _), got in _groups(batches, ["conv_id", "block", "part"], ["turn", "role", "text", "entry", "leave", "is_last"]):
            entry, leave, is_last = got[0][3:]
            roles = [role_of(r[1]) for r in got]
            steps = solve(roles, entry, leave)
            tail = (INSERTED[leave][ASSISTANT] or []) if is_last else None
            state = entry
            for i, ((action, role, inserted), piece, row) in enumerate(zip(steps, render(steps, [r[2] for r in got], entry, tail), got, strict=True)):
                more = len(tail) if tail and i == len(got) - 1 else 0
                cost = CHOICE[roles[i]][state][role][0] + INSERT * more
                state = role
                yield conv, row[0], row[1], NAMES[role], action, len(inserted) + more, cost, piece

    yield from _batches(rows(), schema)


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of `turns` (conv_id, turn, role, text): conv_id, turn, role, new_role, action, n_inserted,
    cost, rendered.

    Turns are taken in order of turn, then the SHA-1 of the text, then role (nulls first), so ties and
    repeated rows have a defined place; identical rows are all kept. A null turn comes first, rows without
    conv_id are one conversation, a null or unknown role is cheap to relabel, a null text is empty. A
    conversation's `rendered` pieces in that order, one after another, are its text; its `cost` sums to the
    least possible; of several repairs at that cost, which one is taken is fixed, but may differ with `block`
    in conversations longer than it. Where more than `block` rows share a turn number, that block is cut finer, by turn and
    text. Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62)))).withColumn("mark", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    crowd = rows.groupBy("conv_id", "block", "turn").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("conv_id", "block").distinct().withColumn("_c", F.lit(True))
    finer = F.coalesce(F.col("turn") - F.col("block") * block, F.lit(0)) * 65536 + F.conv(F.substring("mark", 1, 4), 16, 10).cast("long")
    rows = _joined(rows, crowd, ["conv_id", "block"]).withColumn("part", F.when(F.col("_c"), finer).otherwise(F.lit(0)).cast("long")).drop("_c")
    keys = ["conv_id", "block", "part"]
    order = [*keys, "turn", "mark", "role", "text"]
    matrices = rows.drop("text").repartition(*keys).sortWithinPartitions(*order[:-1]).mapInArrow(_reduce, "conv_id long, block long, part long, costs array<long>")
    routes = matrices.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(_route, "conv_id long, block long, part long, entry tinyint, leave tinyint, is_last boolean")
    solved = _joined(rows, routes, keys).repartition(*keys).sortWithinPartitions(*order)
    return solved.mapInArrow(_repair, "conv_id long, turn long, role string, new_role string, action string, n_inserted int, cost int, rendered string")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that matches null keys."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])
