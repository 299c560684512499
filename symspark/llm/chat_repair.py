"""Chat formatting: minimum-cost repair of role sequences, then rendering.

Legal conversations are those of a small automaton: an optional system turn, then user and assistant in
turn, ending with the assistant. Each turn may be kept, given another role, or merged into the turn
before it, and empty turns may be inserted, each at a cost; dynamic programming finds the cheapest
legal sequence. Ties prefer the state of lower number before each turn.

A conversation is cut into blocks of turns. What a block does to the costs of the states is a 4 x 4
matrix of the (min, +) algebra, so blocks are evaluated on their own, chained by their matrices, and
repaired on their own given the costs at their start and the state at their end: one conversation may be as long as a
third of all rows. The result is that of one pass over the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save

#: Turns of a block: rows whose turn numbers have the same quotient by it.
BLOCK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
RELABEL, RELABEL_SYSTEM, LABEL_UNKNOWN, MERGE, INSERT = 3, 5, 1, 2, 4
FAR = 1 << 40
#: Empty turns to insert when going from one state to another, None where that can't be (no system turn but the first).
_STEPS: dict[tuple[int, int], tuple[int, ...] | None] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, SYSTEM): None, (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, SYSTEM): None, (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
_CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


_OPENS = re.compile("<(\u200b*)\\|")


def role_of(name: str | None) -> int:
    """The state of a role name; START for an unknown or missing one."""
    return ALIASES.get((name or "").strip().lower(), START)


def _label_cost(role: int, to: int) -> int:
    if role == to:
        return 0
    if role == START:
        return LABEL_UNKNOWN
    return RELABEL_SYSTEM if SYSTEM in (role, to) else RELABEL


def _step_matrix(role: int) -> np.ndarray:
    """Costs of a turn of that role, from each state to each."""
    out = np.full((4, 4), FAR, dtype=np.int64)
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            ways = [MERGE] if a == b else []
            if _STEPS[a, b] is not None:
                ways.append(INSERT * len(_STEPS[a, b]))
            if ways:
                out[a, b] = min(ways) + _label_cost(role, b)
    return out


_MATRICES = {r: _step_matrix(r) for r in range(4)}
_FIRST = np.array([0, FAR, FAR, FAR], dtype=np.int64)
_LAST = np.array([0, *(INSERT * len(_CLOSING[s]) for s in (SYSTEM, USER, ASSISTANT))], dtype=np.int64)


def block_matrix(roles: list[int]) -> np.ndarray:
    """The (min, +) product of the turns' matrices."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        out = np.minimum((out[:, :, None] + _MATRICES[r][None, :, :]).min(axis=1), FAR)
    return out


def walk(roles: list[int], costs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """From the costs of the states before: for each turn, the best state before it for each state after it; and the costs at the end."""
    back = []
    for r in roles:
        total = np.minimum(costs[:, None] + _MATRICES[r], FAR)
        back.append(total.argmin(axis=0))
        costs = total.min(axis=0)
    return back, costs


def trace(back: list[np.ndarray], last: int) -> list[int]:
    """States before the first turn and after each turn, given the last."""
    states = [last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def moves(roles: list[int], states: list[int]) -> list[tuple[int | None, int, str]]:
    """(index of the turn or None for an inserted one, role, action) in order."""
    out: list[tuple[int | None, int, str]] = []
    for i, role in enumerate(roles):
        a, b = states[i], states[i + 1]
        how = "keep" if role == b else "relabel"
        steps = _STEPS[a, b]
        if a == b and (steps is None or MERGE <= INSERT * len(steps)):
            out.append((i, b, "merge" if how == "keep" else "relabel_merge"))
            continue
        out += [(None, s, "insert") for s in steps or ()]
        out.append((i, b, how))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first `keys` columns."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and own[0][:keys] != row[:keys]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    own: list[tuple] = []
    for row in rows:
        own.append(row)
        if len(own) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)
            own = []
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.int64()))])
    yield from _batches(((g[0][0], g[0][1], block_matrix([role_of(r[3]) for r in g]).ravel().tolist()) for g in _groups(batches, 2)), schema)


def _cost_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along the blocks of a conversation: costs at the start of each, and at the end of the last."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("last", pa.int32())])

    def rows():
        costs, now, conv = _FIRST, None, object()
        for batch in batches:
            for c, b, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if now is not None:
                        yield (*now, int((costs + _LAST).argmin()))
                    conv, costs = c, _FIRST
                elif now is not None:
                    yield (*now, None)
                now = (c, b, costs.tolist())
                costs = np.minimum((costs[:, None] + np.array(m).reshape(4, 4)).min(axis=0), FAR)
        if now is not None:
            yield (*now, int((costs + _LAST).argmin()))

    yield from _batches(rows(), schema)


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, the state it starts from for each state it ends in."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entries", pa.list_(pa.int32())), ("last", pa.int32())])

    def rows():
        for g in _groups(batches, 2):
            back, _ = walk([role_of(r[3]) for r in g], np.array(g[0][5], dtype=np.int64))
            yield g[0][0], g[0][1], [trace(back, s)[0] for s in range(4)], g[0][6]

    yield from _batches(rows(), schema)


def _exit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back along the blocks of a conversation: the state each ends in."""
    schema = pa.schema([("c", pa.int64()), ("b", pa.int64()), ("exit", pa.int32()), ("is_last", pa.bool_())])

    def rows():
        state = 0
        for batch in batches:
            for c, b, entries, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                state = last if last is not None else state
                yield c, b, state, last is not None
                state = entries[state]

    yield from _batches(rows(), schema)


_OUT = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def escaped(text: str) -> str:
    """A turn's text with one more zero-width space in each `<|`, so that no text can end its turn or start another."""
    return _OPENS.sub("<\\1\u200b|", text)


def unescaped(text: str) -> str:
    """The text that escaped() was given."""
    return _OPENS.sub(lambda m: "<" + m[1][1:] + "|", text)


def render(kind: str, role: int, text: str, first: bool) -> str:
    """A turn's part of the rendered conversation: a merged turn goes on with the text before it, another one first closes that."""
    if kind.endswith("merge"):
        return "\n\n" + escaped(text)
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{escaped(text)}"


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for g in _groups(batches, 2):
            roles = [role_of(r[3]) for r in g]
            back, _ = walk(roles, np.array(g[0][5], dtype=np.int64))
            states = trace(back, g[0][6])
            begun = states[0] != START
            done = [(i, role, kind, None if i is None else g[i][2], "" if i is None else g[i][4] or "") for i, role, kind in moves(roles, states)]
            if g[0][7]:
                done += [(None, s, "insert", None, "") for s in _CLOSING[states[-1]]]
            for place, (_, role, kind, turn, text) in enumerate(done):
                shown = render(kind, role, text, not begun)
                begun = True
                if g[0][7] and place == len(done) - 1:
                    shown += "<|im_end|>\n"
                yield g[0][0], g[0][1], place, turn, ROLES[role], kind, shown

    yield from _batches(rows(), _OUT, 500)


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations, one row per turn: conv_id, block, place, turn, role, action, rendered.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns go by turn number, then
    role and text; a null turn comes first, a null text is empty, an unknown or null role may become any.
    Repeated rows are turns of their own. Rows without a conv_id are one conversation. Every input turn
    gives one row (action keep, relabel, merge or relabel_merge), every inserted empty turn one more
    (turn null, action insert). Texts are escaped() so that none can forge a turn. The concatenation of `rendered` by (block, place) is the conversation.
    Rows with the same turn number in a conversation must fit into a task's memory together.
    """
    rows = conversations.select("conv_id", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long").alias("block"), "turn", "role", "text")
    order = ["conv_id", "block", "turn", "role", "text"]

    def sorted_by_block(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "block").sortWithinPartitions(*order)

    matrices = sorted_by_block(rows.select("conv_id", "block", "turn", "role", F.lit(None).cast("string").alias("text"))).mapInArrow(_matrix_rows, "conv_id long, block long, m array<long>")
    costs = save(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_cost_rows, "conv_id long, block long, costs array<long>, last int"), "chat-costs")
    at = costs.withColumnsRenamed({"conv_id": "c", "block": "b"})
    same = lambda x: rows.conv_id.eqNullSafe(x["c"]) & (rows.block == x["b"])
    joined = rows.drop("text").join(at, same(at)).select("conv_id", "block", "turn", "role", F.lit(None).cast("string").alias("text"), "costs", "last")
    entries = sorted_by_block(joined).mapInArrow(_entry_rows, "conv_id long, block long, entries array<int>, last int")
    exits = save(entries.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_exit_rows, "c long, b long, exit int, is_last boolean"), "chat-exits")
    known = at.select("c", "b", "costs").withColumnsRenamed({"c": "c0", "b": "b0"}).join(exits, F.col("c0").eqNullSafe(F.col("c")) & (F.col("b0") == F.col("b"))).drop("c0", "b0")
    whole = rows.join(known, same(known)).select(*order, "costs", "exit", "is_last")
    return sorted_by_block(whole).mapInArrow(_repaired_rows, "conv_id long, block long, place long, turn long, role string, action string, rendered string")


def brute_force(turns: list[tuple[str | None, str | None]]) -> tuple[int, str]:
    """Least cost and rendering of one conversation in one pass, for tests."""
    roles = [role_of(r) for r, _ in turns]
    back, costs = walk(roles, _FIRST)
    states = trace(back, int((costs + _LAST).argmin()))
    done = [(role, kind, "" if i is None else turns[i][1] or "") for i, role, kind in moves(roles, states)]
    done += [(s, "insert", "") for s in _CLOSING[states[-1]]]
    text = "".join(render(kind, role, text, k == 0) for k, (role, kind, text) in enumerate(done))
    return int((costs + _LAST).min()), text + ("<|im_end|>\n" if done else "")
