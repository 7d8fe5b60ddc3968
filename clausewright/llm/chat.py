"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal conversation is an optional system turn followed by user and assistant turns in alternation that ends with
the assistant. Walking a conversation, the automaton is in one of four states (START, SYSTEM, USER, ASSISTANT: the
role of the last message). A turn may be kept, relabelled, merged into the last message, or preceded by an empty
inserted message; the end may need one too. Costs are in COST, and the cheapest walk is found by dynamic
programming over the states.

One turn is a 4 x 4 matrix in the (min, +) algebra and matrices compose, so a conversation of any length is
solved in parts: rows are sorted over all partitions by conversation and turn (one conversation may take many), each
task sends the composed matrix of the first and last conversation it holds (two small rows a task), the driver walks
those, and each task then solves its part between known end states. The result is a row for each rendered piece, in
order of `place`; the pieces of a conversation joined are its rendered text, so no task holds a whole conversation.

Defined cases: a role that is null or unknown has to be relabelled (at a lower cost); a null text is empty; rows
without conversation id form one conversation; null turns come first; ties of a turn are ordered by role and
text, and repeated rows are turns of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
COST = {"merge": 1, "insert": 2, "relabel": 3, "unknown": 1}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
INF = 1 << 40

SCHEMA = "conv_id bigint, place bigint, turn bigint, role string, new_role string, action string, piece string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Which message may directly follow which; otherwise one empty message between them, or None.
_NEXT = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
_END = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _moves(role: int) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(from, to, cost, merged, inserted) for a turn of `role` (0 unknown), cheapest first for each pair of states."""
    best: dict[tuple[int, int], tuple[int, int, int, bool, tuple[int, ...]]] = {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if b == role else COST["relabel"] if role else COST["unknown"]
            options = []
            if (a, b) in _NEXT:
                options.append((a, b, relabel + COST["insert"] * len(_NEXT[a, b]), False, _NEXT[a, b]))
            if a == b:
                options.append((a, b, relabel + COST["merge"], True, ()))
            for o in options:
                if (a, b) not in best or o[2] < best[a, b][2]:
                    best[a, b] = o
    return list(best.values())


MOVES = [_moves(r) for r in range(4)]


def role_of(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) + 1 if r in ROLES else 0


def end_cost(state: int) -> int:
    return INF if state == START else COST["insert"] * len(_END[state])


def compose(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each over a run of turns."""
    rows = []
    for s in range(4):
        cost = [INF] * 4
        cost[s] = 0
        for r in roles:
            cost = _advance(cost, r)[0]
        rows.append(cost)
    return rows


def _advance(cost: list[int], role: int) -> tuple[list[int], list]:
    new, how = [INF] * 4, [None] * 4
    for m in MOVES[role]:
        c = cost[m[0]] + m[2]
        if c < new[m[1]]:
            new[m[1]], how[m[1]] = c, m
    return new, how


def solve(roles: list[int], first: int = START, last: int | None = None) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """The moves of a cheapest walk from state `first` to `last` (None: to the best end)."""
    cost = [INF] * 4
    cost[first] = 0
    trail = []
    for r in roles:
        cost, how = _advance(cost, r)
        trail.append(how)
    state = min(range(4), key=lambda s: cost[s] + end_cost(s)) if last is None else last
    out = []
    for how in reversed(trail):
        out.append(how[state])
        state = how[state][0]
    return out[::-1]


def chain_states(parts: list[list[list[int]]]) -> list[int]:
    """End state of each part of one conversation, from the parts' matrices."""
    forward = [[0, INF, INF, INF]]
    for m in parts:
        forward.append([min(forward[-1][a] + m[a][b] for a in range(4)) for b in range(4)])
    ends = [min(range(4), key=lambda s: forward[-1][s] + end_cost(s))]
    for k in range(len(parts) - 1, 0, -1):
        ends.append(min(range(4), key=lambda a: forward[k][a] + parts[k][a][ends[-1]]))
    return ends[::-1]


def _message(role: int, text: str, opened: bool) -> str:
    return (CLOSE if opened else "") + OPEN.format(ROLES[role - 1]) + text


def render(turns: list[tuple], first: int, last: int | None, final: bool) -> Iterator[tuple]:
    """(turn, role, new role, action, piece) of a part whose turns are (turn, role, text); `final` if the conversation ends here."""
    moves = solve([role_of(t[1]) for t in turns], first, last)
    state = first
    for (turn, role, text), (_, to, _, merged, inserted) in zip(turns, moves, strict=True):
        for r in inserted:
            yield None, None, ROLES[r - 1], "insert", _message(r, "", state != START)
            state = r
        action = "+".join((["merge"] if merged else []) + (["relabel"] if role_of(role) != to else [])) or "keep"
        yield turn, role, ROLES[to - 1], action, JOIN + (text or "") if merged else _message(to, text or "", state != START)
        state = to
    if final:
        for r in _END[state]:
            yield None, None, ROLES[r - 1], "insert", _message(r, "", True)
        yield None, None, None, "end", CLOSE


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition with their matrices."""
    edges: list[tuple] = []
    for conv, rows in groupby(_turns(batches), key=lambda r: r[0]):
        matrix = None
        for _, part in groupby(enumerate(rows), key=lambda r: r[0] // 4096):  # the rows of a part at a time
            m = compose([role_of(r[2]) for _, r in part])
            matrix = m if matrix is None else [[min(matrix[a][k] + m[k][b] for k in range(4)) for b in range(4)] for a in range(4)]
        edges = [*edges[:1], (conv, sum(matrix, []))]
    if edges:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(edges), pa.int32()), pa.array(range(len(edges)), pa.int32()), pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.list_(pa.int64()))],
            names=["part", "edge", "conv_id", "matrix"],
        )


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered pieces of all conversations; see the module's text."""
    rows = df.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text", "row"]  # the row's number splits even equal rows over partitions
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row"))
    edges = sorted(rows.mapInArrow(_summary, "part int, edge int, conv_id bigint, matrix array<bigint>").collect(), key=lambda r: (r.part, r.edge))
    known: dict[tuple[int, int], tuple[int, int | None, bool]] = {}  # of part and edge: states before and after, and whether it ends there
    for _, run in groupby(edges, key=lambda r: (r.conv_id is None, r.conv_id)):
        run = list(run)
        states = chain_states([[r.matrix[4 * a : 4 * a + 4] for a in range(4)] for r in run])
        for k, r in enumerate(run):
            known[r.part, r.edge] = (states[k - 1] if k else START, states[k], k == len(run) - 1)

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place, out = part << 33, []
        last_known = known.get((part, 1))
        groups = groupby(_turns(batches), key=lambda r: r[0])
        held = next(groups, None)
        number = 0
        while held is not None:
            conv, turns = held[0], [r[1:] for r in held[1]]
            held = next(groups, None)
            how = known[part, 0] if number == 0 else last_known if held is None else None
            number += 1
            first, last, final = how or (START, None, True)
            for piece in render(turns, first, last, final):
                out.append((conv, place, *piece))
                place += 1
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(rendered, SCHEMA)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES)
