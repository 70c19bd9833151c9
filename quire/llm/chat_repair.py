"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant turns that alternate,
and ends with the assistant. Each turn may be kept, relabelled, merged into the turn before it or
preceded by an empty turn; empty turns may follow the last. Dynamic programming over the automaton's
states finds the cheapest choice for the whole conversation; of equally cheap ones, the trace back
takes the smallest state before each turn.

Turns are sorted by range. A conversation that begins and ends inside a partition, and has at most
LONGEST turns, is repaired and rendered where it lies, all conversations of a batch at once in numpy.
What may go on in the next partition, or is longer (a conversation may hold a third of all turns), is
never one task's work: its turns are cut into blocks of at most BLOCK turns, and each block becomes a
4 x 4 cost matrix. Matrices are chained (one row for each block, not for each turn) to get the costs at
a block's entry, then the state at its exit; the result doesn't depend on where blocks were cut.

Defined results: every turn gives one row, its piece of the rendered text; a conversation's pieces
in order of position, joined, are the whole. A null or unknown role must be relabelled; a null text
is empty; turns with equal numbers are ordered by role, then text; repeated rows are turns each;
conversations' ids may be of any type; turns without one are one conversation; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
BLOCK = 4096
#: Turns of a conversation that one task repairs by itself.
LONGEST = 4096

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def options(state: int, role: str | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, action, empty turns before) of one turn, the cheapest for each next state."""
    best: dict[int, tuple[int, int, str, tuple[int, ...]]] = {}
    for new in (SYSTEM, USER, ASSISTANT):
        same = role == ROLES[new - 1]
        base, name = (0, "keep") if same else (RELABEL, "relabel")
        found = []
        if new in NEXT[state]:
            found.append((base, new, name, ()))
        if new == state:
            found.append((base + MERGE, new, "merge" if same else "relabel+merge", ()))
        found += [(base + INSERT, new, f"insert+{name}", (mid,)) for mid in NEXT[state] if new in NEXT[mid]]
        for o in found:
            if new not in best or o[0] < best[new][0]:
                best[new] = o
    return [best[k] for k in sorted(best)]


STEPS = {role: [options(s, role) for s in range(4)] for role in (*ROLES, None)}


def _known(role: object) -> str | None:
    return role if role in ROLES else None


def ending(state: int) -> list[int]:
    """The empty turns that make an end legal."""
    return {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]


def matrix(roles: list) -> list[int]:
    """Costs from each state before the turns to each after them, row by row."""
    out = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in map(_known, roles):
        step = STEPS[role]
        after = [[FAR] * 4 for _ in range(4)]
        for a in range(4):
            for s in range(4):
                if out[a][s] < FAR:
                    for cost, new, _, _ in step[s]:
                        after[a][new] = min(after[a][new], out[a][s] + cost)
        out = after
    return [x for row in out for x in row]


def forward(entry: list[int], roles: list) -> list[list[int]]:
    """Least costs by state before each turn and after the last."""
    costs = [entry]
    for role in map(_known, roles):
        after = [FAR] * 4
        for s in range(4):
            if costs[-1][s] < FAR:
                for cost, new, _, _ in STEPS[role][s]:
                    after[new] = min(after[new], costs[-1][s] + cost)
        costs.append(after)
    return costs


def trace(costs: list[list[int]], roles: list, exit_state: int) -> list[int]:
    """States before each turn and after the last, from the end backwards."""
    states = [exit_state]
    for at in range(len(roles) - 1, -1, -1):
        step, want = STEPS[_known(roles[at])], costs[at + 1][states[-1]]
        states.append(next(s for s in range(4) for cost, new, _, _ in step[s] if new == states[-1] and costs[at][s] + cost == want))
    return states[::-1]


def last_state(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(ending(s)), s))


def repair(roles: list, entry: list[int], exit_state: int) -> list[tuple[int, str, tuple[int, ...], int, int]]:
    """(state before, action, empty turns before, state after, cost) of each turn."""
    states = trace(forward(entry, roles), roles, exit_state)
    out = []
    for role, a, b in zip(roles, states, states[1:], strict=False):
        cost, _, action, before = next(o for o in STEPS[_known(role)][a] if o[1] == b)
        out.append((a, action, before, b, cost))
    return out


ENTRY0 = [0, FAR, FAR, FAR]


def _opened(state: int) -> str:
    return OPEN.format(ROLES[state - 1])


def written(a: int, action: str, before: tuple[int, ...], b: int) -> tuple[str, int]:
    """What stands before a turn's text, and how many turns it opens."""
    if "merge" in action:
        return "\n", 0
    return (CLOSE if a != START else "") + "".join(_opened(e) + CLOSE for e in before) + _opened(b), 1 + len(before)


def closing(b: int) -> tuple[str, int]:
    """What stands after a conversation's last text, and how many turns it opens."""
    return CLOSE + "".join(_opened(e) + CLOSE for e in ending(b)), len(ending(b))


def _tables() -> dict[str, np.ndarray]:
    """Costs, actions, opened turns and text before, by role (the last is unknown), state before and after."""
    shape = (len(ROLES) + 1, 4, 4)
    out = {"cost": np.full(shape, FAR), "opens": np.zeros(shape, np.int64), "action": np.full(shape, "", object), "before": np.full(shape, "", object)}
    for k, role in enumerate((*ROLES, None)):
        for s in range(4):
            for cost, new, action, mid in STEPS[role][s]:
                text, opens = written(s, action, mid, new)
                out["cost"][k, s, new], out["opens"][k, s, new], out["action"][k, s, new], out["before"][k, s, new] = cost, opens, action, text
    return out


TABLES = _tables()
_END_COST = np.array([INSERT * len(ending(s)) for s in range(4)])
_CODES = {role: k for k, role in enumerate(ROLES)}


def walk(roles: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each turn of many conversations, given as runs of coded roles: the same
    as repair() from ENTRY0 to last_state(), one turn of all conversations at a time."""
    cost = TABLES["cost"]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    live = [int(np.searchsorted(-sizes, -k, side="left")) for k in range(int(sizes[0]) if len(sizes) else 0)]  # conversations of more than k turns
    held = np.full((len(roles), 4), FAR)  # costs before each turn
    now = np.tile(np.array(ENTRY0), (len(sizes), 1))
    for k, m in enumerate(live):
        at = starts[:m] + k
        held[at] = now[:m]
        now[:m] = np.minimum((now[:m, :, None] + cost[roles[at]]).min(axis=1), FAR)
    state = (now + _END_COST).argmin(axis=1)
    before, after = np.zeros(len(roles), np.int64), np.zeros(len(roles), np.int64)
    reached = now[np.arange(len(sizes)), state]
    for k in range(len(live) - 1, -1, -1):
        m = live[k]
        at = starts[:m] + k
        after[at] = state[:m]
        fits = held[at] + cost[roles[at], :, state[:m]] == reached[:m, None]
        state[:m] = (fits & (held[at] < FAR)).argmax(axis=1)
        reached[:m] = held[at, state[:m]]
        before[at] = state[:m]
    return before, after


def _results(conv: str) -> str:
    return f"conv_id {conv}, turn long, position long, role string, new_role string, action string, cost long, opens long, piece string"


def _whole(t: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Rows of whole conversations with their repair; t has conv_id, turn, position, role, text."""
    given = t.column(3).to_pylist()
    roles = np.array([_CODES.get(r, len(ROLES)) for r in given], np.int64)
    before, after = walk(roles, starts, sizes)
    at = (roles, before, after)
    cost, opens = TABLES["cost"][at], TABLES["opens"][at]
    piece = [p + (x or "") for p, x in zip(TABLES["before"][at], t.column(4).to_pylist(), strict=True)]
    for end in starts + sizes - 1:
        text, more = closing(int(after[end]))
        piece[end] += text
        opens[end] += more
        cost[end] += INSERT * more
    new = np.array(ROLES, object)[after - 1]
    columns = [t.column(0), t.column(1), t.column(2), t.column(3), pa.array(new, pa.string()), pa.array(TABLES["action"][at], pa.string()), pa.array(cost, pa.int64()), pa.array(opens, pa.int64()), pa.array(piece, pa.string())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = ["conv_id", "turn", "position", "role", "new_role", "action", "cost", "opens", "piece"]


def _unsettled(t: pa.RecordBatch) -> pa.RecordBatch:
    """Rows as they are, the text as piece and no repair."""
    none = [pa.nulls(t.num_rows, k) for k in (pa.string(), pa.string(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*(t.column(i) for i in range(4)), *none, t.column(4).cast(pa.string())], _NAMES)


def _in_partition(longest: int):
    """Repairs the conversations that lie inside a sorted partition; the first and the last, and longer
    ones, are given back as they are."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the conversation that the rows so far end with
        conv, first, size, long = None, True, 0, False  # its id, whether it's the partition's first, and its turns
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
            if (held or long) and b.column(0)[0].as_py() == conv:  # goes on
                held.append(b.slice(0, int(edges[1])))
                size += int(edges[1])
                edges = edges[1:]
            if len(edges) > 1:
                if held:
                    yield from _close(held, first or long)
                    first = False
                elif long:
                    first = False
                held, long = [], False
                a, z = int(edges[0]), int(edges[-2])  # whole conversations, then one that may go on
                if first and a < z:  # the partition's first conversation
                    yield _unsettled(b.slice(a, int(edges[1]) - a))
                    first, edges = False, edges[1:]
                    a = int(edges[0])
                sizes = np.diff(edges[:-1])
                for some, take in _runs_of(edges[:-1], sizes, longest):
                    rows = b.slice(int(some[0]), int(take.sum()))
                    yield _whole(rows, some - some[0], take) if take[0] <= longest else _unsettled(rows)
                held, size, conv = [b.slice(z)], b.num_rows - z, b.column(0)[z].as_py()
            if size > longest or first:  # isn't settled here, so nothing need be kept
                yield from map(_unsettled, held)
                held, long = [], True
        yield from map(_unsettled, held)

    return part


def _runs_of(starts: np.ndarray, sizes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Conversations that follow each other, those that are too long alone."""
    a = 0
    for k in [*np.flatnonzero(sizes > longest), len(sizes)]:
        if k > a:
            yield starts[a:k], sizes[a:k]
        if k < len(sizes):
            yield starts[k : k + 1], sizes[k : k + 1]
        a = k + 1


def _close(held: list[pa.RecordBatch], unsettled: bool) -> Iterator[pa.RecordBatch]:
    if unsettled:
        yield from map(_unsettled, held)
        return
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    yield _whole(t, np.array([0]), np.array([t.num_rows]))


KEYS = ["conv_id", "part", "block"]


def _runs(pdf: pd.DataFrame, *columns: str):
    """(conv_id, part, block) and the columns' values of each conversation in a block, in order."""
    pdf = pdf.sort_values("seq")
    held = {c: pdf[c].tolist() for c in (*KEYS, *columns)}
    convs, many = [c if isinstance(c, str) else None for c in held["conv_id"]], len(pdf)
    a = 0
    for b in range(1, many + 1):
        if b == many or convs[b] != convs[a]:
            yield (convs[a], held["part"][a], held["block"][a]), *(held[c][a:b] for c in columns)
            a = b


def _matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(*key, matrix(roles)) for key, roles in _runs(pdf, "role")]
    return pd.DataFrame(rows, columns=[*KEYS, "m"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs at the entry of each block of a conversation, and the state at the end of the last."""
    pdf = pdf.sort_values(["part", "block"]).reset_index(drop=True)
    entry, entries = ENTRY0, []
    for m in pdf["m"]:
        entries.append(entry)
        entry = [min(FAR, *(entry[a] + m[4 * a + b] for a in range(4))) for b in range(4)]
    pdf["entry"] = entries
    pdf["final"] = last_state(entry)
    pdf["is_last"] = [i == len(pdf) - 1 for i in range(len(pdf))]
    return pdf[[*KEYS, "entry", "final", "is_last"]]


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a conversation, the state before it for each state after it."""
    rows = []
    for key, roles, entry, final in _runs(pdf, "role", "entry", "final"):
        costs = forward([int(c) for c in entry[0]], roles)
        rows.append((*key, [trace(costs, roles, s)[0] if costs[-1][s] < FAR else -1 for s in range(4)], int(final[0])))
    return pd.DataFrame(rows, columns=[*KEYS, "back", "final"])


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the exit of each block of a conversation."""
    pdf = pdf.sort_values(["part", "block"], ascending=False).reset_index(drop=True)
    state, out = int(pdf["final"].iloc[0]), []
    for back in pdf["back"]:
        out.append(state)
        state = int(back[state])
    pdf["exit"] = out
    return pdf[[*KEYS, "exit"]]


def _render(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for (conv, _, _), turns, positions, roles, texts, entry, exits, lasts in _runs(pdf, "turn", "position", "role", "piece", "entry", "exit", "is_last"):
        many, closed = len(roles), bool(lasts[0])
        steps = repair(roles, [int(c) for c in entry[0]], int(exits[0]))
        for k, (turn, position, role, text, (a, action, before, b, cost)) in enumerate(zip(turns, positions, roles, texts, steps, strict=True)):
            head, opens = written(a, action, before, b)
            piece = head + (text if isinstance(text, str) else "")
            if closed and k == many - 1:
                tail, more = closing(b)
                piece, opens, cost = piece + tail, opens + more, cost + INSERT * more
            rows.append((conv, turn, position, role, ROLES[b - 1], action, cost, opens, piece))
    return pd.DataFrame(rows, columns=_NAMES)


def _by_blocks(t: DataFrame, block: int, conv: str) -> DataFrame:
    """Conversations of many blocks; t has conv_id, turn, position, role and the text as piece."""
    low = (1 << 33) - 1
    seq = F.col("position").bitwiseAND(F.lit(low))
    t = t.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "position", "role", "piece")
    t = cut(t.select("*", F.shiftright("position", 33).cast("int").alias("part"), F.expr(f"cast(({low} & position) div {block} as int)").alias("block"), seq.alias("seq")), "turns")
    bare = t.select("conv_id", "part", "block", "seq", "role")
    m = bare.groupBy("part", "block").applyInPandas(_matrices, "conv_id string, part int, block int, m array<long>")
    ends = cut(m.groupBy("conv_id").applyInPandas(_chain, "conv_id string, part int, block int, entry array<long>, final int, is_last boolean"), "chat-entries")

    def with_block(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of one block and conversation get the columns of its summary."""
        r = right.select(*[F.col(c).alias(f"_{c}") if c in KEYS else F.col(c) for c in right.columns])
        same = left["conv_id"].eqNullSafe(r["_conv_id"]) & (left["part"] == r["_part"]) & (left["block"] == r["_block"])
        return left.join(r, same).drop("_conv_id", "_part", "_block")

    back = with_block(bare, ends).groupBy("part", "block").applyInPandas(_exits, "conv_id string, part int, block int, back array<int>, final int")
    exits = back.groupBy("conv_id").applyInPandas(_settle, "conv_id string, part int, block int, exit int")
    known = cut(with_block(ends, exits), "chat-exits")
    made = with_block(t, known).groupBy("part", "block").applyInPandas(_render, _results("string").replace("turn long", "turn string"))
    return made.withColumn("conv_id", F.col("conv_id").cast(conv)).withColumn("turn", F.col("turn").cast("long"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, longest: int = LONGEST) -> DataFrame:
    """A row for each turn with its repaired role, action, cost, turns opened and rendered piece."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conv, order = t.schema["conv_id"].dataType.simpleString(), ["conv_id", "turn", "role", "text"]
    many = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())
    done = cut(t.select("conv_id", "turn", "position", "role", "text").mapInArrow(_in_partition(longest), _results(conv)), "chats")
    rest = done.where("action is null").select("conv_id", "turn", "position", "role", "piece")
    return done.where("action is not null").unionByName(_by_blocks(rest, block, conv))
