"""Chat formatting: the cheapest repair of role sequences to legal ones, and their rendering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.tables import placed_by, small
from corrobora.session import cut_lineage

ROLES = ("system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: States of the automaton of legal turns: nothing yet, or the role of the last turn. Legal: an optional system turn, then
#: user and assistant in turns, ending with the assistant.
START, STATES = 0, 4
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


@dataclass(frozen=True)
class Costs:
    """What a repair costs: another label, joining a turn to the one before it, an empty turn put in."""

    relabel: float = 1.0
    merge: float = 0.4
    insert: float = 0.7


def _step(costs: Costs, role: str, state: int, target: int) -> tuple[float, str, tuple[int, ...]]:
    """(cost, kind, inserted states) of taking a turn of ``role`` as ``target`` after ``state``."""
    base = 0.0 if ROLES[target - 1] == role else costs.relabel
    if (state, target) in LEGAL:
        return base, "append", ()
    ways = [(base + costs.merge, "merge", ())] if state == target else []
    ways += [(base + costs.insert, "append", (via,)) for via in (2, 3) if (state, via) in LEGAL and (via, target) in LEGAL]
    return min(ways, key=lambda w: w[0], default=(math.inf, "", ()))


def _closing(state: int) -> tuple[int, ...]:
    """The empty turns that end a legal sequence after ``state``."""
    return {0: (2, 3), 1: (2, 3), 2: (3,), 3: ()}[state]


def cheapest(roles: list[str], entry: int, costs: Costs) -> tuple[list[float], list[int], list[int], list[list[int]]]:
    """Dynamic programming from ``entry``: per last state its cost, turns and inserted turns, and the back pointers.

    Ties go to the smaller previous state, so the same path comes out wherever it is worked out.
    """
    table = {r: [[_step(costs, r, q, t) for t in range(1, STATES)] for q in range(STATES)] for r in {*roles}}
    ways = {
        r: [(q, t + 1, price, len(put) + (kind == "append"), len(put)) for q in range(STATES) for t, (price, kind, put) in enumerate(table[r][q]) if price < math.inf]
        for r in table
    }
    cost, turns, empty = [math.inf] * STATES, [0] * STATES, [0] * STATES
    cost[entry] = 0.0
    back: list[list[int]] = []
    for role in roles:
        new, count, put, came = [math.inf] * STATES, [0] * STATES, [0] * STATES, [-1] * STATES
        for q, t, price, more, inserted in ways[role]:
            if cost[q] + price < new[t] - 1e-12:
                new[t], came[t], count[t], put[t] = cost[q] + price, q, turns[q] + more, empty[q] + inserted
        cost, turns, empty = new, count, put
        back.append(came)
    return cost, turns, empty, back


def best_exit(cost: list[float], costs: Costs) -> int:
    """The last state with the cheapest legal ending; ties go to the smaller state."""
    return min(range(STATES), key=lambda q: (cost[q] + costs.insert * len(_closing(q)), q))


def path(back: list[list[int]], last: int) -> list[int]:
    """The states before the first turn and after each turn."""
    states = [last]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def normal_role(role: str | None) -> str:
    name = (role or "").strip().lower()
    return ALIASES.get(name, name)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one (conversation, partition) at a time, as (conv, pid, ...), from a stream sorted by both."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``most`` rows, so that output is never longer held than input."""
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


MATRIX = pa.schema([
    ("_conv", pa.string()), ("_pid", pa.int32()), ("cost", pa.list_(pa.float64())), ("turns", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int64())),
])


def _matrices(costs: Costs):
    """Per segment: cost, number of turns and number of pieces from every entry state to every exit state."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _segments(batches):
            found = [cheapest([normal_role(r[2]) for r in part], q, costs) for q in range(STATES)]
            yield (*part[0][:2], [c for f in found for c in f[0]], [n for f in found for n in f[1]], [len(part) + n for f in found for n in f[2]])

    return lambda batches: _batches(rows(batches), MATRIX)


def _chained(costs: Costs):
    """Entry and exit state of every segment of a conversation, and the turns and pieces before it: a product of matrices."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("_pid")
        cost, backs = [0.0] + [math.inf] * (STATES - 1), []
        for matrix in parts["cost"]:
            new, came = [math.inf] * STATES, [0] * STATES
            for q in range(STATES):
                for t in range(STATES):
                    if cost[q] + matrix[q * STATES + t] < new[t] - 1e-12:
                        new[t], came[t] = cost[q] + matrix[q * STATES + t], q
            cost = new
            backs.append(came)
        states, rows, before, done = path(backs, best_exit(cost, costs)), [], 0, 0
        for i, (pid, turns, pieces) in enumerate(zip(parts["_pid"], parts["turns"], parts["pieces"], strict=True)):
            rows.append((parts["_conv"].iat[0], pid, states[i], states[i + 1], before, done, i + 1 == len(parts)))
            before += int(turns[states[i] * STATES + states[i + 1]])
            done += int(pieces[states[i] * STATES + states[i + 1]])
        return pd.DataFrame(rows, columns=["_conv", "_pid", "entry", "exit", "before", "done", "is_last"])

    return run


REPAIRED = "conv_id long, out_turn long, turn long, role_in string, role string, action string, rendered string, piece long"
_REPAIRED = pa.schema([
    (name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in REPAIRED.split(", "))
])


def _repair(part: list[tuple], costs: Costs) -> list[list]:
    """The pieces of a segment of (conv, pid, role, turn, text, conv_id, entry, exit, turns before, pieces before, is_last)."""
    conv, entry, last, n, done, ends = part[0][5:11]
    whole = entry is None
    roles = [normal_role(r[2]) for r in part]
    if whole:
        entry, n, done = START, 0, 0
    cost, _, _, back = cheapest(roles, entry, costs)
    states, rows = path(back, best_exit(cost, costs) if whole else last), []

    def put(state: int, turn, role_in, action: str, text: str, n: int) -> None:
        lead = "\n" if action.endswith("merge") else ("<|end|>\n" if n else "") + f"<|{ROLES[state - 1]}|>\n"
        rows.append([conv, n, turn, role_in, ROLES[state - 1], action, lead + text, done + len(rows)])

    for role, row, q, t in zip(roles, part, states, states[1:], strict=False):
        _, kind, inserted = _step(costs, role, q, t)
        for via in inserted:
            put(via, None, None, "insert", "", n)
            n += 1
        action = "+".join((["relabel"] if ROLES[t - 1] != role else []) + (["merge"] if kind == "merge" else [])) or "keep"
        at = n - 1 if kind == "merge" else n
        put(t, row[3], row[2], action, row[4] or "", at)
        n = at + 1
    if whole or ends:
        for via in _closing(states[-1]):
            put(via, None, None, "insert", "", n)
            n += 1
        rows[-1][6] += "<|end|>\n"
    return rows


def _repaired(costs: Costs):
    return lambda batches: _batches((row for part in _segments(batches) for row in _repair(part, costs)), _REPAIRED)


def repair_roles(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest legal form of every conversation of ``turns(conv_id, turn, role, text)``, one row per piece.

    Rows: conv_id, out_turn (from 0), turn (null for an inserted one), role_in, role, action (keep, relabel, merge,
    relabel+merge, insert), rendered, piece (from 0). The rendered pieces in the order of ``piece`` are the whole chat text.

    The cost of a sequence is a product of matrices over (min, +), so a conversation may span partitions: rows are
    range-partitioned on (conversation, turn); every part of a split conversation gives a 4 x 4 matrix, the matrices
    of a conversation are chained, and each part is then repaired on its own between known states. No task holds more of a
    conversation than one partition.

    Edge cases: role names are trimmed, lower-cased and have aliases; null or unknown roles are relabelled; null text
    is empty; rows of equal turn are ordered by content, repeated rows are turns of their own; null conv_ids are one
    conversation, null turns come first; empty input gives no rows; other columns are ignored.
    """
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"),
        F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("_key"),
    )
    order = ["turn", "_key"]
    placed = placed_by(base, ["_conv"], order)
    parts = placed.groupBy("_conv", "_pid").count()
    split = cut_lineage(parts.groupBy("_conv").count().where("count > 1").select("_conv"))  # at most one per partition border
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "_conv", "_pid").sortWithinPartitions("_conv", "_pid", *order)

    first = ["_conv", "_pid", "role"]
    matrices = in_order(placed.join(small(split), "_conv")).select(*first).mapInArrow(
        _matrices(costs), "_conv string, _pid int, cost array<double>, turns array<long>, pieces array<long>"
    )
    bounds = cut_lineage(matrices.groupBy("_conv").applyInPandas(
        _chained(costs), "_conv string, _pid int, entry int, exit int, before long, done long, is_last boolean"
    ))
    known = in_order(placed.join(small(bounds), ["_conv", "_pid"], "left"))
    return known.select(*first, "turn", "text", "conv_id", "entry", "exit", "before", "done", "is_last").mapInArrow(_repaired(costs), REPAIRED)
