"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system message, then user and assistant in turn, ending
with the assistant.  Each turn is kept, merged into the message before it, relabelled, or
preceded by empty messages; dynamic programming over the automaton of the last role finds
the cheapest way through.

A conversation may be of any length and its turn numbers may repeat or lack: rows are sorted
over all tasks, each task cuts its run of a conversation into segments of a bounded number of
rows and bytes, each segment is reduced to a matrix of costs between the automaton's states.
The product of a run's matrices stands for the run, the runs of a conversation fix the state
at their borders, these fix the states at the borders of segments, and segments are then
repaired apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelake.llm.tables import stored
from trovelake.runtime import unnest

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Bounds of a segment: rows, and bytes of text (or one row alone).
SEGMENT = 256
SEGMENT_BYTES = 1 << 22
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    insert: int = 3


@dataclass(frozen=True)
class Step:
    before: int
    after: int
    cost: int
    action: str
    inserted: tuple[int, ...] = ()


def _path(state: int, role: int) -> tuple[int, ...] | None:
    """Fewest empty messages after ``state`` that make ``role`` legal."""
    if role in NEXT[state]:
        return ()
    if role == SYSTEM:
        return None
    reached = {state: ()}
    for _ in range(3):
        for s, path in list(reached.items()):
            for t in NEXT[s]:
                if t != SYSTEM:
                    reached.setdefault(t, (*path, t))
        for s, path in reached.items():
            if role in NEXT[s]:
                return path
    return None


def steps(role: int, costs: Costs) -> list[Step]:
    """What a turn of ``role`` (0: none of the known) may do in each state, preferred ones first."""
    out = []
    for state in range(4):
        if role in NEXT[state]:
            out.append(Step(state, role, 0, "keep"))
        if state != START:
            same = state == role
            out.append(Step(state, state, costs.merge + (0 if same else costs.relabel), "merge"))
        out += [Step(state, r, costs.relabel, "relabel") for r in NEXT[state] if r != role]
        if role and (path := _path(state, role)):
            out.append(Step(state, role, costs.insert * len(path), "insert", path))
    return sorted(out, key=lambda s: s.cost)


def closing(state: int) -> tuple[int, ...]:
    """Empty messages that end a conversation legally."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


class Automaton:
    def __init__(self, costs: Costs):
        self.costs = costs
        self.steps = [steps(role, costs) for role in range(4)]
        self.matrix = np.full((4, 4, 4), _FAR, np.int64)
        for role in range(4):
            for s in self.steps[role]:
                self.matrix[role, s.before, s.after] = min(self.matrix[role, s.before, s.after], s.cost)
        self.end = np.array([costs.insert * len(closing(s)) for s in range(4)])

    def product(self, roles: list[int]) -> np.ndarray:
        total = np.where(np.eye(4, dtype=bool), 0, _FAR)
        for role in roles:
            total = np.minimum((total[:, :, None] + self.matrix[role][None]).min(axis=1), _FAR)
        return total

    def joined(self, matrices: list[np.ndarray]) -> np.ndarray:
        """The costs through all segments in turn."""
        total = matrices[0]
        for m in matrices[1:]:
            total = np.minimum((total[:, :, None] + m[None]).min(axis=1), _FAR)
        return total

    def borders(self, matrices: list[np.ndarray], first: int = START, last: int | None = None) -> list[int]:
        """The state at each border of the cheapest way from ``first`` to ``last`` (None: to a legal end)."""
        if len(matrices) == 1 and last is not None:
            return [first, last]
        ahead = [self.end if last is None else np.where(np.arange(4) == last, 0, _FAR)]
        for m in reversed(matrices):
            ahead.append(np.minimum((m + ahead[-1][None, :]).min(axis=1), _FAR))
        ahead.reverse()
        states = [first]
        for m, rest in zip(matrices, ahead[1:], strict=True):
            states.append(int((m[states[-1]] + rest).argmin()))
        return states

    def repair(self, roles: list[int], first: int, last: int) -> list[Step]:
        """The cheapest steps from state ``first`` to state ``last``."""
        cost = np.full(4, _FAR)
        cost[first] = 0
        back = []
        for role in roles:
            new, choice = [_FAR] * 4, [None] * 4
            for s in self.steps[role]:
                if cost[s.before] + s.cost < new[s.after]:
                    new[s.after], choice[s.after] = cost[s.before] + s.cost, s
            cost = new
            back.append(choice)
        out, state = [], last
        for choice in reversed(back):
            out.append(choice[state])
            state = choice[state].before
        return out[::-1]


def repair_roles(conversations: DataFrame, *, costs: Costs = Costs(), segment: int = SEGMENT) -> DataFrame:
    """A row per turn: conv_id, position, turn, role, action, new_role, inserted, cost, rendered.

    Turns of a conversation are ordered by (turn with nulls first, role, text); a null
    conv_id is a conversation too.  Roles count without case and surrounding space; others
    and null have no role and are relabelled or merged.  Null text is empty.  ``inserted``
    names the empty messages before the turn, and those after the last.  ``rendered`` pieces
    joined in the order of ``position`` give the formatted conversation; ``cost`` summed is
    the least possible.  Repeated rows are turns of their own; an empty table gives no rows.
    Other columns are not read.
    """
    automaton = Automaton(costs)
    name = F.lower(F.trim("role"))
    code = F.when(name == "system", SYSTEM).when(name == "user", USER).when(name == "assistant", ASSISTANT).otherwise(0)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"), code.alias("code"),
    ).withColumns({"size": F.octet_length("text"), "row": F.monotonically_increasing_id()})

    # A fixed number: rows without texts are small, but repairing them isn't.
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # The row number deals equal rows to several tasks. Cut once and stored: bounds of ranges are sampled.
    order = ["conv_id", "turn", "role", "text", "row"]
    cut = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    rows = stored(cut.mapInArrow(
        _segments(segment, SEGMENT_BYTES),
        f"conv_id {kind}, turn long, role string, text string, code int, part int, run long, segment long, at int"))

    @F.pandas_udf("array<long>")
    def product(codes: pd.Series) -> pd.Series:
        return pd.Series([automaton.product(list(one)).ravel() for one in codes])

    @F.pandas_udf("array<long>")
    def joined(all_: pd.Series) -> pd.Series:
        return pd.Series([automaton.joined(_matrices(one)).ravel() for one in all_])

    @F.pandas_udf("array<array<long>>")
    def by_run(all_: pd.Series) -> pd.Series:
        return pd.Series([_places(one, ("part", "run"), automaton.borders(_matrices(one)), 0, 1) for one in all_])

    @F.pandas_udf("array<array<long>>")
    def by_segment(all_: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([
            _places(one, ("part", "segment"), automaton.borders(_matrices(one), first, last), before, ends)
            for one, (_, _, first, last, before, ends) in zip(all_, place, strict=True)])

    codes = F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    segments = rows.groupBy("part", "segment").agg(
        F.first("conv_id").alias("conv_id"), F.first("run").alias("run"), codes.alias("codes"))
    reduced = F.struct("part", "segment", F.size("codes").alias("n"), product("codes").alias("costs"))
    runs = segments.select("conv_id", "part", "run", reduced.alias("one")).groupBy("part", "run").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("one")).alias("all"))
    runs = stored(runs.withColumn("costs", joined("all")))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda n, one: n + one["n"])
    whole = runs.select("conv_id", F.struct("part", "run", total.alias("n"), "costs").alias("one")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("all"))
    place = unnest(whole, by_run("all"), "place", keep=()).select(
        F.col("place")[0].alias("part"), F.col("place")[1].alias("run"), "place")
    states = unnest(runs.join(place, ["part", "run"]), by_segment("all", "place"), "state", keep=()).select(
        F.col("state")[0].cast("int").alias("part"), F.col("state")[1].alias("segment"), F.lit(-1).alias("at"), "state")

    def render(turns: list[tuple], state: list[int]) -> Iterator[tuple]:
        _, _, first, last, before, ends = state
        found = automaton.repair([t[3] for t in turns], first, last)
        for at, (step, (conv, turn, role, _, text)) in enumerate(zip(found, turns, strict=True)):
            piece = f"\n{text}" if step.action == "merge" else _open(step.before, (*step.inserted, step.after)) + text
            inserted, paid = [ROLES[r] for r in step.inserted], step.cost
            if ends and at == len(turns) - 1:
                rest = closing(step.after)
                piece += _open(step.after, rest) + _CLOSE
                inserted, paid = inserted + [ROLES[r] for r in rest], paid + costs.insert * len(rest)
            yield conv, before + at, turn, role, step.action, ROLES[step.after], inserted, paid, piece

    # A segment's states come before its turns: the texts cross one shuffle without a join.
    both = rows.drop("run").unionByName(states, allowMissingColumns=True)
    return both.repartition(parts, "part", "segment").sortWithinPartitions("part", "segment", "at").mapInArrow(
        _by_segment(render),
        f"conv_id {kind}, position long, turn long, role string, action string, new_role string, "
        "inserted array<string>, cost long, rendered string")


_CLOSE = "<|im_end|>\n"


def _open(before: int, roles: tuple[int, ...]) -> str:
    """Close the open message, if any, and open the given ones; all but the last are empty."""
    out = "" if before == START or not roles else _CLOSE
    return out + _CLOSE.join(f"<|im_start|>{ROLES[r]}\n" for r in roles)


def _matrices(parts: list) -> list[np.ndarray]:
    return [np.array(p["costs"]).reshape(4, 4) for p in parts]


def _places(parts: list, key: tuple[str, str], states: list[int], before: int, ends: int) -> list[list[int]]:
    """Of each part its key, the states at its borders, the rows before it and whether it ends the conversation."""
    out = []
    for i, p in enumerate(parts):
        out.append([p[key[0]], p[key[1]], states[i], states[i + 1], before, int(ends and i == len(parts) - 1)])
        before += p["n"]
    return out


def _segments(most: int, most_bytes: int):
    """Number the runs and segments of a sorted partition and the rows of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, segment, at, held, last = TaskContext.get().partitionId(), -1, -1, 0, 0, None
        for batch in batches:
            places = []
            for conv, size in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                at, held = at + 1, held + size
                if run < 0 or conv != last:
                    run, segment, at, held, last = run + 1, segment + 1, 0, size, conv
                elif at == most or held > most_bytes:
                    segment, at, held = segment + 1, 0, size
                places.append((run, segment, at))
            runs, segments, ats = zip(*places, strict=True) if places else ((), (), ())
            kept = ["conv_id", "turn", "role", "text", "code"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array([part] * len(ats), pa.int32()),
                 pa.array(runs, pa.int64()), pa.array(segments, pa.int64()), pa.array(ats, pa.int32())],
                names=[*kept, "part", "run", "segment", "at"])

    return run


def _by_segment(work: Callable[[list[tuple], list[int]], Iterator[tuple]]):
    """Apply ``work`` to the turns of each segment of a sorted partition and to its state, which leads them."""
    names = ["conv_id", "position", "turn", "role", "action", "new_role", "inserted", "cost", "rendered"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        state, size, kind = None, 0, None

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            turns = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "code", "text")), strict=True)
            for turn, own in zip(turns, batch.column("state").to_pylist(), strict=True):
                if own is None:
                    held.append(turn)
                    size += len(turn[-1])
                    continue
                if held:
                    done += work(held, state)
                held, state = [], own
                if size > _OUT_CHARS or len(done) > _OUT_ROWS:
                    yield out()
                    done, size = [], 0
        if held:
            done += work(held, state)
        if done:
            yield out()

    return run


#: A batch of results is sent on from so many characters or rows.
_OUT_CHARS = 1 << 22
_OUT_ROWS = 8192
