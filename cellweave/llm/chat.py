"""Chat formatting with minimum-cost repair of roles.

An automaton says which role may follow which. For every turn a dynamic programme chooses to
keep it, to merge it into the message before, to give it another role, or to put an empty
turn before it; the repaired sequence is rendered turn by turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellweave.llm.common import stored

#: States are the role of the last message; ``START`` is before the first.
START, ROLES = "start", ("system", "user", "assistant")
STATES = (START, *ROLES)
#: Which role may follow which, and other names of the roles.
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
NEVER = float("inf")
#: Turns whose numbers share a thousand are one segment; turns without a number are spread.
SEGMENT, SPREAD, UNNUMBERED = 1024, 4096, 1 << 52


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 3.0
    relabel_unknown: float = 1.0
    insert: float = 2.0


@dataclass(frozen=True)
class Step:
    """What is done with a turn: the role it gets, ``merge`` or not, and the empty turns before."""

    cost: float
    role: str
    merged: bool = False
    inserted: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """How a message is written; ``guard`` marks control signs that occur in a text."""

    begin: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    joint: str = "\n\n"
    control: str = "<|im_"
    guard: str = "< |im_"


def known_role(role: str | None) -> str | None:
    """The role a name stands for; None if unknown."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def fillings(state: str) -> dict[str, tuple[str, ...]]:
    """The shortest runs of empty turns after ``state``, by the state that they lead to."""
    reached, front = {state: ()}, [state]
    while front:
        front = [
            reached.setdefault(role, (*reached[at], role)) and role
            for at in front
            for role in LEGAL[at]
            if role not in reached
        ]
    return reached


def steps(role: str | None, costs: Costs) -> dict[tuple[str, str], Step]:
    """The cheapest step of a turn between any two states. Of equally cheap ones the first
    counts: keep, merge, relabel, each with fewer empty turns first."""
    found: dict[tuple[str, str], Step] = {}
    change = costs.relabel if role else costs.relabel_unknown
    for state in STATES:
        options = []
        for to in ROLES:
            label = 0.0 if to == role else change
            if to == state:
                options.append((to, Step(costs.merge + label, to, merged=True)))
            for at, empty in fillings(state).items():
                if to in LEGAL[at]:
                    options.append((to, Step(label + costs.insert * len(empty), to, inserted=empty)))
        options.sort(key=lambda option: (option[1].cost, option[1].role != role, option[1].merged, len(option[1].inserted)))
        for to, step in options:
            found.setdefault((state, to), step)
    return found


def endings(costs: Costs) -> dict[str, tuple[float, tuple[str, ...]]]:
    """What it takes to end after each state: a conversation ends with the assistant."""
    return {
        state: (0.0, ()) if state == START else (costs.insert * len(empty), empty)
        for state in STATES
        for empty in [fillings(state).get("assistant", ())]
    }


def arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


class Repair:
    """The dynamic programme over one segment of turns."""

    def __init__(self, costs: Costs = Costs()) -> None:
        self.steps = {role: steps(role, costs) for role in (None, *ROLES)}
        self.endings = endings(costs)

    def table(self, roles: list[str | None], entry: str) -> list[dict[str, tuple[float, str]]]:
        """After each turn, by state: the least cost from ``entry`` on and the state before."""
        rows = [{entry: (0.0, entry)}]
        for role in roles:
            row: dict[str, tuple[float, str]] = {}
            for to in STATES:
                best = min(
                    (
                        (cost + self.steps[role][at, to].cost, STATES.index(at))
                        for at, (cost, _) in rows[-1].items()
                        if (at, to) in self.steps[role]
                    ),
                    default=None,
                )
                if best:
                    row[to] = best[0], STATES[best[1]]
            rows.append(row)
        return rows

    def costs_between(self, roles: list[str | None]) -> list[float]:
        """Least cost of the segment for every entry and exit state, row by row."""
        ends = {entry: self.table(roles, entry)[-1] for entry in STATES}
        return [ends[entry].get(to, (NEVER, ""))[0] for entry, to in product(STATES, STATES)]

    def path(self, roles: list[str | None], entry: str, leave: str) -> list[tuple[str, Step]]:
        """The state before each turn and the step taken."""
        rows, state, taken = self.table(roles, entry), leave, []
        for i in range(len(roles), 0, -1):
            before = rows[i][state][1]
            taken.append((before, self.steps[roles[i - 1]][before, state]))
            state = before
        return taken[::-1]

    def through(self, segments: list[list[float]]) -> list[tuple[str, str]]:
        """Entry and exit state of every segment of a conversation, from their cost tables."""
        rows: list[dict[str, tuple[float, str]]] = [{START: (0.0, START)}]
        for between in segments:
            row = {}
            for j, to in enumerate(STATES):
                best = min(
                    (cost + between[4 * STATES.index(at) + j], STATES.index(at)) for at, (cost, _) in rows[-1].items()
                )
                if best[0] < NEVER:
                    row[to] = best[0], STATES[best[1]]
            rows.append(row)
        last = min(rows[-1], key=lambda s: (rows[-1][s][0] + self.endings[s][0], STATES.index(s)))
        states = [last]
        for row in rows[:0:-1]:
            states.append(row[states[-1]][1])
        states.reverse()
        return list(zip(states, states[1:], strict=False))


def rendered(before: str, step: Step, text: str | None, template: Template) -> str:
    """The part of the conversation that a turn adds."""
    body = (text or "").replace(template.control, template.guard)
    if step.merged:
        return template.joint + body
    empty = "".join(template.begin.format(role=role) + template.end for role in step.inserted)
    closing = "" if before == START else template.end
    return closing + empty + template.begin.format(role=step.role) + body


GROUP = ["conv", "solo", "segment"]


def in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition(*GROUP).sortWithinPartitions(*GROUP, F.col("turn").asc_nulls_last(), "tie", "role")


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The segments of a sorted partition, which run over the ends of batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, key=lambda row: tuple(row[name] for name in GROUP)):
        yield list(group)


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def by_segment(function: Callable[[list[dict]], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((row for group in segments(batches) for row in function(group)), schema)

    return run


def repair_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
    template: Template = Template(),
) -> DataFrame:
    """``conv_col, turn_col, segment, position, role_col, new_role, action, inserted, fragment, cost``: a
    row for every turn. ``action`` is keep, merge, relabel or merge+relabel; ``inserted`` lists
    the roles of the empty turns before it, and after it too if it is the last; the fragments
    of a conversation in the order of segment and position are the rendered conversation.

    Turns are in the order of their number; equal numbers and turns without one (which come
    last) are in the order of a hash of role and text. Unknown and null roles are relabelled
    at a lower cost; null texts are empty; repeated rows are turns like any other; a turn
    without a conversation is a conversation of its own; other columns are not read; an empty
    table gives an empty result. Conversations of any length are handled: segments of about a
    thousand turn numbers are solved for every entry and exit state, these small tables are
    joined along the conversation, and each segment is then traced by itself."""
    kinds = {name: turns.schema[column].dataType.simpleString() for name, column in
             (("conv", conv_col), ("turn", turn_col))}
    tie = F.xxhash64("role", "text")
    unnumbered = UNNUMBERED + F.floor((F.shiftright("tie", 1) + (1 << 62)) / ((1 << 63) // SPREAD))
    rows = (
        turns.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
            F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
        )
        .withColumn("tie", tie)
        .withColumn("solo", F.when(F.col("conv").isNull(), F.col("tie")).otherwise(F.lit(0)))
        .withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), unnumbered).cast("bigint"))
    )
    keys = f"conv {kinds['conv']}, solo bigint, segment bigint"

    solved = f"{keys}, between array<double>"

    def solve(group: list[dict]) -> Iterator[dict]:
        head = {name: group[0][name] for name in GROUP}
        yield head | {"between": Repair(costs).costs_between([known_role(row["role"]) for row in group])}

    tables = in_order(rows.drop("text")).mapInArrow(by_segment(solve, arrow(solved)), solved)
    chains = tables.groupBy("conv", "solo").agg(
        F.sort_array(F.collect_list(F.struct("segment", "between"))).alias("chain")
    )
    passed = f"{keys}, entry string, leave string, final boolean"
    passed_arrow = arrow(passed)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(costs)

        def states() -> Iterator[dict]:
            for row in (row for batch in batches for row in batch.to_pylist()):
                chain = row["chain"]
                ways = repair.through([part["between"] for part in chain])
                for i, (part, (entry, leave)) in enumerate(zip(chain, ways, strict=True)):
                    yield {
                        "conv": row["conv"], "solo": row["solo"], "segment": part["segment"],
                        "entry": entry, "leave": leave, "final": i + 1 == len(chain),
                    }

        yield from in_batches(states(), passed_arrow)

    ways = stored(chains.mapInArrow(join, passed), "ways")
    same = [rows[name].eqNullSafe(ways[name]) for name in GROUP]
    joined = rows.join(ways, same).select(*[rows[c] for c in rows.columns], "entry", "leave", "final")
    done = (
        f"{keys}, turn {kinds['turn']}, position int, role string, new_role string, action string, "
        "inserted array<string>, fragment string, cost double"
    )

    def trace(group: list[dict]) -> Iterator[dict]:
        repair = Repair(costs)
        roles = [known_role(row["role"]) for row in group]
        path = repair.path(roles, group[0]["entry"], group[0]["leave"])
        for i, (row, (before, step)) in enumerate(zip(group, path, strict=True)):
            fragment, inserted, cost = rendered(before, step, row["text"], template), list(step.inserted), step.cost
            if row["final"] and i + 1 == len(group):
                more, empty = repair.endings[row["leave"]]
                fragment += template.end + "".join(
                    template.begin.format(role=role) + template.end for role in empty
                )
                inserted, cost = inserted + list(empty), cost + more
            changed = step.role != roles[i]
            action = "+".join(["merge"] * step.merged + ["relabel"] * changed) or "keep"
            yield {
                **{name: row[name] for name in GROUP}, "turn": row["turn"], "position": i, "role": row["role"],
                "new_role": step.role, "action": action, "inserted": inserted, "fragment": fragment, "cost": cost,
            }

    traced = in_order(joined).mapInArrow(by_segment(trace, arrow(done)), done)
    return traced.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "segment", "position",
        F.col("role").alias(role_col), "new_role", "action", "inserted", "fragment", "cost",
    )


def conversation_texts(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, text``: whole conversations put together from their fragments, for those that
    one task can hold; turns without a conversation are left out."""
    parts = F.sort_array(F.collect_list(F.struct("segment", "position", "fragment")))
    whole = repaired.where(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(parts.alias("parts"))
    return whole.select(conv_col, F.array_join(F.col("parts.fragment"), "").alias("text"))
