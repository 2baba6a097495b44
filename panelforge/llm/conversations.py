"""Repair of the turn structure of conversations by depth-first branch and bound.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept (0), given the other role
(1) or deleted (2, required for blank and duplicate rows); empty turns are inserted (5); truncated
rows that stay cost 5 more. The answer is the cheapest list of edits, the ASCII-least of equals.

A search node is a number of rows consumed and the kind of the last turn (nothing yet, system,
user, assistant). Nodes wait on an explicit stack, the most promising child on top. A suffix bound
(the rows still to come, without the rule that a system turn stands first) and the incumbent (cost,
edits) cut off nodes that cannot be better; a table per node cuts off worse prefixes of the same
node. The search ends when the stack is empty, which proves the incumbent. Two prefixes of one
node and cost never start with one another, so the smaller one stays smaller with any ending.

Long conversations are cut into segments: every segment is searched from each kind of last turn to
each other, and segments are chained, so that stack and tables stay small however long it is.

Two passes. The first shuffles one short row per turn (order, role, fault, digest) and streams
conversations through a task in order; it holds a digest and one character per turn. The second
streams the texts past the edits and updates the digest of the repaired text, holding one turn at a
time. A conversation is read by one task, as its digest is sequential; its texts are never held.

Defined results: missing roles and texts, and missing ids in the damage key, are one space; turns
order rows, missing turns first, equal turns by digest of role and text; a missing conversation id
is a conversation of its own; roles count by their first character, and any other than s, u or a
fits nowhere; a conversation that lost all rows has zeros, no edits and the digest of an empty
text; rows repeated with their turn are duplicates; very long texts are read once; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Costs of the edits, and the damage of a row by its remainder.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
DROPPED, EMPTIED, UNENDED, REPEATED, AS_USER = 0, 1, 2, 3, 4
# Kinds of the last turn and what may follow it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# A row is one character: role initial s, u, a or x (any other), upper case when it must go,
# a digit (its place in FADED) when it is truncated.
FADED = "suax"
# Parameters: rows searched at once and answers remembered per task.
SEGMENT = 256
REMEMBERED = 20_000


def _choices(row: str) -> tuple[str, bool, int]:
    """(role initial, must go, cost of staying) of a row."""
    if row.isdigit():
        return FADED[int(row)], False, TRUNCATED
    return row.lower(), row.isupper(), 0


def suffix_bounds(rows: str, goals: Sequence[int]) -> list[tuple[int, int]]:
    """Least cost of the rows from i on when a user, or an assistant, turn is due.

    Relaxed: system turns may stay anywhere and never change what is due.
    """
    far = 10 ** 9
    user_due = 0 if set(goals) & {NOTHING, SYSTEM, ASSISTANT} else INSERT
    agent_due = 0 if USER in goals else INSERT
    bounds = [(min(user_due, agent_due + INSERT), min(agent_due, user_due + INSERT))]
    for row in reversed(rows):
        role, must_go, stay = _choices(row)
        u, a = bounds[-1]
        best = []
        for due, other, same in (("u", a, u), ("a", u, a)):
            cost = DELETE + same
            if not must_go:
                cost = min(cost, stay + (KEEP if role == due else REROLE) + other, stay + same if role == "s" else far)
            best.append(cost)
        bounds.append((min(best[0], best[1] + INSERT), min(best[1], best[0] + INSERT)))
    return bounds[::-1]


def search(rows: str, start: int = NOTHING, goals: Sequence[int] = ENDS) -> tuple[int, str] | None:
    """Cheapest (cost, edits) from ``start`` to one of the kinds ``goals``, None if there is none."""
    n, bounds, incumbent = len(rows), suffix_bounds(rows, goals), None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, kind, cost, edits = stack.pop()
        if incumbent is not None:
            least = cost + bounds[i][kind == USER]
            if least > incumbent[0] or (least == incumbent[0] and edits > incumbent[1][: len(edits)]):
                continue
        known = table.get((i, kind))
        if known is not None and known < (cost, edits):
            continue
        if i == n and kind in goals and (incumbent is None or (cost, edits) < incumbent):
            incumbent = (cost, edits)
        children = []
        if i < n:
            role, must_go, stay = _choices(rows[i])
            children.append((i + 1, kind, cost + DELETE, edits + "D"))
            if not must_go:
                for initial, after in FOLLOWS[kind].items():
                    if initial == role:
                        children.append((i + 1, after, cost + stay + KEEP, edits + "K"))
                    elif initial != "s":
                        children.append((i + 1, after, cost + stay + REROLE, edits + "R"))
        if not edits.endswith("II"):  # a third insertion in a row only repeats a kind
            children += [(i, after, cost + INSERT, edits + "I") for initial, after in FOLLOWS[kind].items() if initial != "s"]
        better = []
        for child in children:
            at, prefix = child[:2], child[2:]
            if at not in table or prefix < table[at]:
                table[at] = prefix
                better.append(child)
        # The last one pushed is searched first: least bound, then ASCII order.
        stack += sorted(better, key=lambda c: (c[2] + bounds[c[0]][c[1] == USER], c[3]), reverse=True)
    return incumbent


def repair(rows: str) -> tuple[int, str]:
    """Cheapest (cost, edits) of a conversation of any length."""
    if len(rows) <= SEGMENT:
        return search(rows)
    so_far = {NOTHING: (0, "")}
    for at in range(0, len(rows), SEGMENT):
        part, reached = rows[at : at + SEGMENT], {}
        for start, (cost, edits) in so_far.items():
            for goal in (NOTHING, SYSTEM, USER, ASSISTANT):
                found = search(part, start, (goal,))
                if found is not None:
                    total = (cost + found[0], edits + found[1])
                    reached[goal] = min(reached.get(goal, total), total)
        so_far = reached
    return min(so_far[k] for k in ENDS if k in so_far)


def repaired(edits: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the turns that stay, in order."""
    kind = NOTHING
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            kind = FOLLOWS[kind][role[:1]]
            yield f"{role}:{text}"
        else:
            kind = ASSISTANT if kind == USER else USER
            yield f"{NAMES[kind]}:{text}"


# --- rows ----------------------------------------------------------------------------------


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage; dropped ones stay with ``gone`` so that no conversation is lost."""
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == EMPTIED, "").when(fate == UNENDED, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.select(
        "conv_id", "turn", F.when(fate == AS_USER, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        (fate == DROPPED).alias("gone"),
        F.explode(F.when(fate == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Adds the digest of role and text, the role's first character and the faults of a single row."""
    sign = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    seen = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", "")
    return rows.select(
        "*", sign.alias("sign"), F.substring("role", 1, 1).alias("initial"), (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("unended"),
    )


STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
STAT_NAMES = [c.split()[0] for c in STATS.split(", ")]


class Conversation:
    """Counts and row characters of the conversation that streams past."""

    def __init__(self, conv_id):
        self.conv_id, self.seen, self.rows, self.last = conv_id, set(), [], None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn, sign, initial, blank, unended):
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        fault = "blank" if blank else "duplicate" if sign in self.seen else "truncated" if unended else None
        self.seen.add(sign)
        kind = initial if initial in ("s", "u", "a") else "x"
        if fault:
            self.counts[fault] += 1
        self.rows.append(kind.upper() if fault in ("blank", "duplicate") else str(FADED.index(kind)) if fault else kind)
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def result(self, known: dict) -> tuple:
        rows = "".join(self.rows)
        if rows not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[rows] = repair(rows)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), *known[rows])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield out()
            held = []
    if held:
        yield out()


def _laid(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost and edits."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    slim = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "sign", "initial", "blank", "unended", "gone")
    laid = _laid(slim, F.col("turn").asc_nulls_first(), "sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}

        def results(batches):
            this = None
            for conv_id, turn, sign, initial, blank, unended, gone in _stream(batches):
                if this is None or this.conv_id != conv_id:
                    if this is not None:
                        yield this.result(known)
                    this = Conversation(conv_id)
                if not gone:
                    this.add(turn, sign, initial, blank, unended)
            if this is not None:
                yield this.result(known)

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("conv_id"), *[(n, pa.string() if n == "audit" else pa.int64()) for n in STAT_NAMES]])
        yield from _batches(results(_chain(first, batches)), schema)

    return laid.mapInArrow(run, f"conv_id {kind}, {STATS}")


def _chain(first, rest):
    yield first
    yield from rest


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, edits and the digest of the repaired text.

    ``rows`` has conv_id, turn, role, text and ``gone`` (see :func:`damaged`).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = judged(rows)
    edits = materialize(audits(rows)).withColumn("mark", F.lit(0))
    texts = rows.where("NOT gone").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "sign", "role", "text").withColumn("mark", F.lit(1))
    both = edits.unionByName(texts, allowMissingColumns=True)
    laid = _laid(both, "mark", F.col("turn").asc_nulls_first(), "sign").select("mark", "conv_id", *STAT_NAMES, "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(batches):
            line, held = _stream(batches), []

            def turns():  # the texts of the conversation at hand; the next one's first row is kept
                for row in line:
                    if row[0] == 0:
                        held.append(row)
                        return
                    yield row[-2:]

            row = next(line, None)
            while row is not None:
                digest, first, rest = hashlib.sha256(), True, turns()
                for text in repaired(row[len(STAT_NAMES) + 1], rest):
                    digest.update((text if first else "\n" + text).encode("utf-8", "surrogatepass"))
                    first = False
                for _ in rest:
                    pass
                yield (*row[1 : len(STAT_NAMES) + 2], digest.hexdigest())
                row = held.pop() if held else None

        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([*[first.schema.field(n) for n in ("conv_id", *STAT_NAMES)], ("repaired_sha256", pa.string())])
        yield from _batches(results(_chain(first, batches)), schema)

    return laid.mapInArrow(run, f"conv_id {kind}, {STATS}, repaired_sha256 string")


def repaired_after_damage(rows: DataFrame) -> DataFrame:
    """The repair of conversations whose rows were damaged by the fixed rule."""
    return repaired_conversations(damaged(rows.select("conv_id", "turn", "role", "text")))
