"""Conversation structure repair by iterative-deepening A* (operator 12).

A conversation's rows, by turn, may keep their place, be deleted, change their role to user or assistant, or have
an empty user or assistant turn inserted before them, so that the initials of the roles read ``(s?(ua)+)?``. Keep
costs 0, Insert 2, Rerole 2, Delete 3; a truncated row that stays costs 1 more, blank and duplicate rows must go. The
cheapest edits are found by depth-first search in ASCII order of the edits (D, I, K, R) under a bound that grows by
one; what the rows ahead must cost in any case is the heuristic. A place of the search that failed with so much left to
spend fails with less, from whatever start and in whatever round, so it is kept in a table. The first accepting
path is the cheapest, and of equally cheap ones the least string of edits.

A conversation is searched in stretches of ``STRETCH`` rows: for each state of the order that it can begin and end
in, the cheapest and least edits; these are put together like words of a shortest path. Edits that all surviving paths share are
decided and leave the task, so a conversation of any length takes linear time and only its undecided rows are held.
One task reads a conversation's rows in sorted order, as the digest of its repaired text forces.

Faults of a row, the first that holds: blank (no character but ``[\\x20\\x09-\\x0D]``), duplicate (an earlier row of the
conversation has its role and text), truncated (the last other character is not one of ``.!?``). Rows stand by turn
(null first), then role, then text; a null role or text is one space. A null conv_id is a conversation. Repeated rows are duplicates. An empty table gives
none; very long texts are taken whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

STRETCH = 16
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: states of the order of roles: nothing yet, after the system turn, after a user, after an assistant
START, TOLD, ASKED, ANSWERED = range(4)
ACCEPTING = (START, ANSWERED)
#: by state, what each initial leads to
MOVES = ({"s": TOLD, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
#: by state, the one role that may be inserted or given to a row
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (ASKED, ASKED, ANSWERED, ASKED)

#: From any state, whatever follows another state can follow too for so much more: at worst a user and an assistant turn are
#: inserted and a system turn is deleted. A path that costs more than that above the cheapest is on no cheapest repair.
DETOUR = 2 * INSERT + DELETE

_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
Row = tuple[str, str, str | None]  # role, text, fault


class Search:
    """Cheapest edits of a stretch of rows between states of the order of roles."""

    def __init__(self, rows: list[Row]):
        self.must_go = [fault in ("blank", "duplicate") for _, _, fault in rows]
        self.extra = [TRUNCATED if fault == "truncated" else 0 for _, _, fault in rows]
        self.initial = [role[:1] for role, _, _ in rows]
        #: what the rows from each on cost at least
        self.ahead = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.ahead[i] = self.ahead[i + 1] + (DELETE if self.must_go[i] else self.extra[i])
        #: by goal and place, the most that was left to spend where the search failed
        self.failed: dict[int, dict[tuple[int, int], int]] = {}

    def reaches(self, start: int, goal: int) -> bool:
        if goal == TOLD:
            return start == TOLD or start == START and any(a == "s" and not gone for a, gone in zip(self.initial, self.must_go))
        return goal in (ASKED, ANSWERED) or start == START

    def cheapest(self, start: int, goal: int) -> tuple[int, str] | None:
        if not self.reaches(start, goal):
            return None
        bound = self.ahead[0]
        while (path := self._within(start, goal, bound)) is None:
            bound += 1
        return bound, path

    def _within(self, start: int, goal: int, bound: int) -> str | None:
        """The first accepting path that costs ``bound`` at most."""
        n, failed = len(self.must_go), self.failed.setdefault(goal, {})
        path: list[str] = []

        def visit(i: int, state: int, left: int) -> bool:
            if left < self.ahead[i] or failed.get((i, state), -1) >= left:
                return False
            if i == n and state == goal:
                return True
            for edit, to, at, cost in self._edits(i, state):
                path.append(edit)
                if visit(to, at, left - cost):
                    return True
                path.pop()
            failed[i, state] = left
            return False

        return "".join(path) if visit(0, start, bound) else None

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, next row, next state, cost) in ASCII order of the edits."""
        row = i < len(self.must_go)
        if row:
            yield "D", i + 1, state, DELETE
        yield "I", i, NEXT_STATE[state], INSERT
        if row and not self.must_go[i]:
            if (to := MOVES[state].get(self.initial[i])) is not None:
                yield "K", i + 1, to, self.extra[i]
            yield "R", i + 1, NEXT_STATE[state], REROLE + self.extra[i]


def fault_of(text: str, first: bool) -> str | None:
    shown = text.rstrip(_BLANK)
    if not shown:
        return "blank"
    if not first:
        return "duplicate"
    return None if shown[-1] in ".!?" else "truncated"


def cheapest_edits(rows: Iterable[Row], stretch: int = STRETCH) -> Iterator[tuple[str, str, str, str | None, int]]:
    """The repair of one conversation, edit by edit as it is decided: (edit, role, text, fault, cost).

    A deleted row comes with its own role and text, any other edit with those that stand in the repaired conversation.
    """
    paths: dict[int, tuple[int, str]] = {START: (0, "")}
    waiting: list[Row] = []  # rows whose edits aren't all decided
    state = START  # after the decided edits

    def decide(edits: str) -> Iterator[tuple[str, str, str, str | None, int]]:
        nonlocal state
        used = 0
        for edit in edits:
            if edit == "I":
                yield edit, NEXT_ROLE[state], "", None, INSERT
                state = NEXT_STATE[state]
                continue
            role, text, fault = waiting[used]
            used += 1
            extra = TRUNCATED if fault == "truncated" else 0
            if edit == "D":
                yield edit, role, text, fault, DELETE
            elif edit == "R":
                yield edit, NEXT_ROLE[state], text, fault, REROLE + extra
                state = NEXT_STATE[state]
            else:
                yield edit, role, text, fault, extra
                state = MOVES[state][role[:1]]
        del waiting[:used]

    def extend(part: list[Row], goals: Iterable[int]) -> None:
        nonlocal paths
        search, new = Search(part), {}
        for goal in goals:
            found = [(cost + more[0], edits + more[1]) for at, (cost, edits) in paths.items() if (more := search.cheapest(at, goal))]
            if found:
                new[goal] = min(found)
        least = min(cost for cost, _ in new.values())
        paths = {at: path for at, path in new.items() if path[0] <= least + DETOUR}

    part: list[Row] = []
    for row in rows:
        if len(part) == stretch:  # more rows follow
            extend(part, range(4))
            part = []
            shared = commonprefix([edits for _, edits in paths.values()])
            yield from decide(shared)
            paths = {at: (cost, edits[len(shared) :]) for at, (cost, edits) in paths.items()}
        part.append(row)
        waiting.append(row)
    if part:
        extend(part, ACCEPTING)
        yield from decide(min(paths.values())[1])


def _flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and whether the row is the first of its conversation with its role and text.

    Counted by an aggregate, so that many copies of a row meet before they are dealt; only rows that occur again are joined.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("uid"))
    held = materialize(held, "conversation-rows")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    groups = held.select("conv_id", digest.alias("digest"), place.alias("place")).groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    again = materialize(groups.filter("copies > 1").select(F.col("conv_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first.uid").alias("first_uid")), "repeated-rows")
    joined = held.withColumn("digest", digest).join(again, F.col("conv_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    return joined.select("conv_id", "turn", "role", "text", "uid", F.coalesce(F.col("first_uid") == F.col("uid"), F.lit(True)).alias("first"))


def _in_order(rows: DataFrame) -> DataFrame:
    return _flagged(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "uid").drop("uid")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of rows that come sorted; each conversation is to be read before the next."""
    from itertools import groupby

    flat = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)))
    return ((key, rows) for key, rows in groupby(flat, key=lambda r: r[0]))


def edits(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv_id, step, edit, role, text, fault, cost: the cheapest repair of every conversation, edit by edit.

    Rows with another edit than ``D`` are, by step, the repaired conversation.
    """
    schema, ddl = _schema(rows, "step long, edit string, role string, text string, fault string, cost long")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, own in _conversations(batches):
            read = ((role, text, fault_of(text, first)) for _, _, role, text, first in own)
            for step, edit in enumerate(cheapest_edits(read, stretch)):
                yield conv, step, *edit

    return _in_order(rows).mapInArrow(lambda batches: _batches(repaired(batches), schema), ddl)


def _schema(rows: DataFrame, columns: str) -> tuple[pa.Schema, str]:
    """Of ``columns`` after a conv_id of the type that it has in ``rows``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    named = [c.split() for c in columns.split(", ")]
    return pa.schema([("conv_id", to_arrow_type(kind)), *((name, pa.int64() if k == "long" else pa.string()) for name, k in named)]), f"conv_id {kind.simpleString()}, {columns}"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some MB at most, or one row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def reports(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation: gaps, faults, adjacent roles that are out of order, and the digest of its repair."""

    def report(own: Iterator[tuple]) -> tuple[dict[str, int], str, str]:
        out = dict.fromkeys(_REPORT, 0)
        low = high = None
        distinct, previous = 0, None

        def read() -> Iterator[Row]:
            nonlocal low, high, distinct, previous
            for _, turn, role, text, first in own:
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
                out["illegal"] += previous is not None and previous + role[:1] not in ("su", "ua", "au")
                previous = role[:1]
                if fault := fault_of(text, first):
                    out[fault] += 1
                yield role, text, fault

        digest, audit, lines = hashlib.sha256(), [], 0
        for edit, role, text, _, cost in cheapest_edits(read(), stretch):
            audit.append(edit)
            out["cost"] += cost
            if edit != "D":
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1
        out["gaps"] = high - low + 1 - distinct if distinct else 0
        return out, "".join(audit), digest.hexdigest()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, own in _conversations(batches):
            counts, audit, digest = report(own)
            yield conv, *(counts[c] for c in _REPORT), audit, digest

    schema, ddl = _schema(rows, ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")
    return _in_order(rows).mapInArrow(lambda batches: _batches(every(batches), schema), ddl)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults for trying repairs, the same in every run: by crc32 of ``conv_id:turn`` modulo 20, 0 drops the
    row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 sets its role to user. Nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return out.drop("copy")


def damage_reports(rows: DataFrame) -> DataFrame:
    """``reports`` of the damaged rows, with a row for every conversation of ``rows``, those that lost all rows too."""
    found = reports(damaged(rows))
    every = rows.select(F.col("conv_id").alias("known_id")).distinct()
    joined = every.join(found, F.col("known_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _REPORT]
    return joined.select(F.col("known_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
