"""Chat formatting from a declarative template; DataFrame functions only (operator 2).

The template names, for each role, the strings around its text, whether its text is trained on, and
which roles may follow which. Roles that it doesn't name get a form that carries the role's own name.
Control strings inside texts and names are broken by a backslash after their first character, and
backslashes are doubled, so no control string ever occurs in a text and the way back is exact.

Turn order is checked by a finite-state machine. A stretch of turns is a function from states to states,
and such functions compose: stretches of ``STRETCH`` turns are folded where they lie, then the few
stretches of a conversation. So a conversation with very many turns isn't sorted as rows in one task.

Rows of a conversation stand by turn, then role, then text; null turn comes first, null role and null
text are empty, null conv_id is a conversation; very long texts are taken whole, and a conversation is one row of the
result, whose size is its own. Repeated rows are repeated turns. An empty table has no conversations. Other columns are ignored. A conversation that breaks the order is formatted all the same,
with ``valid`` false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 64


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: (state, role) -> state; a role without an entry breaks the order.
    moves: dict[tuple[str, str], str]
    start: str = "start"
    accepting: tuple[str, ...] = ()
    control: tuple[str, ...] = ()
    #: around the name of any other role, and after its text
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    states: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "states", sorted({self.start, *self.accepting, *(s for s, _ in self.moves), *self.moves.values()}) + ["broken"])

    @property
    def marks(self) -> list[str]:
        """Every string that must not occur in a text, longest first."""
        inner = [m.strip() for r in self.roles.values() for m in (r.before, r.after)]
        return sorted({m for m in (*inner, *self.other, *self.control) if m}, key=lambda m: (-len(m), m))


INSTRUCT = Template(
    roles={"system": Role("<<SYS>> ", " <</SYS>>"), "user": Role("<s>[INST] ", " [/INST]"), "assistant": Role("<ans> ", " </s>", loss=True)},
    moves={("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    accepting=("answered",),
    control=("<s>", "[INST]"),
)


def _alternatives(marks: list[str], inside: str = "") -> str:
    return "|".join(re.escape(m[0]) + inside + re.escape(m[1:]) for m in marks)


def escape(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    rests: dict[str, list[str]] = {}
    for m in template.marks:
        rests.setdefault(m[0], []).append(re.escape(m[1:]))
    # a first character is followed by a backslash where its own marks go on; the class finds candidates fast
    goes_on = "|".join(f"(?<={re.escape(first)})(?:{'|'.join(own)})" for first, own in sorted(rests.items()))
    return F.regexp_replace(doubled, f"[{''.join(re.escape(first) for first in sorted(rests))}](?={goes_on})", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _segments(template: Template, role: Column, text: Column) -> Column:
    """A turn as (text, loss) segments: mark, text, mark."""
    seg = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    body = escape(text, template)
    a, b, c = template.other
    out = F.array(seg(F.concat(F.lit(a), escape(role, template), F.lit(b)), False), seg(body, False), seg(F.lit(c), False))
    for name, r in template.roles.items():
        out = F.when(role == name, F.array(seg(F.lit(r.before), False), seg(body, r.loss), seg(F.lit(r.after), False))).otherwise(out)
    return out


def _moves(template: Template, role: Column) -> Column:
    """The turn as an array: for each state's number, the number of the state it leads to."""
    number = {s: i for i, s in enumerate(template.states)}
    lost = number["broken"]
    out = F.array(*(F.lit(lost) for _ in template.states))
    for name in sorted({r for _, r in template.moves}):
        out = F.when(role == name, F.array(*(F.lit(number.get(template.moves.get((s, name)), lost)) for s in template.states))).otherwise(out)
    return out


def _fold(moves: Column, n_states: int) -> Column:
    states = F.sequence(F.lit(0), F.lit(n_states - 1))
    same = F.transform(states, lambda s: F.get(states, s))  # the same array, with nullable elements as in the fold
    return F.aggregate(moves, same, lambda done, step: F.transform(done, lambda s: F.get(step, s)))


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, segments (text, loss), n_turns, valid: one row per conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    parts = turns.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    n = len(template.states)
    parts = parts.select(
        "conv_id", "stretch", F.size("t").alias("n"),
        F.flatten(F.transform("t", lambda x: _segments(template, x["role"], x["text"]))).alias("segments"),
        _fold(F.transform("t", lambda x: _moves(template, x["role"])), n).alias("moves"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "segments", "moves")), lambda a, b: _nulls_first(a["stretch"], b["stretch"])).alias("p"), F.sum("n").cast("long").alias("n_turns"))
    final = F.get(_fold(F.transform("p", lambda x: x["moves"]), n), F.lit(template.states.index(template.start)))
    good = [template.states.index(s) for s in template.accepting]
    return whole.select("conv_id", F.flatten(F.transform("p", lambda x: x["segments"])).alias("segments"), "n_turns", final.isin(good).alias("valid"))


def _nulls_first(a: Column, b: Column) -> Column:
    rank = lambda x: F.coalesce(x, F.lit(-(1 << 62)))
    return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = INSTRUCT) -> Column:
    """Formatted text back to its turns: an array of (role, text)."""
    ends = [r.after for r in template.roles.values()] + [template.other[2]]
    turns = F.array_remove(F.split(text, "(?<=" + "|".join(re.escape(e) for e in ends) + ")"), "")

    def read(turn: Column) -> Column:
        a, b, c = template.other
        at = F.instr(turn, b)
        name = F.substring(turn, F.lit(len(a) + 1), at - len(a) - 1)
        body = F.substring(turn, at + len(b), F.length(turn) - at - len(b) + 1 - len(c))
        out = F.struct(unescape(name).alias("role"), unescape(body).alias("text"))
        for role, r in template.roles.items():
            inner = F.substring(turn, F.lit(len(r.before) + 1), F.length(turn) - len(r.before) - len(r.after))
            out = F.when(F.startswith(turn, F.lit(r.before)), F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(turns, read)


def chat_digests(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of what is read back from the formatted output."""
    chats = format_chats(rows, template).withColumn("formatted", formatted(F.col("segments")))
    back = read_turns(F.col("formatted"), template)
    turns_text = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.withColumn("masked", masked).select(
        "conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(turns_text, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
