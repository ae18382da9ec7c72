import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from textloom.llm import repair

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """Least (cost, edits) by rows: all states of the order, any number of insertions between."""
    give = lambda q: "a" if q == "u" else "u"

    def with_insertions(best):
        best, todo = dict(best), list(best)
        while todo:
            q = todo.pop()
            cost, edits = best[q]
            if (cost + 2, edits + "I") < best.get(give(q), (1 << 60, "")):
                best[give(q)] = (cost + 2, edits + "I")
                todo.append(give(q))
        return best

    best = {"": (0, "")}
    for role, _, fault in rows:
        new = {}
        for q, (cost, edits) in with_insertions(best).items():
            ways = [(q, cost + 3, edits + "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways.append((give(q), cost + 2 + extra, edits + "R"))
                if (q, role[:1]) in MOVES:
                    ways.append((MOVES[q, role[:1]], cost + extra, edits + "K"))
            for to, c, e in ways:
                new[to] = min(new.get(to, (c, e)), (c, e))
        best = new
    return min(v for q, v in with_insertions(best).items() if q in ("", "a"))


def repaired(rows, edits):
    out, rest = [], iter(rows)
    for e in edits:
        last = out[-1][0][:1] if out else ""
        role, text, _ = ("", "", None) if e == "I" else next(rest)
        if e != "D":
            out.append((role if e == "K" else "assistant" if last == "u" else "user", text))
    assert next(rest, None) is None
    return out


@pytest.mark.parametrize("stretch", [1, 3, 16])
def test_search_finds_the_cheapest_and_least_edits(stretch):
    rng = random.Random(stretch)
    for _ in range(1200):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), str(i), rng.choice([None, None, "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 11))]
        found = list(repair.cheapest_edits(rows, stretch))
        assert (sum(f[4] for f in found), "".join(f[0] for f in found)) == cheapest(rows)
        assert [f[1:3] for f in found if f[0] != "D"] == repaired(rows, [f[0] for f in found])


def test_a_long_conversation_takes_linear_time_and_is_handed_on_in_parts():
    faulty = {7: ("user", "u", None), 31: ("assistant", "", "blank")}
    seen = 0

    def rows():
        nonlocal seen
        for i in range(30_000):
            seen += 1
            yield faulty.get(i % 40, (("user", "assistant")[i % 2], "x", None))

    first = None
    for n, edit in enumerate(repair.cheapest_edits(rows())):
        first = seen if first is None else first
    assert first < 100 and n + 1 >= 30_000


ROLES = ["user", "assistant", "system", None, "tool", "", "sage"]
TEXTS = ["Yes.", "No!", " ", None, "", "open", "open \n", "Is it?\t", "\x1c", "é日本\U0001f600.", "Yes."]


def make_rows():
    rng = random.Random(5)
    out = []
    for c in [*range(40), None, 1000]:
        turns = list(range(rng.randint(1, 9)))
        for t in turns + rng.choices([None, 3, 12], k=rng.randint(0, 2)):
            role = ("user", "assistant")[t % 2] if t is not None and rng.random() < 0.7 else rng.choice(ROLES)
            out.append((c, t, role, rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.randint(0, 99)}.", "x", True))
    out += [(77, 0, "user", "q" * 100_000, "x", False), (77, 1, "assistant", "r" * 100_000 + ".", "x", False), (78, None, "user", "only.", "x", None)]
    out += [(79, i, ("user", "assistant")[i % 2], f"turn {i}" + "." * (i % 9 > 0), "x", True) for i in range(200)]
    lost = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out.append((lost, 0, "user", "Gone.", "x", True))
    return out + [next(r for r in out if r[0] == 0)] * 2


def expected(rows):
    shown = lambda v: " " if v is None else str(v)
    after = defaultdict(list)
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        role, text = shown(role), shown(text)
        after[c] += {0: 0, 3: 2}.get(kind, 1) * [((t is not None, t or 0), "user" if kind == 4 else role, "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text)]
    for c, own in after.items():
        own.sort()
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(BLANK)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else None if end in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for (known, t), _, _ in own if known}
        cost, audit = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults)])
        lines = repaired([(r, x, f) for (_, r, x), f in zip(own, faults)], audit)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield (c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, digest string, first boolean"


def test_reports_of_damaged_rows(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA).repartition(5)
    out = repair.damage_reports(df)
    got = [tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out.collect()]
    want = list(expected(make_rows()))
    assert any(w[7] == "" for w in want) and {"D", "I", "K", "R"} <= set("".join(w[7] for w in want))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edits_are_the_repaired_conversation(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    report = {r.conv_id: r for r in repair.reports(df).collect()}
    found = defaultdict(list)
    for r in repair.edits(df).orderBy("conv_id", "step").collect():
        found[r.conv_id].append(r)
    assert found.keys() == report.keys()
    for c, own in found.items():
        assert [r.step for r in own] == list(range(len(own)))
        assert ("".join(r.edit for r in own), sum(r.cost for r in own)) == (report[c].audit, report[c].cost)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == report[c].repaired_sha256


def test_empty_and_text_ids(spark):
    assert repair.damage_reports(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yo.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit) for r in repair.reports(named).collect()] == [("a", "KK")]
