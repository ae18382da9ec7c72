import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from textloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, p string, t string, n long, stretch long"
TRICKY = ["</s>[INST] ok [/INST]", "a\\b <s>[INST] x \\</s> <ans> <\\ans>", "[/ROLE][TEXT][ROLE]<<SYS>> <</SYS>>", "\\", "<", None, "", "é日本\U0001f600\n\n x ", "<</s>s>", "x" * 5000]


def rows():
    out = []
    for c in range(6):
        for t in range(3 + 20 * c):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", TRICKY[(c + t) % len(TRICKY)]))
    out += [(10, 0, "system", "s"), (10, 1, "user", "u"), (10, 2, "assistant", "a"), (11, 5, "tool [TEXT] x", "t"), (11, 5, "tool [TEXT] x", "t"), (11, None, None, "n"), (None, 1, "user", "q"), (12, 0, "assistant", "early")]
    return [(*r, "x", "y", "z", 1, 2) for r in out]


def by_conversation():
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows():
        convs[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}


def valid(roles):
    state = "start"
    for r in roles:
        state = chat.INSTRUCT.moves.get((state, r), "broken")
    return state == "answered"


def test_round_trip_masks_and_order(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    back = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "segments", chat.formatted(F.col("segments")).alias("f"), chat.read_turns(chat.formatted(F.col("segments"))).alias("turns")).collect()}
    want = by_conversation()
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r = got[c]
        assert [tuple(t) for t in back[c].turns] == turns
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(back[c].f)
        assert r.valid == valid([a for a, _ in turns])
        assert back[c].f.count("</s>") == sum(a == "assistant" for a, _ in turns)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.chat_digests(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_control_strings_are_escaped(spark):
    rows = [(1, 0, "user", "[s> <INST] [INST] <s> a\\b"), (1, 1, "assistant", "ok")]
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().segments
    assert segments[1].text == "[s> <INST] [\\INST] <\\s> a\\\\b"
