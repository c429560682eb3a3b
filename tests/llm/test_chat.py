"""Chat formatting: exact round trips, the role machine, and conversations cut anywhere."""

import hashlib
import random

from hypothesis import given, settings, strategies as st

from tidewater.llm import chat

T = chat.Template()
PARTS = st.sampled_from(["\\", "#", "##", "###", " ", "</turn>", "<", "/turn>", ": ", ":", "User", "### User: ", "\n", "é", " </turn>\n", "a", ""])
TEXT = st.lists(PARTS, max_size=8).map("".join)
ROLE = st.sampled_from(["system", "user", "assistant", "", "tool", "a\\: b", ": ", "###", " </turn>\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_turns_are_read_back(turns):
    out, spans = "", []
    for role, text in turns:
        for s, loss in T.segments(role, text):
            if loss:
                spans.append((len(out), len(out) + len(s)))
            out += s
    assert [(role, chat.unescape(out[a:b])) for role, a, b in T.read(out)] == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def wanted(rows):
    groups = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: [(v is not None, v) for v in (r[0], r[1])] + [r[2] or "", (r[3] or "").encode()]):
        groups.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        size = sum(len(s) for r, t in turns for s, _ in T.segments(r, t))
        state = "start"
        for r, _ in turns:
            state = T.step(state, r)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), size, state == "assistant")
    return out


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "_CHUNK", 60)
    r = random.Random(4)
    rows = [(c, k, r.choice(["user", "assistant", "system"]) if c % 3 else ["user", "assistant"][k % 2], f"text {c} {k} \\ ### </turn>\n" * r.randrange(3))
            for c in range(30) for k in range(r.randrange(1, 7))]
    rows += [(99, k, ["user", "assistant"][k % 2], f"long {k}") for k in range(800)]  # one conversation over many ranges
    rows += [(None, 0, "user", None), (None, None, None, "x"), (40, 1, "user", "same"), (40, 1, "user", "same"), (40, 1, "user", "b"), (40, 0, "assistant", "z" * 5000), (41, 0, "system", "")]
    r.shuffle(rows)
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "conv_id long, turn long, role string, text string, part string, chunk int")
    got = {x.conv_id: tuple(x)[1:] for x in chat.read_back(chat.format_conversations(table.repartition(5))).collect()}
    assert got == wanted(rows)
    assert got[99][-1] and not got[41][-1]


def test_segments_of_turns(spark):
    rows = [(1, 0, "user", "hi ###"), (1, 1, "assistant", "yo")]
    got = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn", "segment").collect()
    assert [(r.text, r.loss) for r in got] == [("### User: ", False), ("hi \\###", False), (" </turn>\n", False), ("### Assistant: ", False), ("yo", True), (" </turn>\n", False)]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0 and chat.format_turns(none).count() == 0
