"""Chat formatting: round trips through the formatted text, the state machine, and the spans under the loss."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, loss boolean, part string"
MARKS = chat.Template().marks()


def turns_digest(rows):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()


def conversations():
    rnd = random.Random(5)
    bits = [*MARKS, "\\", "<", "[", "</", "s>", "INST]", "é", " ", "\n", "ok", "<\\/s>"]
    out = []
    for conv in [1, 2, 3, None]:
        for turn in range(rnd.randint(1, 9)):
            out.append((conv, turn, ["user", "assistant", "system", "tool </s>", None][rnd.randrange(5)], "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))))
    out += [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * (i % 3)) for i in range(2500)]  # over many batches
    out += [(8, 0, "user", "x" * 200_000), (8, 1, "assistant", None), (9, None, "user", "late"), (9, None, "user", "late"), (9, 0, "assistant", "[INST")]
    return out


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, True, "p") for r in rows], SCHEMA)
    parts = chat.segments(df)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    forms = {r.conv_id: r for r in chat.rendered(parts).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == set(forms) == convs
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = [(r[2], r[3]) for r in own]
        assistant = "".join(t or "" for r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), turns_digest(said))
        assert (r.loss_chars, r.loss_sha256) == (len(assistant), hashlib.sha256(assistant.encode()).hexdigest())
        form = forms[conv]
        assert r.formatted_chars == len(form.formatted)
        assert "".join(chat.unescaped(form.formatted[s.start : s.end]) for s in form.spans) == assistant
        reader = chat.Reader(chat.Template())
        reader.feed(form.formatted, False)
        assert reader.result()[:2] == (len(said), turns_digest(said))


def test_order_of_roles(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (2, 2, "user", "u"), (3, 0, "user", "u"), (4, 0, "tool", "t")]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    errors = {(r.conv_id, r.turn_no): r.error for r in parts.filter("error is not null").collect()}
    assert errors == {(2, 0): "assistant after start", (2, 2): "user after user", (4, 0): "tool after start"}
    state = {r.conv_id: (r.valid, r.complete) for r in chat.rendered(parts).collect()}
    assert state == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)}
    flags = {(r.role, r.part): r.loss for r in parts.filter("conv_id = 1 and turn_no >= 0").collect()}
    assert [k for k, x in flags.items() if x] == [("assistant", 1)]


def test_templates(spark):
    other = chat.Template(begin="<|go|>", turns={"q": ("<|q|>", "<|end q|>"), "a": ("<|a|>", "<|eos|>")}, other=("<|role|>", "<|text|>", "<|end|>"), loss=frozenset({"a"}), follows={"start": frozenset({"q"}), "q": frozenset({"a"}), "a": frozenset({"q"})}, final=frozenset({"a"}), loss_close=True)
    parts = chat.segments(spark.createDataFrame([(1, 0, "q", "<|a|>"), (1, 1, "a", "<|eos|>x")], "conv_id int, turn long, role string, text string"), other)
    row = chat.read_back(parts, other).first()
    assert (row.n_turns, row.turns_sha256, row.loss_chars) == (2, turns_digest([("q", "<|a|>"), ("a", "<|eos|>x")]), 8)
    for bad in (("ab", "bc"), ("a", "cd"), ("x\\y", "cd"), ("xyz", "y")):
        with pytest.raises(ValueError):
            chat.Template(begin="<s>", turns={"q": bad})
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.segments(none).count() == chat.read_back(chat.segments(none)).count() == chat.rendered(chat.segments(none)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*MARKS, "\\", "<", "/s>", "[", "INST]"]), st.text(max_size=3)), max_size=12).map("".join))
def test_escapes(text):
    hidden = text.replace("\\", "\\\\")
    for m in MARKS:
        hidden = hidden.replace(m, m[0] + "\\" + m[1:])
    assert not any(m in hidden for m in MARKS) and chat.unescaped(hidden) == text


def test_contract_row(spark, tmp_path):
    spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op12_chat(spark, str(tmp_path)).collect()}
    hard = "</s>[INST] ok [/INST]"
    assert set(got) == {0, -1}
    assert (got[-1].turns_sha256, got[-1].loss_sha256, got[-1].loss_chars) == (turns_digest([("user", hard), ("assistant", hard)]), hashlib.sha256(hard.encode()).hexdigest(), 21)
    assert (got[0].turns_sha256, got[0].loss_chars) == (turns_digest([("user", "hi"), ("assistant", "")]), 0)
