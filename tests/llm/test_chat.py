"""Layouts, escaping and the read-back of formatted conversations."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import chat

PARTS = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|im_end|>\n", "<|im_start|>", "\\", "\n",
         "<", "[", "s>", "/INST]", "a", "é", "😀", " ", "$0", "\\1"]
SCHEMA = "conv_id long, turn long, role string, text string"


def digests(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in sorted(t)).encode()).hexdigest(),
                sum(len(x) for _, r, x in t if r == "assistant"),
                hashlib.sha256("".join(x for _, r, x in sorted(t) if r == "assistant").encode()).hexdigest())
            for c, t in out.items()}


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "too\nl<s>\\", None]),
             rng.choice([None, "".join(rng.choices(PARTS, k=rng.randrange(12)))]))
            for c in [*range(60), None] for t in range(rng.randrange(1, 6))]
    rows.append((5, None, "user", "no number"))
    rows.append((7, 0, "assistant", "x" * 200_000))
    rows = [r for r in rows if r[:2] != (7, 0) or len(r[3] or "") > 100_000]
    turns = chat.canonical_turns(spark.createDataFrame(rows, SCHEMA))
    pieces = chat.format_turns(turns)
    for p in pieces.collect():
        body = p.piece.removeprefix(chat.START).removesuffix(chat.END)
        assert not any(x in body for x in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_"))
    back = chat.read_turns(pieces)
    got = chat.conversation_digests(back).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in got} == digests(rows)
    assert sum(r.formatted_chars for r in got) == sum(len(p.piece) for p in pieces.collect())


def test_empty(spark):
    none = chat.canonical_turns(spark.createDataFrame([], SCHEMA))
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(none))).count() == 0


LAYOUT_ROWS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"prompt": "q", "completion": "a"},
    {"prompt": "q", "response": "a", "score": 1},
    {"instruction": "q", "output": "a"},
    {"question": "q", "answer": "a", "meta": {"messages": "clash"}},
]


def test_mixed_layouts(spark):
    values = [json.dumps(r) for r in LAYOUT_ROWS]
    extra = [json.dumps({"instruction": "i", "input": "n", "output": "o"}), json.dumps({"x": 1}), "not json", None,
             json.dumps({"messages": []})]
    rows = spark.createDataFrame(list(enumerate([*values, *extra])), "id long, body string")
    turns, rest = chat.canonical_turns_json(rows, "id", "body")
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for i in range(len(values)):
        assert got[i] == [("user", "q"), ("assistant", "a")]
    assert got[6] == [("user", "i"), ("user", "n"), ("assistant", "o")]
    assert sorted(r.conv_id for r in rest.collect()) == [7, 8, 9, 10]


def test_table_layouts(spark):
    nested = spark.read.json(spark.sparkContext.parallelize([json.dumps(LAYOUT_ROWS[1] | {"id": 4, "role": "x"})]))
    assert [(r.role, r.text) for r in chat.canonical_turns(nested, "id").orderBy("turn").collect()] == [
        ("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(spark.createDataFrame([(1, "a")], "id long, other string"), "id")


@settings(max_examples=100, deadline=None)
@given(st.permutations(["b[].x", "a", "c.d"]))
def test_fingerprint_ignores_order(paths):
    assert chat.fingerprint(tuple(paths)) == chat.fingerprint(("a", "b[].x", "c.d"))


def test_long_roles_and_line_breaks_in_roles(spark):
    roles = ["r" * 1_000_000, "a\nb", "\\n", "\\\\n", "\\\n", "\n\n\\", "n\\", "\\\\\nn", "</s>\n[INST]", "\\" * 3_000 + "\n"]
    rows = [(1, i, r, f"text {i}\n\\") for i, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.role, r.text) for r in chat.read_turns(chat.format_turns(turns)).collect()}
    assert got == {t: (role, text) for _, t, role, text in rows}


def test_large_ids_next_to_null_ids(spark):
    rows = [(None, 0, "user", "x"), (2**60 + 1, 0, "user", "a"), (2**60 + 2, 0, "user", "b"), (2**53 + 1, 0, "user", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.conversation_digests(chat.read_turns(chat.format_turns(turns))).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(c, 1) for c, *_ in rows}
