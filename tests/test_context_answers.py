import json

from pyspark.sql import functions as F

from colloquy.functions import answers as an
from colloquy.functions import context as cx
from colloquy.operators.turns import rolling_buffer
from colloquy.schema import INTENTS

CTX = "i int, c array<struct<author string, text string, inbound boolean>>"


def blocks(spark, turns):
    df = spark.createDataFrame([(1, turns)], CTX)
    c = F.col("c")
    return df.select(cx.context_block(c, "Shop"), cx.tried_steps(c), cx.has_context(c)).first()


def test_no_turns(spark):
    assert tuple(blocks(spark, [])) == ("", "", False)
    assert tuple(blocks(spark, None)) == ("", "", False)


def test_last_four_turns_and_roles(spark):
    turns = [("a", f"t{i}", i % 2 == 0) for i in range(5)]
    assert blocks(spark, turns)[0] == "  Shop: t1\n  Customer: t2\n  Shop: t3\n  Customer: t4"
    assert blocks(spark, turns[:1])[0] == "  Customer: t0"
    assert blocks(spark, [("a", "x" * 181, None)])[0] == "  Customer: " + "x" * 181
    row = spark.createDataFrame([(1, [("a", "x" * 9, None)] * 5)], CTX).select(
        cx.context_block(F.col("c"), "Shop", None, 3), cx.context_block(F.col("c"), "Shop", 2)).first()
    assert row[0].count("xxx") == 5 and "xxxx" not in row[0] and row[1].count("x" * 9) == 2


def test_tried_steps_look_at_all_turns(spark):
    turns = [("b", "y" * 21, False), ("b", "z" * 20, False), ("a", "w" * 30, True)]
    turns += [("a", "q", True)] * 5 + [("b", "v" * 200, False)]
    assert blocks(spark, turns)[1] == "  - " + "y" * 21 + "\n  - " + "v" * 200


def parse(spark, raws, f):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [tuple(r) for r in df.orderBy("i").select(*f(F.col("raw"))).collect()]


def test_read_intent(spark):
    raws = ['{"intent": "game_content", "confidence": "high"}', ' {"intent": "nope"}\n', "{}",
            "Maybe OTHER or app_feature", "", None, '["game_content"]', '"enforcement_ban"',
            '{"intent": "other", "confidence": "low"} trailing']
    assert parse(spark, raws, lambda c: an.read_intent(c, INTENTS)) == [
        ("game_content", "high"), ("other", None), ("other", None), ("app_feature", "low"),
        ("other", "low"), ("other", "low"), ("game_content", "low"), ("enforcement_ban", "low"),
        ("other", "low")]


def test_read_decision(spark):
    long = "please Escalate " + "x" * 300
    raws = ['{"decision": "escalate", "reason": "r"}', '{"decision": "later"}', long, "", None]
    assert parse(spark, raws, an.read_decision) == [
        ("escalate", "r"), ("auto", None), ("escalate", long), ("auto", ""), ("auto", "")]


def test_read_score(spark):
    cases = [(4, 4), ("4", 4), (4.7, 4), (0, 1), (9, 5), (-3, 1), ("4.7", 3), ("x", 3), (True, 1)]
    raws = [json.dumps({"score": s, "reason": "why"}) for s, _ in cases]
    raws += ['{"reason": "none"}', '{"score": null}', "not json", None]
    out = parse(spark, raws, an.read_score)
    assert [s for s, _ in out] == [s for _, s in cases] + [3, 3, 3, 3]
    assert out[6][1] == out[7][1] == out[11][1] == "parse error"
    assert out[0][1] == "why" and out[9] == (3, "none")


def test_rolling_buffer_does_not_depend_on_chunks(spark):
    rows = [(c, t * gap, f"{c}-{t}") for c, gap in ((1, 1), (2, 7), (3, 40)) for t in range(30)]
    df = spark.createDataFrame(rows, "conv long, turn long, text string")
    want = {(c, t * gap): [f"{c}-{j}" for j in range(max(0, t - 6), t)]
            for c, gap in ((1, 1), (2, 7), (3, 40)) for t in range(30)}
    for chunk in (1, 4, 10, 1000):
        got = rolling_buffer(df.repartition(5), "conv", "turn", "text", chunk=chunk).collect()
        assert {(r.conv, r.turn): [b.text for b in r.buffer] for r in got} == want


def test_rolling_buffer_keeps_rows_with_null_keys(spark):
    rows = [(1, 0, "a"), (1, None, "b"), (None, 0, "c")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {r["text"]: len(r["buffer"]) for r in rolling_buffer(df, "conv_id", "turn", "text").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == 0
