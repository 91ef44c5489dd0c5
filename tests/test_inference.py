import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from colloquy.operators import inference as inf
from colloquy.plans import evaluation as ev
from colloquy.plans.agent import run_agent
from colloquy.plans.prompts import Templates, render, section
from colloquy.schema import CACHE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CTX = "array<struct<author string, text string, inbound boolean>>"


def shout(prompts, call):
    return [p.upper() for p in prompts]


def test_equal_requests_are_sent_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(prompts, call):
        calls.add(len(prompts))
        return shout(prompts, call)

    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "i int, p string")
    got = inf.answer(df, "p", counted, parallel_calls=2).collect()
    assert {(r["p"], r["answer"]) for r in got} == {("a", "A"), ("b", "B")} and len(got) == 20
    assert calls.value == 2


def test_cached_answers_are_not_asked_again(spark, tmp_path):
    cache = inf.ResponseTable(spark, str(tmp_path / "cache"))
    assert cache.stats().first().asDict() == {"entries": 0, "size_kb": 0.0}
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, p string")
    inf.answer(df.where("i = 1"), "p", shout, cache=cache).count()
    calls = spark.sparkContext.accumulator(0)

    def counted(prompts, call):
        calls.add(len(prompts))
        return ["é"] * len(prompts)

    got = {r["i"]: r["answer"] for r in inf.answer(df, "p", counted, cache=cache).collect()}
    assert got == {1: "X", 2: "X", 3: "é"} and calls.value == 1
    assert cache.stats().first()["entries"] == 2
    other = inf.answer(df, "p", counted, cache=cache, call=inf.Call(model="other")).first()
    assert other["answer"] == "é"


def test_key_is_sha256_of_a_json_list(spark):
    import hashlib
    key = spark.range(1).select(inf.request_key("b", "m", "s", F.lit('q"é'))).first()[0]
    raw = json.dumps(["b", "m", "s", 'q"é'], ensure_ascii=False, separators=(",", ":"))
    assert key == hashlib.sha256(raw.encode()).hexdigest()


def test_cache_size(spark):
    df = spark.createDataFrame([("k", "é" * 600), ("l", None)], CACHE)
    assert inf.cache_stats(df).first().asDict() == {"entries": 2, "size_kb": 1.2}


def test_busy_models_are_asked_again():
    waits, errors = [], [inf.ModelBusy(), inf.ModelBusy(wait=1.5), inf.ModelBusy()]

    def flaky(prompts, call):
        if errors:
            raise errors.pop(0)
        return [None]

    assert inf.ask(flaky, ["p"], inf.Call(), sleep=waits.append) == [("", None)]
    assert waits == [1.0, 1.5, 4.0]
    waits.clear()

    def busy(prompts, call):
        raise inf.ModelBusy

    assert inf.ask(busy, ["p"], inf.Call(), inf.Backoff(0.5, 2), waits.append)[0][0] is None
    assert waits == [0.5, 1.0]
    own = inf.ask(busy, ["p"], inf.Call(), lambda error, tried: 7.0 if tried < 1 else None, waits.append)
    assert own[0][1].startswith("ModelBusy") and waits[2:] == [7.0]


def broken(prompts, call):
    if "bad" in prompts:
        raise RuntimeError("could not generate an answer")
    return [p.upper() for p in prompts]


def test_one_failing_prompt_costs_no_other_answer(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "p string")
    cache = inf.ResponseTable(spark, str(tmp_path / "cache"))
    with pytest.raises(RuntimeError, match="could not generate"):
        inf.answer(df, "p", broken, cache=cache)
    assert sorted(r.response for r in cache.read().collect()) == ["A", "B"]
    got = {r.p: (r.answer, r.answer_error) for r in inf.answer(
        df, "p", broken, cache=cache, keep_errors=True).collect()}
    assert got["a"] == ("A", None) and got["bad"] == (None, "RuntimeError: could not generate an answer")


def test_the_model_gets_its_call(spark, tmp_path):
    def tell(prompts, call):
        return [f"{call.system}/{call.model}/{call.temperature}" for _ in prompts]

    df = spark.createDataFrame([("p",)], "p string")
    cache = inf.ResponseTable(spark, str(tmp_path / "cache"))
    calls = [inf.Call("s"), inf.Call("t"), inf.Call("s", model="m"), inf.Call("s", temperature=0.5)]
    got = [inf.answer(df, "p", tell, cache=cache, call=c).first()["answer"] for c in calls]
    assert got == ["s/rules/None", "t/rules/None", "s/m/None", "s/rules/0.5"]
    assert cache.stats().first()["entries"] == 4


def test_render(spark):
    row = spark.range(1).select(
        render("a {x} b{y}", x=F.lit("1"), y=F.lit(None).cast("string")),
        section("<{block}>", F.lit("z")), section("<{block}>", F.lit(""))).first()
    assert tuple(row) == ("a 1 b", "<z>", "")


def model(prompts, call):
    out = []
    for p in prompts:
        intent = "hardware_device" if "broken" in p else "other"
        out.append(json.dumps({"intent": intent, "decision": "escalate" if "broken" in p else "auto",
                               "reason": "r", "score": 4}))
    return out


@pytest.fixture(scope="module")
def threads(spark):
    rows = [("1", "screen broken", "we fix it", [], [1.0, 0.0]),
            ("2", "still not", "sorry", [("u", "my pad is broken", True),
                                         ("b", "please restart the console now", False)], [0.9, 0.1]),
            ("3", "thanks", "welcome", None, [0.0, 1.0])]
    return spark.createDataFrame(
        rows, f"thread_id string, customer_text string, brand_reply string, prior_context {CTX}, "
              "embedding array<float>")


def test_agent(spark, threads):
    got = {r["thread_id"]: r for r in run_agent(threads, threads, model, k=2,
                                                exclude_self=True).collect()}
    assert {i: r["intent"] for i, r in got.items()} == {
        "1": "hardware_device", "2": "hardware_device", "3": "other"}
    assert {i: r["had_context"] for i, r in got.items()} == {"1": False, "2": True, "3": False}
    assert got["1"]["sources"] == ["2", "3"] and got["3"]["sources"] == ["2", "1"]
    assert got["1"]["confidence"] is None and got["1"]["reason"] == "r"
    alone = {r["thread_id"]: r for r in run_agent(threads, threads, model, use_context=False).collect()}
    assert alone["2"]["intent"] == "other" and alone["2"]["had_context"] is False


def test_prompts_carry_examples_and_tried_steps(spark, threads):
    seen = run_agent(threads, threads, lambda ps, call: list(ps), k=1, exclude_self=True).collect()
    reply = {r["thread_id"]: r["reply"] for r in seen}["2"]
    t = Templates()
    assert "Case 1:\n  Customer: screen broken\n  Support: we fix it" in reply
    assert t.tried.format(block="  - please restart the console now") in reply
    assert "  Customer: my pad is broken\n  Support: please restart" in reply


def test_ablation(spark):
    rows = [(str(i), "still not", "hardware_device", "yes", "4") for i in range(6)] + [
        ("9", "hello", "other", "no", "4")]
    golden = spark.createDataFrame(
        rows, "thread_id string, customer_text string, intent string, should_escalate string, "
              "reply_quality string")
    threads = spark.createDataFrame([(str(i), [("u", "broken", True)]) for i in range(6)],
                                    f"thread_id string, prior_context {CTX}")
    got = ev.context_ablation(golden, threads, model).first().asDict()
    assert (got["n_with_context"], got["n_without_context"]) == (6, 1)
    assert (got["accuracy_with_context"], got["accuracy_no_context"]) == (1.0, 0.0)


def test_judge_calibration(spark):
    rows = [(f"{i:02d}", "broken", "reply", str(3 + i % 2)) for i in range(12)] + [
        ("98", "x", "y", ""), ("99", "x", "y", "n/a")]
    rated = spark.createDataFrame(
        rows, "thread_id string, customer_text string, brand_reply string, reply_quality string")
    got = ev.judge_calibration(rated, model).first().asDict()
    assert got["judge_calibration_n"] == 12 and got["judge_human_kappa"] == 0.0
    assert ev.judge_calibration(rated, model, n=11).first()["judge_calibration_n"] == 11
    assert ev.judge_calibration(rated, model, n=None).first()["judge_calibration_n"] == 12
    assert ev.judge_calibration(rated.limit(0), model).first()["judge_calibration_n"] == 0
    preds = rated.withColumn("pred_reply", F.lit("r"))
    assert ev.judge_mean(preds, model).first()[0] == 4.0


def test_look_ups_read_the_folders_of_their_keys(spark, tmp_path):
    table = inf.ResponseTable(spark, str(tmp_path / "r"))
    assert table.version() == 0 and table.read().count() == 0
    keys = [f"{i:02x}" + "0" * 62 for i in range(40)]
    table.append(spark.createDataFrame([(k, "b") for k in keys], "key string, response string"))
    table.append(spark.createDataFrame([(keys[0], "a"), (keys[1], "c")], "key string, response string"))
    asked = spark.createDataFrame([(keys[0],), (keys[1],), ("ff" + "0" * 62,)], "key string")
    rows = table.read(asked)
    assert sorted(map(tuple, rows.collect())) == [(keys[0], "a"), (keys[0], "b"), (keys[1], "b"), (keys[1], "c")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    table.compact()
    assert table.version() == 2 and table.read().count() == 40
    assert dict(map(tuple, table.read(asked).collect())) == {keys[0]: "a", keys[1]: "b"}
    assert len(list((tmp_path / "r" / "version=2").glob("prefix=*/*.parquet"))) == 40


def test_a_lost_run_resumes_behind_its_last_commit(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"prompt {i}",) for i in range(60)], "text string")
    table, log = inf.ResponseTable(spark, str(tmp_path / "r")), tmp_path / "asked"
    path = str(log)

    def respond(prompts, call):
        with open(path, "a") as file:
            file.writelines(f"{p}\n" for p in prompts)
        return [p.upper() for p in prompts]

    call_model, parts = inf.call_model, []

    def lost(*args, **options):
        parts.append(1)
        if len(parts) == 3:
            raise RuntimeError("driver lost")
        return call_model(*args, **options)

    monkeypatch.setattr(inf, "call_model", lost)
    with pytest.raises(RuntimeError):
        inf.answer(rows, "text", respond, cache=table, commit_rows=10)
    committed = table.read().count()
    assert 0 < committed < 60 and len(log.read_text().splitlines()) == committed
    got = inf.answer(rows, "text", respond, cache=table, commit_rows=10).collect()
    assert sorted(r.answer for r in got) == sorted(f"PROMPT {i}" for i in range(60))
    asked = log.read_text().splitlines()
    assert len(asked) == 60 and len(set(asked)) == 60
