import time

from pyspark.sql import functions as F

from colloquy.operators.turns import rolling_buffer
from colloquy.streaming.live import label_messages, live_buffer, run_until_idle

SCHEMA = "conv_id long, turn long, role string, text string"


def run(stream, spark, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.table(name)


def test_live_buffer_equals_the_batch_buffer(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}:{t}")
            for c in range(3) for t in range(9)]
    table = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        (table.where(F.floor(F.col("turn") / 3) == part).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "turns")))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "turns"))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    run_until_idle(live_buffer(stream), out, marks)
    got = {(r.conv_id, r.turn): [b.text for b in r.buffer] for r in spark.read.parquet(out).collect()}
    batch = rolling_buffer(table, "conv_id", "turn", "text").collect()
    assert got == {(r.conv_id, r.turn): [b.text for b in r.buffer] for r in batch}


def test_rules_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "user", "refund @12"), (1, 1, "user", "hi")], SCHEMA)
    df.write.parquet(str(tmp_path / "m"))
    stream = label_messages(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "m")))
    got = {r.turn: (r.redacted, r.intent, r.decision) for r in run(stream, spark, "rules").collect()}
    assert got == {0: ("refund @USER", "billing_subscription", "escalate"), 1: ("hi", "other", "auto")}


def test_a_quiet_conversation_begins_anew(spark, tmp_path):
    """Two runs of one stream with a pause longer than the time to live between them."""
    def go(idle_ms, name):
        path, marks, out = (str(tmp_path / name / x) for x in ("turns", "marks", "out"))
        for turn in range(2):
            spark.createDataFrame([(1, turn, "user", f"t{turn}")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
            stream = live_buffer(spark.readStream.schema(SCHEMA).parquet(path), idle_ms=idle_ms)
            run_until_idle(stream, out, marks)
            time.sleep(2)
        return {r.turn: [b.text for b in r.buffer] for r in spark.read.parquet(out).collect()}

    assert go(3_600_000, "long") == {0: [], 1: ["t0"]}
    assert go(500, "short") == {0: [], 1: []}
