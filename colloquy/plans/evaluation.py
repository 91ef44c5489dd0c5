"""Running predictors over labelled rows and scoring them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.answers import read_score
from colloquy.functions.context import has_context
from colloquy.functions.rules import labelled
from colloquy.functions.text import rating
from colloquy.operators import metrics as mt
from colloquy.operators.inference import Call, Responder, ResponseTable, answer
from colloquy.operators.predictors import Predictor, choose
from colloquy.operators.sampling import first_rows, sample_rows
from colloquy.plans.agent import classify
from colloquy.plans.prompts import Templates, render

# Fixed value.
JUDGE_SEED = 42


def evaluation_rows(test: DataFrame, all_labelled: DataFrame | None = None) -> DataFrame:
    """Rows with a label, from the full labelled table when there is one."""
    rows = all_labelled if all_labelled is not None else test
    return rows.where(labelled(F.col("intent")))


def run_system(name: str, predictors: Mapping[str, Predictor], rows: DataFrame) -> DataFrame:
    """Predictions next to the labels, with defaults where a predictor is silent."""
    answers = choose(predictors, name)(rows).select(
        "thread_id",
        F.coalesce("intent", F.lit("other")).alias("pred_intent"),
        F.coalesce("decision", F.lit("auto")).alias("pred_decision"),
        F.coalesce("reply", F.lit("")).alias("pred_reply"),
        F.coalesce("reason", F.lit("")).alias("pred_reason"))
    truth = rows.select(
        "thread_id", "customer_text", F.col("intent").alias("true_intent"),
        F.col("should_escalate").alias("true_escalate"),
        F.col("reply_quality").alias("human_quality"))
    return truth.join(answers, "thread_id").withColumn("system", F.lit(name))


def judge(df: DataFrame, respond: Responder, reply: str, *, out: str = "judge_score",
          templates: Templates = Templates(), cache: ResponseTable | None = None,
          call: Call = Call()) -> DataFrame:
    """Adds the judge's score of each reply."""
    prompt = render(templates.judge, text=F.col("customer_text"), reply=F.col(reply))
    told = answer(df.withColumn("_prompt", prompt), "_prompt", respond, out="_raw",
                  call=replace(call, system=templates.judge_system), cache=cache)
    return told.withColumn(out, read_score(F.col("_raw"))[0]).drop("_prompt", "_raw")


def score_systems(preds: DataFrame) -> DataFrame:
    """One row per ``system``: intent accuracy and macro-F1, escalation metrics."""
    intent = mt.intent_metrics(preds, "true_intent", "pred_intent", ["system"]).select(
        "system", F.col("accuracy").alias("intent_accuracy"),
        F.col("macro_f1").alias("intent_macro_f1"))
    escalation = mt.escalation_metrics(preds, by=["system"]).select(
        "system", *[F.col(c).alias(f"escalation_{c}")
                    for c in ("accuracy", "precision", "recall", "f1")])
    return intent.join(escalation, "system", "left")


def judge_mean(preds: DataFrame, respond: Responder, n: int | None = None,
               seed: int = JUDGE_SEED, **options: object) -> DataFrame:
    """One row: ``judge_mean_score`` over one system's replies, or over a sample of ``n``."""
    chosen = preds if n is None else sample_rows(preds, n, seed, "thread_id")
    rows = judge(chosen, respond, "pred_reply", **options)
    return rows.agg(F.avg("judge_score").alias("judge_mean_score"))


def judge_calibration(rated: DataFrame, respond: Responder, n: int | None = None,
                      **options: object) -> DataFrame:
    """One row: agreement of judge and human on the same replies, null where undefined.

    All rated rows count, or the first ``n`` by id. The historical reply is judged if the
    column is there, else the predicted one. One aggregation gives all figures.
    """
    quality = F.col("reply_quality").cast("string")
    rows = rated.where(labelled(quality))
    if n:
        rows = first_rows(rows, n, "thread_id")
    rows = rows.withColumn("human", rating(F.col("reply_quality"))).where("human is not null")
    reply = "brand_reply" if "brand_reply" in rated.columns else "pred_reply"
    return mt.agreement(judge(rows, respond, reply, **options), "judge_score", "human").select(
        F.col("n").alias("judge_calibration_n"), F.col("kappa").alias("judge_human_kappa"),
        F.col("pearson_r").alias("judge_human_pearson_r"), "within_one", "mean_offset")


def summary(scores: DataFrame) -> DataFrame:
    """``(metric, <one column per system>)``."""
    return mt.long_metrics(scores, "system").groupBy("metric").pivot("system").agg(
        F.first("value"))


def with_contexts(golden: DataFrame, threads: DataFrame) -> DataFrame:
    """Golden rows with the prior turns of their thread."""
    return golden.join(threads.select("thread_id", "prior_context"), "thread_id", "left")


def context_ablation(golden: DataFrame, threads: DataFrame, respond: Responder,
                     **options: object) -> DataFrame:
    """One row comparing the classifier with and without prior turns on the same rows.

    Both variants go through one classification pass.
    """
    rows = with_contexts(golden.where(labelled(F.col("intent"))).withColumnRenamed(
        "intent", "truth"), threads)
    some = rows.where(has_context(F.col("prior_context")))
    none = F.lit(None).cast(rows.schema["prior_context"].dataType)
    modes = some.select("thread_id", "customer_text", "truth", "prior_context",
                        F.explode(F.array(F.lit("with"), F.lit("without"))).alias("mode"))
    modes = modes.withColumn("prior_context", F.when(F.col("mode") == "with",
                                                     F.col("prior_context")).otherwise(none))
    told = classify(modes, respond, **options).select("truth", "mode", F.col("intent").alias("pred"))
    left_out = rows.agg(F.count_if(~has_context(F.col("prior_context")))
                        .alias("n_without_context"))
    return mt.compare_modes(told).crossJoin(left_out)  # one row each
