"""Batch agent: classify, draft from similar cases, decide whether to escalate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.answers import read_decision, read_intent
from colloquy.functions.context import context_block, shortened, tried_steps
from colloquy.functions.text import strip
from colloquy.operators.inference import Call, Responder, ResponseTable, answer
from colloquy.operators.predictors import Predictor
from colloquy.operators.vector_topk import vector_topk
from colloquy.plans.prompts import Templates, render, section
from colloquy.schema import INTENTS
from colloquy.session import materialise

EXAMPLES = 3


def _block(turns: Column, t: Templates) -> Column:
    return context_block(turns, t.brand_role, t.context_turns, t.turn_chars)


def classify_prompt(text: Column, turns: Column, t: Templates) -> Column:
    block = _block(turns, t)
    return render(t.classify, context=section(t.context, block), text=text)


def draft_prompt(text: Column, intent: Column, turns: Column, examples: Column,
                 t: Templates) -> Column:
    return render(
        t.draft, intent=intent, text=text, examples=examples,
        context=section(t.context, _block(turns, t)),
        tried=section(t.tried, tried_steps(turns, t.tried_chars)))


def decide_prompt(text: Column, intent: Column, draft: Column, turns: Column,
                  t: Templates) -> Column:
    block = _block(turns, t)
    return render(t.decide, intent=intent, context=section(t.context, block), text=text, draft=draft)


def classify(df: DataFrame, respond: Responder, *, templates: Templates = Templates(),
             intents: Sequence[str] = INTENTS, cache: ResponseTable | None = None, call: Call = Call()) -> DataFrame:
    """Adds ``intent``, ``confidence`` and ``had_context``."""
    turns = F.col("prior_context")
    asked = df.withColumn("_prompt", classify_prompt(F.col("customer_text"), turns, templates))
    told = answer(asked, "_prompt", respond, out="_raw", cache=cache,
                  call=replace(call, system=templates.classify_system))
    intent, confidence = read_intent(F.col("_raw"), intents)
    return told.withColumns({
        "intent": intent, "confidence": confidence,
        "had_context": _block(turns, templates) != "",
    }).drop("_prompt", "_raw")


def similar_cases(df: DataFrame, cases: DataFrame, *, k: int = EXAMPLES,
                  templates: Templates = Templates(), exclude_self: bool = False) -> DataFrame:
    """``(thread_id, sources, examples)``: ids and texts of the k nearest cases, best first.

    Both sides carry an ``embedding``; ``cases`` also the texts.
    """
    # Written once: prompts are built from it twice, to be asked and to be joined back.
    hits = materialise(vector_topk(
        df.select("thread_id", "embedding"), cases.select("thread_id", "embedding"), k=k,
        query_id="thread_id", corpus_id="thread_id", exclude_self=exclude_self), "hits")
    texts = cases.select(
        F.col("thread_id").alias("neighbour_id"),
        shortened(F.col("customer_text"), templates.example_chars).alias("customer"),
        shortened(F.col("brand_reply"), templates.example_chars).alias("reply"))
    listed = (
        hits.join(texts.hint("merge"), "neighbour_id")  # texts outgrow their files in memory
        .groupBy(F.col("query_id").alias("thread_id"))
        .agg(F.array_sort(F.collect_list(
            F.struct("rank", "neighbour_id", "customer", "reply"))).alias("hits"))
    )
    lines = F.transform("hits", lambda h: render(
        templates.example, n=h["rank"].cast("string"), customer=h["customer"],
        role=F.lit(templates.brand_role), reply=h["reply"]))
    return listed.select("thread_id", F.col("hits.neighbour_id").alias("sources"),
                         F.array_join(lines, "\n\n").alias("examples"))


def draft(df: DataFrame, cases: DataFrame, respond: Responder, *, k: int = EXAMPLES,
          templates: Templates = Templates(), cache: ResponseTable | None = None, call: Call = Call(),
          exclude_self: bool = False) -> DataFrame:
    """Adds ``reply`` and ``sources``."""
    found = similar_cases(df, cases, k=k, templates=templates, exclude_self=exclude_self)
    none = F.array().cast(found.schema["sources"].dataType)
    rows = df.join(found, "thread_id", "left").withColumn(
        "sources", F.coalesce("sources", none))
    asked = rows.withColumn("_prompt", draft_prompt(
        F.col("customer_text"), F.col("intent"), F.col("prior_context"), F.col("examples"),
        templates))
    told = answer(asked, "_prompt", respond, out="_raw", cache=cache,
                  call=replace(call, system=templates.draft_system))
    return told.withColumn("reply", strip(F.col("_raw"))).drop("_prompt", "_raw", "examples")


def decide(df: DataFrame, respond: Responder, *, templates: Templates = Templates(),
           cache: ResponseTable | None = None, call: Call = Call()) -> DataFrame:
    """Adds ``decision`` and ``reason``."""
    asked = df.withColumn("_prompt", decide_prompt(
        F.col("customer_text"), F.col("intent"), F.col("reply"), F.col("prior_context"),
        templates))
    told = answer(asked, "_prompt", respond, out="_raw", cache=cache,
                  call=replace(call, system=templates.decide_system))
    decision, reason = read_decision(F.col("_raw"), templates.reason_chars)
    return told.withColumns({"decision": decision, "reason": reason}).drop("_prompt", "_raw")


def run_agent(df: DataFrame, cases: DataFrame, respond: Responder, *, k: int = EXAMPLES,
              templates: Templates = Templates(), intents: Sequence[str] = INTENTS,
              cache: ResponseTable | None = None, call: Call = Call(), use_context: bool = True,
              exclude_self: bool = False) -> DataFrame:
    """``thread_id, customer_text, had_context, intent, confidence, reply, sources, decision,
    reason`` for rows with ``thread_id, customer_text, prior_context, embedding``."""
    if not use_context:
        df = df.withColumn("prior_context", F.lit(None).cast(df.schema["prior_context"].dataType))
    rows = materialise(classify(df, respond, templates=templates, intents=intents, cache=cache,
                                call=call),
                       "classified")
    rows = materialise(draft(rows, cases, respond, k=k, templates=templates, cache=cache,
                             call=call, exclude_self=exclude_self), "drafted")
    return decide(rows, respond, templates=templates, cache=cache, call=call).select(
        "thread_id", "customer_text", "had_context", "intent", "confidence", "reply", "sources",
        "decision", "reason")


def agent_predictor(cases: DataFrame, respond: Responder, **options: object) -> Predictor:
    return lambda df: run_agent(df, cases, respond, **options)
