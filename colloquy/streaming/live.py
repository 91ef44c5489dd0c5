"""Live conversations: rules on a stream, and the rolling buffer as keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.rules import (ESCALATION_WORDS, INTENT_PATTERNS, escalation_by_keyword,
                                      first_match)
from colloquy.functions.text import redact_handles
from colloquy.operators.turns import BUFFER_TURNS

_TURN = "struct<role string, text string>"
STATE = "role string, text string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 24 * 3600 * 1000  # a conversation that is quiet for a day begins anew


def label_messages(messages: DataFrame, text: str = "text",
                   rules: Mapping[str, Sequence[str]] = INTENT_PATTERNS,
                   words: Sequence[str] = ESCALATION_WORDS) -> DataFrame:
    """Adds the redacted text, keyword intent, decision and reason; keeps no state."""
    decision, reason = escalation_by_keyword(F.lower(text), words)
    return messages.withColumns({
        "redacted": redact_handles(F.col(text)),
        "intent": F.coalesce(first_match(F.col(text), rules), F.lit("other")),
        "decision": decision,
        "reason": reason,
    })


class LastTurns(StatefulProcessor):
    """The last turns of one conversation as list state that a quiet conversation loses."""

    def __init__(self, size: int, idle_ms: int) -> None:
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", STATE, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [{"role": r, "text": x} for r, x in self.turns.get()] if self.turns.exists() else []
        table = pd.concat(list(rows)).sort_values("turn", kind="stable", na_position="first")
        buffers = []
        for role, text in zip(table["role"], table["text"], strict=True):
            buffers.append(list(held))
            held = [*held, {"role": role, "text": text}][-self.size:]
        self.turns.put([(t["role"], t["text"]) for t in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield table[["turn", "role", "text"]].assign(conv_id=key[0], buffer=buffers)[
            ["conv_id", "turn", "role", "text", "buffer"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_buffer(turns: DataFrame, size: int = BUFFER_TURNS, idle_ms: int = IDLE_MS) -> DataFrame:
    """``conv_id, turn, role, text, buffer`` for a stream of ``conv_id, turn, role, text``.

    State is the last ``size`` turns of a conversation, kept until ``idle_ms`` milliseconds
    pass without a turn: a timer clears them, and their time to live runs out in the store.
    Turns of one conversation must arrive in order, except within a micro-batch. The session
    is set to the state store that this kind of state needs.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return turns.groupBy("conv_id").transformWithStateInPandas(
        LastTurns(size, idle_ms), f"conv_id long, turn long, role string, text string, buffer array<{_TURN}>",
        "append", "ProcessingTime")


def run_until_idle(rows: DataFrame, path: str, marks: str, pause: float = 0.2) -> None:
    """Writes a stream to Parquet until two micro-batches in a row find no new input.

    A query with timers always has another batch to run, so it never ends by itself.
    """
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).start()
    try:
        while query.isActive:
            last = [p["numInputRows"] for p in query.recentProgress[-2:]]
            if last == [0, 0]:  # the first batch after a restart may repeat an empty one
                return
            time.sleep(pause)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
