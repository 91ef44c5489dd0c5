"""Batch calls of a text model from Spark tasks, with a response table.

The model is any function from a list of prompts and a ``Call`` (system text, model name and
settings) to a list of answers. Equal requests are sent once; answers are written down before
anything reads them, so a retried task downstream does not call the model again. A prompt that
fails for good becomes a row with its error: the answers to all other prompts are kept first.

With a response table, requests are asked in parts of a bounded size and each part's answers
are committed before the next one is asked, so a run that is lost resumes behind its last part.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.schema import CACHE
from colloquy.session import materialise, path_exists

CALL_BATCH = 64
COMMIT_ROWS = 100_000  # requests asked between two commits to the response table
PREFIX = 2  # leading hex digits of a key that name its folder
ANSWERED = T.StructType([*CACHE.fields, T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Call:
    """What goes to the model besides the prompt."""

    system: str = ""
    backend: str = "local"
    model: str = "rules"
    temperature: float | None = None
    max_tokens: int | None = None

    def key(self, prompt: Column) -> Column:
        """The cache key; settings count only where they are set."""
        options = {k: v for k, v in (("temperature", self.temperature), ("max_tokens", self.max_tokens))
                   if v is not None}
        return request_key(self.backend, self.model, self.system, prompt, options)


Responder = Callable[[list[str], Call], list[str]]
RetryAfter = Callable[[Exception, int], float | None]


class ModelBusy(Exception):
    """Raised by a model that can be asked again, after ``wait`` seconds if it says so."""

    def __init__(self, message: str = "busy", wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


def request_key(backend: str, model: str, system: str, prompt: Column,
                options: dict | None = None) -> Column:
    """SHA-256 of the request as a compact JSON list."""
    parts = [F.lit(backend), F.lit(model), F.lit(system), prompt]
    if options:
        parts.append(F.lit(json.dumps(options, sort_keys=True)))
    return F.sha2(F.to_json(F.array(*parts)), 256)


@dataclass(frozen=True)
class Backoff:
    """Doubling waits for a busy model, up to ``times`` further tries; other errors are final."""

    first: float = 1.0
    times: int = 5

    def __call__(self, error: Exception, tried: int) -> float | None:
        if not isinstance(error, ModelBusy) or tried >= self.times:
            return None
        return error.wait if error.wait is not None else self.first * 2.0 ** tried


def ask(respond: Responder, prompts: list[str], call: Call, retry_after: RetryAfter = Backoff(),
        sleep: Callable[[float], None] = time.sleep) -> list[tuple[str | None, str | None]]:
    """``(answer, error)`` per prompt; a batch that fails for good is asked one by one."""
    tried = 0
    while True:
        try:
            answers = respond(prompts, call)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(a if a is not None else "", None) for a in answers]
        except Exception as error:  # noqa: BLE001 - any failure of the caller's model
            wait = retry_after(error, tried)
            if wait is None:
                failure = f"{type(error).__name__}: {error}"
                break
        tried += 1
        sleep(wait)
    if len(prompts) == 1:
        return [(None, failure)]
    return [one for p in prompts for one in ask(respond, [p], call, retry_after, sleep)]


def call_model(requests: DataFrame, respond: Responder, call: Call = Call(), *,
               batch: int = CALL_BATCH, retry_after: RetryAfter = Backoff()) -> DataFrame:
    """``(key, response, error)`` for ``(key, prompt)`` rows, in Arrow batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                told = ask(respond, part["prompt"].tolist(), call, retry_after)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "response": [a for a, _ in told],
                                    "error": [e for _, e in told]}, dtype=object)

    return requests.select("key", "prompt").mapInPandas(run, ANSWERED)


@dataclass(frozen=True)
class ResponseTable:
    """Answers by request key, in folders by the leading digits of the key.

    A look-up reads only the folders of its keys. Commits append to the newest version of the
    table; ``compact`` writes the next version with one row a key and one file a folder, and
    readers change over once it is complete. Don't compact while a run appends.
    """

    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest complete version, 0 before the first commit."""
        n = 0
        while path_exists(self.spark, f"{self._folder(n + 1)}/_SUCCESS"):
            n += 1
        return n

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """``key, response`` of all answers, or of those whose folder one of ``keys`` is in."""
        n = self.version()
        if n == 0:
            return self.spark.createDataFrame([], CACHE)
        rows = self.spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CACHE)}, "
                                      "prefix string").parquet(self._folder(n))
        if keys is not None:
            wanted = keys.select(F.substring("key", 1, PREFIX).alias("p")).distinct().collect()  # 256 at most
            rows = rows.where(F.col("prefix").isin([r["p"] for r in wanted]))
        return rows.select(*CACHE.names)

    def append(self, answers: DataFrame) -> None:
        self._write(answers, max(1, self.version()))

    def _write(self, answers: DataFrame, version: int) -> None:
        (answers.select(*CACHE.names, F.substring("key", 1, PREFIX).alias("prefix")).repartition("prefix")
         .write.mode("append").partitionBy("prefix").parquet(self._folder(version)))

    def compact(self) -> None:
        """One row a key: of several answers the one that sorts first, as look-ups take it."""
        if n := self.version():
            self._write(self.read().groupBy("key").agg(F.min("response").alias("response")), n + 1)

    def stats(self) -> DataFrame:
        return cache_stats(self.read())


def cache_stats(responses: DataFrame) -> DataFrame:
    """One row: ``entries`` and ``size_kb``."""
    size = F.coalesce(F.sum(F.octet_length("response")), F.lit(0))
    return responses.agg(F.count(F.lit(1)).alias("entries"),
                         F.round(size / 1024, 1).alias("size_kb"))


def lookup(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of keyed requests; misses are distinct by key."""
    known = responses.select("key", "response")
    hits = requests.join(known, "key")
    misses = requests.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return hits, misses


def answer(
    df: DataFrame,
    prompt: str,
    respond: Responder,
    *,
    out: str = "answer",
    call: Call = Call(),
    cache: ResponseTable | None = None,
    parallel_calls: int | None = None,
    retry_after: RetryAfter = Backoff(),
    keep_errors: bool = False,
    commit_rows: int = COMMIT_ROWS,
) -> DataFrame:
    """Adds the model's answer to the prompt of each row.

    ``parallel_calls`` bounds how many tasks call the model at a time. Prompts that failed
    raise after all answers were stored, or with ``keep_errors`` get a null answer and their
    error in ``<out>_error``. Only the stored answers to these requests are read back; where a
    key was stored twice, the answer that sorts first counts.
    """
    keyed = df.withColumn("_key", call.key(F.col(prompt)))
    requests = materialise(keyed.select(F.col("_key").alias("key"), F.col(prompt).alias("prompt"))
                           .dropDuplicates(["key"]), "requests")
    stored = None
    if cache is not None:
        stored = materialise(cache.read(requests).join(requests.select("key"), "key", "left_semi")
                             .groupBy("key").agg(F.min("response").alias("response")), "stored")
    misses = requests if stored is None else requests.join(stored, "key", "left_anti")
    fresh = None
    parts = 1 if cache is None else max(1, -(-misses.count() // commit_rows))
    for part in range(parts):
        asked = misses.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else misses
        if parallel_calls:
            asked = asked.repartition(parallel_calls)
        told = materialise(call_model(asked, respond, call, retry_after=retry_after), "answers")
        if cache is not None:
            cache.append(told.where("error is null"))
        fresh = told if fresh is None else fresh.unionByName(told)
    if not keep_errors:
        failed = fresh.where("error is not null").select("error").limit(1).collect()
        if failed:
            raise RuntimeError(f"the model failed on some prompts: {failed[0]['error']}")
    known = fresh if stored is None else fresh.unionByName(
        stored.withColumn("error", F.lit(None).cast("string")))
    told = [F.col("key").alias("_key"), F.col("response").alias(out)]
    if keep_errors:
        told.append(F.col("error").alias(f"{out}_error"))
    return keyed.join(known.select(*told), "_key", "left").drop("_key")
