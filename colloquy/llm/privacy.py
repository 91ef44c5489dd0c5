"""Personal data: patterns for what has a form, and co-occurrence for what gives it away.

Entities are the values that the patterns find. A term near an entity tells about it as far as
the corpus shows them together: with N different texts, the entity in n_e, the term in n_t and
the term near the entity in n_et, the term reveals log(N n_et / (n_e n_t)) of the entity's
log(N / n_e). Terms that reveal at least ``share`` of it are generalised, terms that reveal
all of it are removed, wherever they stand near that entity. Copies of a text count once.

Nulls: a null text is empty; null and repeated ids are rows like any other. Spans are code
points, end exclusive. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import ROW, carry, small_batches
from colloquy.llm.exact_dedup import flag_repeats
from colloquy.session import materialise

# The forms of personal data.
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9](?:\.?[0-9])*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM_BREAK = r"[\x20\x09-\x0D.,;:!?()\"'\[\]]+"
TERM = re.compile(r"[^\x20\x09-\x0D.,;:!?()\"'\[\]]+")
BREAKS = frozenset(" \t\n\x0b\x0c\r.,;:!?()\"'[]")
KINDS = ("email", "ip", "card", "phone")

CONTEXT = 200  # code points on either side of an entity
MIN_TEXTS = 1  # different texts in which a term must stand near an entity: all of them count
SHARE = 0.75
MENTIONS = 50_000  # mentions that the scan of texts holds at a time

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards: linear also in a long run of letters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAIL_NAME:
            start -= 1
        host = MAIL_HOST.match(text, at) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    """Every four parts of a dotted chain of digits."""
    for chain in DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = dict(
    zip(KINDS, (emails, addresses, cards, phones), strict=True))


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


def entity(kind: str, value: str) -> str:
    """One name for all spellings of an entity."""
    plain = value.lower() if kind == "email" else (
        value if kind == "ip" else "".join(c for c in value if c in "0123456789"))
    return f"{kind}:{plain}"


def near_terms(text: str, span: Span, context: int) -> Iterator[Span]:
    """Whole terms within ``context`` code points of a span."""
    for a, b in ((max(0, span[0] - context), span[0]), (span[1], min(len(text), span[1] + context))):
        for m in TERM.finditer(text, a, b):
            cut_before = m.start() == a and a > 0 and text[a - 1] not in BREAKS
            cut_after = m.end() == b and b < len(text) and text[b] not in BREAKS
            if not (cut_before or cut_after):
                yield m.span()


def near_mentions(text: str, found: dict[str, list[Span]], context: int) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms near each entity that lie outside all of ``found``."""
    taken = sorted(s for v in found.values() for s in v)
    starts = [a for a, _ in taken]
    furthest = list(accumulate((b for _, b in taken), max))
    for kind, spans in found.items():
        for span in spans:
            name = entity(kind, text[slice(*span)])
            for a, b in near_terms(text, span, context):
                before = bisect_left(starts, b)
                if not before or furthest[before - 1] <= a:
                    yield name, text[a:b], a, b


def _scan(context: int, at_once: int = MENTIONS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per text, and more rows with mentions only (``base`` null) for a text with many."""
    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        index, counts, bases, mentions = zip(*rows, strict=True)
        whole = pa.array([i if b is not None else None for i, b in zip(index, bases, strict=True)], pa.int64())
        named = {name: batch.column(name).take(whole if name == ROW else pa.array(index, pa.int64()))
                 for name in batch.schema.names[1:]}
        flat = list(zip(*(m for of in mentions for m in of), strict=True)) or [[]] * 4
        listed = pa.ListArray.from_arrays(
            pa.array([0, *accumulate(map(len, mentions))], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(flat, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)],
                names=["entity", "term", "start", "end"]))
        hashes = [b if b is None else hashlib.sha256(b.encode()).hexdigest() for b in bases]
        return pa.RecordBatch.from_arrays(
            [*named.values(), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))),
             pa.array(bases, pa.string()), pa.array(hashes, pa.string()), listed],
            names=[*named, *(f"n_{k}" for k in KINDS), "base", "base_sha256", "mentions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                found = base_spans(text)
                base = ",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)
                counts = [len(v) for v in found.values()]
                near = near_mentions(text, found, context)
                while (part := list(islice(near, at_once - held))) or base is not None:
                    rows.append((i, counts, base, part))
                    base, held = None, held + len(part)
                    if held == at_once:
                        yield packed(batch, rows)
                        rows, held = [], 0
            if rows:
                yield packed(batch, rows)
    return run


def term_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): in how many different texts each term stands.

    Terms are counted inside the map tasks; only texts that may have copies are shuffled first.
    """
    rows = flag_repeats(texts, text_col, []).select("text", "maybe")
    once = rows.where(~F.col("maybe")).select("text").unionByName(
        rows.where("maybe").groupBy(F.xxhash64("text").alias("text_id"))
        .agg(F.first("text").alias("text")).select("text"))
    return (once.select(F.explode(F.array_distinct(F.split("text", TERM_BREAK))).alias("term"))
            .groupBy("term").agg(F.count("*").alias("n_t")))


def disclosing_terms(mentions: DataFrame, texts: DataFrame, text_col: str, n_texts: int, *,
                     min_texts: int, share: float) -> DataFrame:
    """(entity, term, kind) of the terms that reveal too much.

    ``mentions`` has (entity, term, text_id). Every pair that meets in ``min_texts`` different
    texts is scored.
    """
    met = mentions.select("entity", "term", "text_id").distinct()
    pairs = materialise(met.groupBy("entity", "term").agg(F.count("*").alias("n_et"))
                        .where(F.col("n_et") >= min_texts), "near-pairs")
    # Both sides of each join are read from files, so that a hot entity or term can be split.
    entities = materialise(mentions.select("entity", "text_id").distinct().groupBy("entity").agg(
        F.count("*").alias("n_e")), "entities")
    spread = materialise(term_counts(texts, text_col).join(
        pairs.select("term").distinct(), "term", "left_semi"), "near-terms")
    n = F.lit(float(n_texts))
    revealed = F.log(n * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    whole = F.log(n / F.col("n_e"))
    return (pairs.join(entities, "entity").join(spread, "term")
            .where((whole > 0) & (revealed >= share * whole))
            .select("entity", "term", F.when(revealed >= whole - 1e-9, "removed")
                    .otherwise("generalised").alias("kind")))


def find_personal(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None,
                  context: int = CONTEXT, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """Every row with the counts of each kind, ``base_sha256``, ``spans`` and ``n_terms``.

    ``spans`` lists kind:start:end, patterns first, then generalised and removed terms. The
    caller's columns ``keep`` (default all) come back in the struct ``_row``.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = carry(docs, keep, text=text, text_id=F.xxhash64(text)).select(
        "text", ROW, "text_id", F.monotonically_increasing_id().alias("uid"))
    kind = rows.schema[ROW].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    scanned = rows.mapInArrow(_scan(context), (
        f"{ROW} {kind}, text_id long, uid long, {counts}, base string, base_sha256 string, "
        "mentions array<struct<entity: string, term: string, start: int, end: int>>"))
    parts = materialise(scanned, "personal")
    base = parts.where("base is not null")
    mentions = parts.where(F.size("mentions") > 0).select("uid", "text_id", F.inline("mentions"))
    n_texts = base.select("text_id").distinct().count()
    telling = materialise(disclosing_terms(mentions, docs, text_col, n_texts, min_texts=min_texts,
                                           share=share), "telling-terms")
    # One span may stand near several entities; the stronger verdict counts ("removed" sorts last).
    spans = mentions.join(telling, ["entity", "term"]).groupBy("uid", "start", "end").agg(
        F.max("kind").alias("kind"))
    listed = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("t"))
    added = F.transform("t", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    joined = base.join(listed, "uid", "left")
    return joined.select(
        ROW, *[f"n_{k}" for k in KINDS], "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.concat_ws(",", added)).alias("all"),
        F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_terms")).withColumn(
        "spans", F.rtrim(F.col("all"), F.lit(","))).drop("all")


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with the found spans replaced: a placeholder by kind, nothing for removed terms.

    Where spans overlap, the one that starts first (then the longest) is replaced.
    """
    def one(text: str, listed: str) -> str:
        found = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in listed.split(",") if s))
        out, at = [], 0
        for a, b, kind in found:
            if a >= at:
                out += [text[at:a], "" if kind == "removed" else f"[{kind}]"]
                at = -b
        return "".join([*out, text[at:]])
    return pd.Series([one(t or "", s or "") for t, s in zip(texts, spans, strict=True)], dtype=object)
