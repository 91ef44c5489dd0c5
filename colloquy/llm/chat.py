"""Chat formatting: layouts told apart by a fingerprint of their field paths.

A layout is a declaration: which field paths it has and where role and text of a turn are. The
paths of a table's schema, or of one JSON value, are hashed to a fingerprint; a registered
fingerprint selects its layout directly, otherwise the layout with the most paths that are all
present is taken. Every layout ends as canonical turns (conv_id, turn, role, text).

A turn is written as ``START role NEWLINE text END NEWLINE``. A backslash inside role or text is doubled,
and one is put behind the first character of every control string there; a line break in a role
is a backslash and an n. So the marks are the only control strings of the output, a role ends at
its first line break, and both are read back unchanged, however long they are.

Nulls: a null role or text is empty; turns without a conversation id form one conversation;
turns with equal numbers are ordered by what is written. Empty lists and tables give no turns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
# Control strings of common chat templates.
CONTROL = r"<(?=/?s>|\|im_(?:start|end)\|>|</?SYS>>)|\[(?=/?INST\])"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: the path of a list of turns, None for one turn a row, or fixed (role, path) pairs."""

    name: str
    turns: str | None | tuple[tuple[str, str], ...]
    role: str = "role"
    text: str = "content"
    order: str = "turn"
    optional: tuple[str, ...] = field(default=())

    @property
    def paths(self) -> tuple[str, ...]:
        if self.turns is None:
            return tuple(sorted((self.role, self.text, self.order)))
        if isinstance(self.turns, str):
            return tuple(sorted((f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")))
        return tuple(sorted(path for _, path in self.turns))


LAYOUTS = (
    Layout("turn rows", None, text="text"),
    Layout("messages", "messages"),
    Layout("role and content", "conversation"),
    Layout("from and value", "conversations", role="from", text="value"),
    Layout("prompt and completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", (("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction and input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system and instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def fingerprint(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Leaf field paths of a schema; ``[]`` marks the elements of a list."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else {at}


def value_paths(value: object, at: str = "") -> set[str]:
    """The same for a JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    return {p for v in value for p in value_paths(v, at + "[]")} if isinstance(value, list) else {at}


def choose_layout(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """By fingerprint of the paths that any layout knows, else the largest layout they hold."""
    known = {p for layout in layouts for p in layout.paths}
    by_print = {fingerprint(layout.paths): layout for layout in layouts}
    exact = by_print.get(fingerprint(tuple(paths & known)))
    fitting = [layout for layout in layouts if paths.issuperset(layout.paths)]
    return exact or max(fitting, key=lambda x: len(x.paths), default=None)


def _at(path: str) -> Column:
    first, *rest = path.split(".")
    out = F.col(f"`{first}`")
    for name in rest:
        out = out[name]
    return out


def _role(role: Column) -> Column:
    lower = F.lower(role)
    named = F.lit(None).cast("string")
    for name, canonical in ROLES.items():
        named = F.when(lower == name, canonical).otherwise(named)
    return F.coalesce(named, role, F.lit(""))


def apply_layout(rows: DataFrame, layout: Layout, id_col: str) -> DataFrame:
    """(conv_id, turn, role, text) by one layout."""
    conv = F.col(f"`{id_col}`").alias("conv_id")
    if layout.turns is None:
        return rows.select(conv, _at(layout.order).cast("long").alias("turn"),
                           _role(_at(layout.role)).alias("role"),
                           F.coalesce(_at(layout.text), F.lit("")).alias("text"))
    if isinstance(layout.turns, str):
        listed = rows.select(conv, F.posexplode(_at(layout.turns)).alias("turn", "t"))
        role, text = F.col("t")[layout.role], F.col("t")[layout.text]
    else:
        turns = F.array(*[F.struct(F.lit(r).alias("role"), _at(p).cast("string").alias("text"))
                          for r, p in layout.turns])
        listed = rows.select(conv, F.posexplode(turns).alias("turn", "t"))
        role, text = F.col("t")["role"], F.col("t")["text"]
    return listed.select("conv_id", F.col("turn").cast("long").alias("turn"),
                         _role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(rows: DataFrame, id_col: str = "conv_id",
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of a table whose columns follow one of the layouts."""
    layout = choose_layout(schema_paths(rows.schema), layouts)
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(rows.schema))}")
    return apply_layout(rows, layout, id_col)


def _json_schema(layout: Layout) -> str:
    if isinstance(layout.turns, str):
        return f"`{layout.turns}` array<struct<`{layout.role}`: string, `{layout.text}`: string>>"
    names = layout.paths if layout.turns is None else [p for _, p in layout.turns]
    return ", ".join(f"`{n}` string" for n in dict.fromkeys(names))


def json_layouts(json_col: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of each JSON text's layout; null where it is unreadable or no layout fits."""
    @F.pandas_udf("string")
    def named(values: pd.Series) -> pd.Series:
        cache: dict[frozenset, str | None] = {}

        def one(value: str | None) -> str | None:
            try:
                paths = frozenset(value_paths(json.loads(value)))
            except (TypeError, ValueError, RecursionError):
                return None
            if paths not in cache:
                layout = choose_layout(set(paths), layouts)
                cache[paths] = layout.name if layout else None
            return cache[paths]
        return values.map(one, na_action="ignore")
    return named(json_col)


def canonical_turns_json(rows: DataFrame, id_col: str, json_col: str,
                         layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Turns of JSON texts in mixed layouts, and the rows that no layout fits."""
    named = rows.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{json_col}`").alias("json"),
                        json_layouts(F.col(f"`{json_col}`"), layouts).alias("layout"))
    turns = None
    for layout in layouts:
        parsed = named.where(F.col("layout") == layout.name).select(
            F.col("conv_id").alias("_conv_id"), F.from_json("json", _json_schema(layout)).alias("v")
        ).select("_conv_id", "v.*")
        one = apply_layout(parsed, layout, "_conv_id")
        turns = one if turns is None else turns.unionByName(one)
    return turns, named.where(F.col("layout").isNull()).drop("layout")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# A written line break: a backslash that is not itself escaped, and the letter n.
LINE_BREAK = r"(?<!\\)((?:\\\\)*+)\\n"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_length): the pieces of a conversation in order
    are its formatted text; the loss mask covers the written text of trained turns."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    text = escape(F.col("text"))
    trained = F.col("role") == TRAINED
    return turns.select("conv_id", "turn", role.alias("r"), text.alias("t"), trained.alias("trained")).select(
        "conv_id", "turn", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END)).alias("piece"),
        F.when(F.col("trained"), F.length("r") + len(START) + 1).otherwise(0).alias("loss_start"),
        F.when(F.col("trained"), F.length("t")).otherwise(0).alias("loss_length"))


def read_turns(pieces: DataFrame) -> DataFrame:
    """Formatted pieces back to (conv_id, turn, role, text, loss, piece_chars)."""
    whole = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    loss = F.substring(F.col("piece"), F.col("loss_start") + 1, F.col("loss_length"))
    return pieces.select(
        "conv_id", "turn", "piece",
        unescape(F.regexp_replace(F.regexp_extract("piece", whole, 1), LINE_BREAK, "$1\\\\\n")).alias("role"),
        unescape(F.regexp_extract("piece", whole, 2)).alias("text"),
        unescape(loss).alias("loss"), F.length("piece").alias("piece_chars"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, hashed turn by turn over a sorted partition: a conversation
    of any length takes the memory of one batch."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row() -> list:
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

        for batch in batches:
            done = []
            for conv, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            yield table(done)
        if now is not None:
            yield table([row()])

    def table(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "piece").select(
        "conv_id", "role", "text", "loss", "piece_chars")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                       "loss_sha256 string, formatted_chars long")
