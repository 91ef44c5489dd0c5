"""The trie of conversation prefixes, with members, leaves and savings of every node.

A conversation is its sequence of turns (role and text). Turns become fixed-width codes, a
128-bit hash of role and text with the length of the text, so texts are read once and never
shuffled. A very long conversation is cut into blocks of ``BLOCK_TURNS`` codes: the block that
follows hangs below the node at which the one before it ends.

Equal blocks are merged and the rest is range-partitioned in order. Each partition cuts its
part of the order into shards of a bounded number of codes. A shard numbers its codes with a
dictionary, grows a ternary search tree over the numbers by inserting medians first, so that
it is balanced, and walks its nodes backwards: children come after their parents, so one pass
without recursion adds up members, leaves and savings. Only nodes on the first or last path of
a shard, and on the path of a block that goes on, can also belong to another shard. These
boundary nodes leave the shard as partial sums under a chained hash of their path, are merged
by it, and pass their sums upwards by pointer doubling, in as many rounds as the logarithm of
the depth.

Members that end at one node are listed in order of id. The list is written in pieces, so a
node where a third of all conversations end is hashed as a stream.

Turns are ordered by turn (null first), then by role and text; null roles and texts are empty.
Rows that repeat a turn number are turns like any other. Rows without a conversation id belong
to no conversation and are left out. A text of any length counts whole. An empty table has no
conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches
from colloquy.session import materialise

CODE = 20  # bytes of a turn's code: 16 of its hash, 4 of its length
BLOCK_TURNS = 1_024
SHARD_CODES = 200_000
LIST_IDS = 4_096  # ids in one piece of a list
NO_ID = np.iinfo(np.int64).max
NODE = ("conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, key binary, parent_key binary, parent_conv_id long, chars long")
EMPTY_LIST = hashlib.sha256(b"").hexdigest()


def turn_codes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv_id, turn, code, tie) of every row with a conversation; written, without texts."""
    said = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)}
    name = F.concat(F.length(said[role]).cast("string"), F.lit(":"), said[role], said[text])
    size = F.lpad(F.hex(F.length(said[text]).cast("long")), 8, "0")
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.concat(F.md5(name), size)).alias("code"), F.monotonically_increasing_id().alias("tie"))
    return materialise(rows, "turn-codes")


def _fragments(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring codes of one conversation, at most ``block`` in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8)
            edge = np.flatnonzero(np.diff(conv) != 0) + 1
            starts = np.append(0, edge) if len(conv) else edge
            stops = np.append(edge, len(conv)) if len(conv) else edge
            pieces = [(a, min(a + block, e)) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)
                      for a in range(s, e, block)]
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([int(conv[a]) for a, _ in pieces], pa.int64()),
                "task": pa.array(np.full(len(pieces), task, dtype=np.int32)),
                "number": pa.array(np.arange(number, number + len(pieces))),
                "n": pa.array([e - a for a, e in pieces], pa.int64()),
                "codes": pa.array([codes[CODE * a:CODE * e].tobytes() for a, e in pieces], pa.binary())})
            number += len(pieces)
    return run


def fragments(codes: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, at, n, codes): runs of turns in order, ``at`` being the place of the first.

    Ranges of (conversation, turn, code) are sorted apart, so a conversation of any length is
    spread; its runs are then counted up, one row each.
    """
    order = ["conv_id", "turn", "code", "tie"]
    ranged = codes.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code")
    rows = materialise(ranged.mapInArrow(
        _fragments(block), "conv_id long, task int, number long, n long, codes binary"), "fragments")
    before = Window.partitionBy("conv_id").orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), "n", "codes")


def _cut(codes: Column, first: Column, n: Column) -> Column:
    """``n`` codes from the place ``first``, counted from 0."""
    return F.substring(codes, (first * CODE + 1).cast("int"), (n * CODE).cast("int"))


def _joined(parts: Column) -> Column:
    """The codes of (at, codes) structs, end to end."""
    return F.aggregate(F.array_sort(parts), F.lit(b""), lambda have, p: F.concat(have, p["codes"]))


def plain_slices(runs: DataFrame) -> DataFrame:
    """Conversations as they are, as (conv_id, at, n, codes)."""
    return runs.select("conv_id", "at", "n", "codes")


def shared_heads(runs: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """Conversations rebuilt upon the head of another one, as (conv_id, at, n, codes).

    Conversation c takes the first h turns of conversation c - c % every, h being crc32(c) %
    (longest + 1), then its own turns after its first h. One row with ``at`` 0 also stands for
    a conversation that is left without turns.
    """
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(longest + 1))
    heads = (
        runs.where((c % every == 0) & (F.col("at") < longest))
        .select(c.alias("base"), F.col("at"), _cut(F.col("codes"), F.lit(0), F.lit(longest) - F.col("at")).alias("codes"))
        .groupBy("base").agg(_joined(F.collect_list(F.struct("at", "codes"))).alias("head")))
    met = runs.withColumn("base", c - c % every).join(heads, "base", "left").withColumn("h", h)
    borrowed = F.coalesce(_cut(F.col("head"), F.lit(0), F.col("h")), F.lit(b""))
    met = met.withColumn("borrowed", borrowed).withColumn("got", (F.length("borrowed") / CODE).cast("long"))
    skip = F.least(F.greatest(F.col("h") - F.col("at"), F.lit(0)), F.col("n"))
    own = met.select(
        "conv_id", (F.col("at") + skip - F.col("h") + F.col("got")).alias("at"), (F.col("n") - skip).alias("n"),
        _cut(F.col("codes"), skip, F.col("n") - skip).alias("codes")).where("n > 0")
    head = met.where("at = 0").select(
        "conv_id", F.lit(0).cast("long").alias("at"), F.col("got").alias("n"), F.col("borrowed").alias("codes"))
    return own.unionByName(head)


def _chain(rows: pa.Table) -> pa.Table:
    """The key of the node below which each block of one conversation hangs."""
    rows = rows.sort_by("band")
    key, out = b"", []
    for digest in rows["digest"].to_pylist():
        out.append(key)
        key = hashlib.md5(key + digest).digest()
    return pa.table({"conv_id": rows["conv_id"], "band": rows["band"], "prefix": pa.array(out, pa.binary())})


def blocks(slices: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, prefix, band, codes, goes_on): conversations in blocks of ``block`` turns."""
    start, stop = F.col("at"), F.col("at") + F.col("n")
    last = F.greatest(F.floor((stop - 1) / block), F.floor(start / block))
    dealt = slices.withColumn("band", F.explode(F.sequence(F.floor(start / block), last)))
    low = F.greatest(start, F.col("band") * block)
    high = F.least(stop, (F.col("band") + 1) * block)
    cut = dealt.select("conv_id", "band", low.alias("at"), _cut(F.col("codes"), low - start, high - low).alias("codes"))
    whole = cut.groupBy("conv_id", "band").agg(_joined(F.collect_list(F.struct("at", "codes"))).alias("codes"))
    bands = F.max("band").over(Window.partitionBy("conv_id"))
    rows = materialise(whole.withColumn("goes_on", F.col("band") < bands).withColumn("many", bands > 0), "blocks")
    one = rows.where("not many").select("conv_id", F.lit(b"").alias("prefix"), "band", "codes", "goes_on")
    many = rows.where("many")
    digest = many.select("conv_id", "band", F.unhex(F.md5("codes")).alias("digest"))
    keys = digest.groupBy("conv_id").applyInArrow(_chain, "conv_id long, band long, prefix binary")
    return one.unionByName(many.join(keys, ["conv_id", "band"]).select(*one.columns))


def _list_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (prefix, band, codes, conv_id, goes_on) to one row per equal block and piece of its list."""
    names = ("prefix", "band", "codes", "low", "n", "goes_on", "ids")
    schema = pa.schema(list(zip(names, (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(),
                                        pa.string()), strict=True)))
    for batch in batches:
        out: list[list] = []
        ids: list[str] = []
        for prefix, band, codes, conv, goes_on in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not out or out[-1][0] != prefix or out[-1][2] != codes or len(ids) >= LIST_IDS:
                if out:
                    out[-1][6] = ",".join(ids)
                out.append([prefix, band, codes, conv, 0, False, ""])
                ids = []
            out[-1][4] += 1
            out[-1][5] |= goes_on
            if not goes_on:
                ids.append(str(conv))
        if out:
            out[-1][6] = ",".join(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, schema, strict=True)],
            schema=schema)


def listed_blocks(rows: DataFrame) -> DataFrame:
    """Equal blocks merged: (prefix, band, codes, low, n, goes_on, ids), a long list in pieces."""
    order = ["prefix", "codes", "conv_id"]
    ranged = materialise(rows, "members").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.select("prefix", "band", "codes", "conv_id", "goes_on").mapInArrow(
        _list_up, "prefix binary, band long, codes binary, low long, n long, goes_on boolean, ids string"), "lists")


class TernaryTree:
    """A ternary search tree over numbered codes; node 0 is the root and has no code."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.parent = [-1], [-1], [-1], [-1], [-1]

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes on the path of a sequence; new ones come after their parents."""
        code, low, high, down = self.code, self.low, self.high, self.down
        path = [0]
        for x in sequence:
            above = path[-1]
            side, link, node = down, above, down[above]
            while node >= 0 and code[node] != x:
                side, link = (low, node) if x < code[node] else (high, node)
                node = side[link]
            if node < 0:
                node = side[link] = len(code)
                code.append(x)
                low.append(-1)
                high.append(-1)
                down.append(-1)
                self.parent.append(above)
            path.append(node)
        return path


def medians_first(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every open range before its halves."""
    open_ranges = [(0, n)]
    while open_ranges:
        a, b = open_ranges.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            open_ranges += [(a, m), (m + 1, b)]


def shard_nodes(prefix: bytes, first_depth: int, sequences: list[tuple[bytes, int, int, bool, str | None]],
                block: int) -> list[tuple]:
    """All nodes of one shard of (codes, smallest member, members, goes on, hash of ends), in order."""
    raw = np.frombuffer(b"".join(s[0] for s in sequences), np.uint8).reshape(-1, CODE)
    chars = raw[:, 16:].copy().view(">u4").ravel().astype(np.int64)
    names, first, numbers = np.unique(np.ascontiguousarray(raw).view(f"V{CODE}").ravel(),
                                      return_index=True, return_inverse=True)
    size = [0, *chars[first].tolist()]  # by number + 1; the root has no text
    stops = np.cumsum([len(s[0]) // CODE for s in sequences]).tolist()
    numbers = numbers.tolist()
    tree = TernaryTree()
    paths: dict[int, list[int]] = {}
    ends: list[int] = [0] * len(sequences)
    shared = {0}
    for i in medians_first(len(sequences)):
        path = tree.insert(numbers[(stops[i - 1] if i else 0):stops[i]])
        ends[i] = path[-1]
        if i in (0, len(sequences) - 1) or sequences[i][3]:
            shared.update(path)
            paths[i] = path
    n = len(tree.code)
    members, smallest = [0] * n, [NO_ID] * n
    children, leaves, saved, depth = [0] * n, [0] * n, [0] * n, [first_depth] * n
    hashes: list[str | None] = [None] * n
    for end, (_, low, count, _, digest) in zip(ends, sequences, strict=True):
        members[end], smallest[end], hashes[end] = count, low, digest
    keys = {0: prefix}
    for i, path in paths.items():
        codes = sequences[i][0]
        for d, node in enumerate(path[1:], 1):
            if node not in keys:
                keys[node] = hashlib.md5(
                    prefix + hashlib.md5(codes).digest() if d == block
                    else keys[path[d - 1]] + codes[CODE * (d - 1):CODE * d]).digest()
    for node in range(1, n):
        depth[node] = depth[tree.parent[node]] + 1
    for node in range(n - 1, 0, -1):
        above = tree.parent[node]
        members[above] += members[node]
        smallest[above] = min(smallest[above], smallest[node])
        if node not in shared:
            children[above] += 1
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * size[tree.code[node] + 1]
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    if first_depth:  # counted by the block that ends there
        members[0], smallest[0] = 0, NO_ID
    out = []
    for node in range(n):
        above = tree.parent[node]
        known = node not in shared and above not in shared
        out.append((None if smallest[node] == NO_ID else smallest[node], depth[node], members[node], children[node],
                    leaves[node], saved[node], hashes[node], keys.get(node) if node in shared else None,
                    keys[above] if above in shared else None, smallest[above] if known else None,
                    size[tree.code[node] + 1]))
    return out


def _grow(block: int, shard_codes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted lists to nodes, one shard at a time; a list is hashed as its pieces come."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(prefix, band, codes, smallest, members, goes on, hash of ends) of each block."""
        now, state, any_id = None, None, False
        for batch in batches:
            for prefix, band, codes, low, n, goes_on, ids in zip(
                    *(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or now[0] != prefix or now[2] != codes:
                    if now is not None:
                        yield (*now, state.hexdigest() if any_id else None)
                    now, state, any_id = [prefix, band, codes, low, 0, False], hashlib.sha256(), False
                now[3], now[4], now[5] = min(now[3], low), now[4] + n, now[5] or goes_on
                if ids:
                    state.update(f",{ids}".encode() if any_id else ids.encode())
                    any_id = True
        if now is not None:
            yield (*now, state.hexdigest() if any_id else None)

    def emit(shard: list[tuple]) -> pa.RecordBatch:
        nodes = shard_nodes(shard[0][0], shard[0][1] * block, [s[2:] for s in shard], block)
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in NODE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True)],
                                          names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        held = 0
        for row in merged(batches):
            if shard and (row[0] != shard[0][0] or held >= shard_codes):
                yield emit(shard)
                shard, held = [], 0
            shard.append(row)
            held += 1 + len(row[2]) // CODE
        if shard:
            yield emit(shard)
    return run


def _boundary(parts: DataFrame) -> DataFrame:
    """Boundary nodes merged over all shards, their sums passed up by pointer doubling."""
    met = materialise(parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("ends_sha256").alias("ends_sha256"), F.max("parent_key").alias("parent_key"),
        F.max("chars").alias("chars")), "boundary")
    below = met.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("more"))
    rows = materialise(met.join(below, "key", "left").withColumn(
        "n_children", F.col("inner") + F.coalesce("more", F.lit(0))), "boundary")
    state = materialise(rows.select(
        "key", F.col("parent_key").alias("above"),
        (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "boundary-sums")
    while not state.where("above is not null").isEmpty():
        given = state.where("above is not null").groupBy(F.col("above").alias("key")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        summed = state.join(given, "key", "left").select(
            "key", "above", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        jump = state.select(F.col("key").alias("above"), F.col("above").alias("next"))
        onward = (F.col("above") != F.lit(b""))  # nothing lies above the root, where most pointers end
        moved = summed.where(onward).join(jump, "above").select(
            "key", F.col("next").alias("above"), "n_leaves", "saved_tokens")
        done = summed.where(onward.isNull() | ~onward).withColumn("above", F.lit(None).cast("binary"))
        state = materialise(moved.unionByName(done), "boundary-sums")
    return materialise(rows.join(state.select("key", "n_leaves", "saved_tokens"), "key").select(
        "key", "conv_id", "depth", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256"), "boundary-nodes")


def prefix_trie(turns: DataFrame, *, rebuild: Callable[[DataFrame], DataFrame] = plain_slices,
                block: int = BLOCK_TURNS, shard_codes: int = SHARD_CODES) -> DataFrame:
    """One row per node of the trie over all conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. ``rebuild`` maps runs of turns
    (conv_id, at, n, codes) to those of the conversations that are meant.
    """
    spark = turns.sparkSession
    small_batches(spark, 10_000)
    lists = listed_blocks(blocks(rebuild(materialise(fragments(turn_codes(turns), block), "runs")), block))
    ranged = lists.repartitionByRange("prefix", "codes").sortWithinPartitions("prefix", "codes", "low")
    nodes = materialise(ranged.mapInArrow(_grow(block, shard_codes), NODE), "nodes")
    edge = _boundary(nodes.where("key is not null"))
    above = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(EMPTY_LIST)).alias("ends_sha256")
    inner = nodes.where("key is null")
    near = inner.where("parent_key is not null").drop("parent_conv_id").join(above, "parent_key").withColumnRenamed(
        "above", "parent_conv_id")
    far = inner.where("parent_key is null")
    outer = edge.join(above, "parent_key", "left").withColumnRenamed("above", "parent_conv_id").select(*columns, ends)
    return far.select(*columns, ends).unionByName(near.select(*columns, ends)).unionByName(outer)
