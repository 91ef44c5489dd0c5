"""Threads from a reply graph: (customer message, stitched brand reply, prior turns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.rules import HANDOFF_PATTERNS, handed_off
from colloquy.session import materialise

MAX_HOPS = 6

# "Wed Oct 11 06:55:44 +0000 2017" without its day name, which Spark does not parse.
CREATED_AT = "MMM dd HH:mm:ss Z yyyy"


def created_ts(created_at: Column) -> Column:
    return F.try_to_timestamp(F.substring(created_at, 5, 100), F.lit(CREATED_AT))


def id_order(tweet_id: str = "tweet_id") -> list[Column]:
    """Numeric order of ids that are kept as text."""
    return [F.length(tweet_id), F.col(tweet_id)]


def default_order() -> list[Column]:
    """By time, then by number; tweets without a readable time come last."""
    at = created_ts(F.col("created_at"))
    return [at.isNull(), at, *id_order()]


def unique_tweets(tweets: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per ``tweet_id``: the first in order."""
    rank = F.struct(*(order or default_order()))
    row = F.struct(*[c for c in tweets.columns])
    return (tweets.groupBy("tweet_id").agg(F.min_by(row, rank).alias("row")).select("row.*"))


def duplicate_ids(tweets: DataFrame) -> DataFrame:
    """Ids that occur more than once, for validation before a build."""
    return tweets.groupBy("tweet_id").count().where("count > 1")


def brand_tweets(tweets: DataFrame, brand: str) -> DataFrame:
    return tweets.where((F.col("author_id") == brand) & ~F.col("inbound"))


def first_replies(
    tweets: DataFrame, brand: str, order: Sequence[Column] | None = None
) -> DataFrame:
    """The first brand reply to each customer message.

    The winner per parent is picked by a partial aggregation, before any join, so a
    message with very many replies costs one row per map task. The join to the customer
    rows is then one to one.
    """
    picked = (
        brand_tweets(tweets, brand)
        .where(F.col("in_response_to_tweet_id").isNotNull())
        .groupBy(F.col("in_response_to_tweet_id").alias("thread_id"))
        .agg(F.min(F.struct(
            F.struct(*(order or default_order())).alias("rank"),
            F.col("tweet_id").alias("reply_id"),
            F.col("text").alias("reply_text"),
            F.col("response_tweet_id").alias("next_id"),
        )).alias("first"))
        .select("thread_id", "first.reply_id", "first.reply_text", "first.next_id")
    )
    customers = tweets.where("inbound").select(
        F.col("tweet_id").alias("thread_id"),
        F.col("text").alias("customer_text"),
        F.col("in_response_to_tweet_id").alias("parent_id"),
    )
    return customers.join(picked, "thread_id")


def reply_edges(tweets: DataFrame, brand: str, expand_responses: bool = False) -> DataFrame:
    """``(node, next)``: a brand tweet and the brand tweet that continues it.

    A comma list of responses is one unknown id, as in the data; ``expand_responses``
    splits it and takes the brand response with the lowest id.
    """
    rows = brand_tweets(tweets, brand)
    edges = rows.where("response_tweet_id is not null").select(
        F.col("tweet_id").alias("node"), F.col("response_tweet_id").alias("next"))
    if expand_responses:
        edges = edges.select("node", F.explode(F.split("next", ",")).alias("next")).select(
            "node", F.trim("next").alias("next"))
    edges = edges.join(rows.select(F.col("tweet_id").alias("next")), "next", "left_semi")
    if expand_responses:
        edges = edges.groupBy("node").agg(
            F.min(F.struct(F.length("next"), F.col("next"))).alias("n")).select("node", "n.next")
    return edges.select("node", "next")


def _four_hops(edges: DataFrame) -> DataFrame:
    """``(node, n1, n2, n3, n4)``: the next four nodes, null past the end of a chain."""
    one = edges.select("node", F.col("next").alias("n1"))
    two = one.join(one.select(F.col("node").alias("n1"), F.col("n1").alias("n2")).hint("merge"), "n1", "left")
    onward = two.select(
        F.col("node").alias("n2"), F.col("n1").alias("n3"), F.col("n2").alias("n4"))
    return two.join(onward.hint("merge"), "n2", "left").select("node", "n1", "n2", "n3", "n4")


def follow(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(start, pos, node)``: every node reached from ``start`` along unique out-edges.

    Each round makes the known part of every chain four times as long, so a chain of n
    nodes takes log4(n) rounds. A node counts at its first position only, which ends
    cycles and self-loops. Each round is written out, which keeps the plan short and
    survives lost executors. Ids shrink far in files, so the planner is kept from
    broadcasting by file size.
    """
    reached = starts.select("start", F.lit(0).alias("pos"), F.col("start").alias("node"))
    known, step = None, 1
    while not edges.isEmpty():
        hops = materialise(_four_hops(edges), "hops")
        later = F.array(*[
            F.struct((F.col("pos") + k * step).alias("pos"), F.col(f"n{k}").alias("node"))
            for k in (1, 2, 3)])
        onward = reached.join(hops.hint("merge"), "node").select("start", F.inline(later)).where(
            "node is not null")
        reached = materialise(
            reached.unionByName(onward).groupBy("start", "node").agg(F.min("pos").alias("pos")),
            "reached")
        size = reached.count()
        if size == known:
            break
        known, step = size, step * 4
        edges = hops.where("n4 is not null").select("node", F.col("n4").alias("next"))
    return reached.select("start", "pos", "node")


def stitched_replies(
    tweets: DataFrame,
    replies: DataFrame,
    brand: str,
    expand_responses: bool = False,
    bare_initials: bool = False,
) -> DataFrame:
    """``replies`` with ``brand_reply``: all parts of each reply, cleaned, in order."""
    def part(text: Column) -> Column:
        return tx.strip_agent_suffix(tx.redact_handles(text), bare_initials)

    edges = materialise(reply_edges(tweets, brand, expand_responses), "edges")
    starts = replies.select(F.col("reply_id").alias("start")).join(
        edges.select(F.col("node").alias("start")).hint("merge"), "start", "left_semi")
    chains = follow(starts, edges).where("pos > 0")
    texts = brand_tweets(tweets, brand).select(F.col("tweet_id").alias("node"), "text")
    more = (
        chains.join(texts, "node")
        .groupBy(F.col("start").alias("reply_id"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", part(F.col("text")).alias("text"))))
             .alias("parts"))
    )
    first = part(F.col("reply_text"))
    rest = F.coalesce(F.col("parts.text"), F.array().cast("array<string>"))
    stitched = F.array_join(F.filter(F.concat(F.array(first), rest), lambda p: p != ""), " ")
    return replies.join(more, "reply_id", "left").withColumn("brand_reply", stitched).drop("parts")


def prior_turns(tweets: DataFrame, parents: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """``(parent_id, prior_context)``: up to ``hops`` ancestors, oldest first.

    The walk starts once from each distinct parent and carries ids only; authors and texts
    are joined at the end. A missing ancestor ends the walk.
    """
    links = tweets.select(
        F.col("tweet_id").alias("at"), F.col("in_response_to_tweet_id").alias("up"))
    walk = parents.select("parent_id").where("parent_id is not null").distinct()
    walk = walk.withColumn("hop1", F.col("parent_id"))
    for hop in range(2, hops + 1):
        walk = walk.join(links, F.col(f"hop{hop - 1}") == F.col("at"), "left").drop("at")
        walk = walk.withColumnRenamed("up", f"hop{hop}")
    steps = walk.select(
        "parent_id",
        F.posexplode(F.array(*[f"hop{h}" for h in range(1, hops + 1)])).alias("hop", "node"),
    ).where("node is not null")
    turns = tweets.select(
        F.col("tweet_id").alias("node"),
        F.struct(
            F.col("author_id").alias("author"),
            tx.redact_handles(F.col("text")).alias("text"),
            F.col("inbound").alias("inbound"),
        ).alias("turn"),
    )
    return (
        steps.join(turns, "node")
        .groupBy("parent_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("pos"), "turn")))
             .alias("c"))
        .select("parent_id", F.col("c.turn").alias("prior_context"))
    )


def with_prior_context(tweets: DataFrame, threads: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """``threads`` (with ``parent_id``) and their ``prior_context``, empty when there is none."""
    turns = prior_turns(tweets, threads, hops)
    none = F.array().cast(turns.schema["prior_context"].dataType)
    return threads.join(turns, "parent_id", "left").withColumn(
        "prior_context", F.coalesce("prior_context", none))


def build_threads(
    tweets: DataFrame,
    brand: str,
    *,
    order: Sequence[Column] | None = None,
    handoff_patterns: Sequence[str] = HANDOFF_PATTERNS,
    expand_responses: bool = False,
    bare_initials: bool = False,
    hops: int = MAX_HOPS,
) -> DataFrame:
    """``thread_id, customer_text, brand_reply, prior_context, escalated`` of one brand.

    ``tweet_id`` must be unique; see ``duplicate_ids`` and ``unique_tweets``.
    """
    replies = materialise(first_replies(tweets, brand, order), "replies")
    threads = stitched_replies(tweets, replies, brand, expand_responses, bare_initials)
    threads = with_prior_context(tweets, threads, hops)
    return threads.select(
        "thread_id",
        tx.redact_handles(F.col("customer_text")).alias("customer_text"),
        "brand_reply",
        "prior_context",
        handed_off(F.col("brand_reply"), handoff_patterns).alias("escalated"),
    )


def escalation_totals(threads: DataFrame) -> DataFrame:
    """One row: ``threads``, ``escalated`` and ``escalation_rate``."""
    return threads.agg(
        F.count(F.lit(1)).alias("threads"),
        F.coalesce(F.sum(F.col("escalated").cast("long")), F.lit(0)).alias("escalated"),
        F.avg(F.col("escalated").cast("double")).alias("escalation_rate"),
    )


def context_share(threads: DataFrame) -> DataFrame:
    """One row: ``threads``, ``with_context`` and ``context_share``."""
    some = F.coalesce(F.size("prior_context") > 0, F.lit(False))
    return threads.agg(
        F.count(F.lit(1)).alias("threads"),
        F.count_if(some).alias("with_context"),
        F.avg(some.cast("double")).alias("context_share"),
    )
