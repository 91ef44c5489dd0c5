import random

import pytest

from colloquy.operators import threads as th
from colloquy.schema import TWEETS
from colloquy.session import materialise

B = "shop"


def tweet(i, author, text, up=None, down=None, at=None):
    return (str(i), author, author != B, at, text, down and str(down), up and str(up))


def build(spark, rows, parts=3, **options):
    rows = list(rows)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, TWEETS).repartition(parts)
    return {r.thread_id: r for r in th.build_threads(df, B, **options).collect()}


def test_reply_needs_an_inbound_parent_that_exists(spark):
    rows = [tweet(1, "u", "help @42"), tweet(2, B, "hi @1 2 ^AB", up=1),
            tweet(3, B, "own", up=2), tweet(4, B, "orphan", up=99), tweet(5, B, "alone")]
    out = build(spark, rows)
    assert list(out) == ["1"]
    assert (out["1"].customer_text, out["1"].brand_reply) == ("help @USER", "hi @USER")
    assert out["1"].prior_context == [] and out["1"].escalated is False


@pytest.mark.parametrize("parts", [1, 8])
def test_first_reply_by_time_then_number(spark, parts):
    rows = [tweet(1, "u", "help"), tweet(10, B, "ten", up=1), tweet(9, B, "nine", up=1)]
    assert build(spark, rows, parts)["1"].brand_reply == "nine"
    late = "Wed Oct 11 06:55:44 +0000 2017"
    early = "Tue Oct 10 06:55:44 +0000 2017"
    rows = [tweet(1, "u", "help"), tweet(9, B, "late", up=1, at=late),
            tweet(10, B, "early", up=1, at=early)]
    assert build(spark, rows, parts)["1"].brand_reply == "early"


@pytest.mark.parametrize("n", [1, 3, 12])
def test_parts_are_stitched_in_order(spark, n):
    rows = [tweet(1, "u", "help", down=100)]
    rows += [tweet(100 + i, B, f"p{i} {i + 1} ^EZ" if i else "p0 ^TJ",
                   up=99 + i if i else 1, down=101 + i if i < n - 1 else None) for i in range(n)]
    want = " ".join(["p0 ^TJ", *[f"p{i}" for i in range(1, n)]])
    assert build(spark, rows)["1"].brand_reply == want


def test_cycles_end(spark):
    rows = [tweet(1, "u", "a"), tweet(2, B, "x", up=1, down=3), tweet(3, B, "y", up=2, down=2),
            tweet(4, "u", "b"), tweet(5, B, "self", up=4, down=5),
            tweet(6, "u", "c"), tweet(7, B, "in", up=6, down=8), tweet(8, B, "r1", down=9),
            tweet(9, B, "r2", down=10), tweet(10, B, "r3", down=8)]
    out = build(spark, rows)
    assert {k: v.brand_reply for k, v in out.items()} == {
        "1": "x y", "4": "self", "6": "in r1 r2 r3"}


def test_chains_may_merge(spark):
    rows = [tweet(1, "u", "a"), tweet(2, B, "x", up=1, down=5), tweet(3, "u", "b"),
            tweet(4, B, "y", up=3, down=5), tweet(5, B, "shared", down=6), tweet(6, B, "end")]
    assert {k: v.brand_reply for k, v in build(spark, rows).items()} == {
        "1": "x shared end", "3": "y shared end"}


def test_comma_list_stops_unless_expanded(spark):
    rows = [tweet(1, "u", "a"), tweet(2, B, "x", up=1, down="11,9,7"), tweet(11, B, "eleven"),
            tweet(9, B, "nine"), tweet(7, "u", "seven")]
    assert build(spark, rows)["1"].brand_reply == "x"
    assert build(spark, rows, expand_responses=True)["1"].brand_reply == "x nine"


def test_prior_context_oldest_first_six_at_most(spark):
    rows = [tweet(i, "u" if i % 2 else "other", f"t{i} @5", up=i - 1 if i > 1 else None)
            for i in range(1, 10)]
    rows.append(tweet(50, B, "reply", up=9))
    turns = build(spark, rows)["9"].prior_context
    assert [t.text for t in turns] == [f"t{i} @USER" for i in range(3, 9)]
    assert [t.author for t in turns][:2] == ["u", "other"]


def test_missing_ancestor_ends_the_walk(spark):
    rows = [tweet(3, "u", "c", up=2), tweet(2, B, "b", up=1), tweet(4, B, "r", up=3)]
    assert [t.text for t in build(spark, rows)["3"].prior_context] == ["b"]


def test_shared_parent_gives_everyone_the_same_context(spark):
    rows = [tweet(1, "u", "news")]
    for i in range(10, 40, 2):
        rows += [tweet(i, "u", f"c{i}", up=1), tweet(i + 1, B, f"r{i}", up=i)]
    out = build(spark, rows)
    assert len(out) == 15
    assert all([t.text for t in r.prior_context] == ["news"] for r in out.values())


def test_hand_off_flag_and_totals(spark):
    rows = [tweet(1, "u", "a"), tweet(2, B, "please DM", up=1), tweet(3, "u", "b"),
            tweet(4, B, "restart it", up=3)]
    df = th.build_threads(spark.createDataFrame(rows, TWEETS), B)
    assert th.escalation_totals(df).first().asDict() == {
        "threads": 2, "escalated": 1, "escalation_rate": 0.5}
    assert th.context_share(df).first()["with_context"] == 0


def test_duplicate_ids(spark):
    rows = [tweet(1, "u", "a"), tweet(2, B, "second", up=1, at="Wed Oct 11 06:55:45 +0000 2017"),
            tweet(2, B, "first", up=1, at="Wed Oct 11 06:55:44 +0000 2017")]
    df = spark.createDataFrame(rows, TWEETS)
    assert [r.tweet_id for r in th.duplicate_ids(df).collect()] == ["2"]
    one = th.unique_tweets(df)
    assert one.count() == 2
    assert th.build_threads(one, B).first().brand_reply == "first"


def test_a_dated_reply_beats_one_without_a_readable_date(spark):
    rows = [tweet(1, "u", "help"), tweet(2, B, "undated", up=1), tweet(3, B, "odd", up=1, at="yesterday"),
            tweet(10, B, "late", up=1, at="Wed Oct 11 06:55:45 +0000 2017"),
            tweet(11, B, "tied", up=1, at="Wed Oct 11 06:55:44 +0000 2017"),
            tweet(9, B, "first", up=1, at="Wed Oct 11 06:55:44 +0000 2017")]
    assert build(spark, rows)["1"].brand_reply == "first"
    assert build(spark, rows[:3])["1"].brand_reply == "undated"


def test_chains_are_never_broadcast(spark):
    """Ids in a row take few bytes in a file and many in memory."""
    edges = materialise(spark.range(3000).selectExpr("cast(id as string) as node", "cast(id + 1 as string) as next"),
                        "edges")
    plan = th._four_hops(edges)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    starts = edges.where("node = '2990'").select(edges.node.alias("start"))
    assert {r.pos: r.node for r in th.follow(starts, edges).collect()} == {i: str(2990 + i) for i in range(11)}
