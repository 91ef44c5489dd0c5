from pyspark.sql import functions as F

from colloquy.functions import rules as rl
from colloquy.functions import text as tx
from colloquy.schema import INTENTS


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_redact_handles(spark):
    texts = ["hi @115712 and @name", None, "@12٣ x", "a @7"]
    assert values(spark, texts, tx.redact_handles) == [
        "hi @USER and @name", "", "@USER x", "a @USER"]


def test_strip_agent_suffix(spark):
    texts = ["Try this 1 ^EZ", "Try this ^TJ", "  x 12 ^ABC \n", "keep 2 ^abc"]
    assert values(spark, texts, tx.strip_agent_suffix) == [
        "Try this", "Try this ^TJ", "x", "keep 2 ^abc"]
    assert values(spark, texts[:2], lambda c: tx.strip_agent_suffix(c, True)) == [
        "Try this", "Try this"]


def test_clean(spark):
    texts = ["Hi @Joe, see https://t.co/x!\nNOW", None, "", "café ré 2"]
    assert values(spark, texts, tx.clean) == ["hi see now", "", "", "caf r 2"]


def test_terms_are_words_then_pairs(spark):
    out = values(spark, ["my a big dog", "x", ""],
                 lambda c: tx.unigrams_and_bigrams(tx.tokens(c)))
    assert out == [["my", "big", "dog", "my big", "big dog"], [], []]


def test_resolve_label(spark):
    out = values(spark, ["3", "9", "0", "ban", "", "zzz", "account", "99999999999"],
                 lambda c: tx.resolve_label(c, INTENTS))
    assert out == ["hardware_device", None, None, "enforcement_ban", None, None,
                   "account_access", None]


def test_rating(spark):
    assert values(spark, ["4", "4.7", " 3 ", "x", "", None, "1e99", "nan"], tx.rating) == [
        4, 4, 3, None, None, None, None, None]
    assert values(spark, ["y", " No", "maybe", None], tx.yes_no) == ["yes", "no", None, None]


def test_first_match_takes_the_first_label(spark):
    texts = ["my password for the console", "cost $50", "x$50", "thanks!", None,
             "WON'T turn on", "won’t turn on", "email\nmy account"]
    assert values(spark, texts, lambda c: rl.first_match(c, rl.INTENT_PATTERNS)) == [
        "account_access", "billing_subscription", "billing_subscription", None, None,
        "hardware_device", None, None]


def test_amount_needs_a_word_character_before_the_sign(spark):
    rule = {"m": (r"\b\$\d+\b",)}
    assert values(spark, ["pay $50", "x$50"], lambda c: rl.first_match(c, rule)) == [None, "m"]


def test_handed_off(spark):
    texts = ["send a dm", "adm", "DM us", "Your Gamertag?", "no", None]
    assert values(spark, texts, rl.handed_off) == [True, True, True, True, False, False]


def test_escalation_by_keyword(spark):
    texts = ["I was BANNED", "urban", "it won't turn on", "hello", None]
    assert values(spark, texts, lambda c: rl.escalation_by_keyword(c)[0]) == [
        "escalate", "auto", "escalate", "auto", "auto"]
    assert values(spark, texts[:2], lambda c: rl.escalation_by_keyword(c)[1]) == [
        rl.ESCALATED_REASON, rl.NOT_ESCALATED_REASON]
