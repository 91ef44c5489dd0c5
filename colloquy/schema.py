"""Table schemas shared by readers, operators and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TWEETS = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType()),
])

TURN = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
])

THREADS = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("brand_reply", T.StringType()),
    T.StructField("prior_context", T.ArrayType(TURN)),
    T.StructField("escalated", T.BooleanType()),
])

GOLDEN = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("brand_reply", T.StringType()),
    T.StructField("suggested_intent", T.StringType()),
    T.StructField("escalated", T.BooleanType()),
    T.StructField("intent", T.StringType()),
    T.StructField("should_escalate", T.StringType()),
    T.StructField("reply_quality", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("customer_text", T.StringType()),
    T.StructField("true_intent", T.StringType()),
    T.StructField("true_escalate", T.StringType()),
    T.StructField("human_quality", T.StringType()),
    T.StructField("pred_intent", T.StringType()),
    T.StructField("pred_decision", T.StringType()),
    T.StructField("pred_reply", T.StringType()),
    T.StructField("pred_reason", T.StringType()),
])

CACHE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("response", T.StringType()),
])

# The closed set of intents, in label order.
INTENTS = (
    "account_access",
    "billing_subscription",
    "hardware_device",
    "network_connectivity",
    "game_content",
    "app_feature",
    "enforcement_ban",
    "other",
)


def intents_table(spark: SparkSession, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """The intents as a small dimension table ``(ord, intent)``."""
    return spark.createDataFrame(list(enumerate(intents, 1)), "ord int, intent string")
