"""Messages on channels: subscriptions by name or glob, delivery as a stream, and introspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.glob import glob_match


def subscribe(messages: DataFrame, *channels: str) -> DataFrame:
    """The messages of channels by name; batch or stream."""
    return messages.where(F.col("channel").isin(*channels))


def psubscribe(messages: DataFrame, *patterns: str) -> DataFrame:
    test: Column = F.lit(False)
    for p in patterns:
        test = test | glob_match(F.col("channel"), p)
    return messages.where(test)


def ssubscribe(messages: DataFrame, shards: int, *channels: str) -> DataFrame:
    """Messages of channels, with those of a channel in one partition."""
    return subscribe(messages, *channels).repartition(shards, "channel")


def receivers(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(id, receivers) of each message: how many clients have subscribed to its channel."""
    n = subscriptions.groupBy("channel").agg(F.countDistinct("client").alias("n"))
    return messages.join(n, "channel", "left").select("id", F.coalesce("n", F.lit(0)).alias("receivers"))


def numsub(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("channel").agg(F.countDistinct("client").alias("clients"))


def numpat(patterns: DataFrame) -> DataFrame:
    """How many distinct patterns (pattern, client) clients have subscribed to."""
    return patterns.agg(F.countDistinct("pattern").alias("n"))


def channels(subscriptions: DataFrame, pattern: str = "*") -> DataFrame:
    found = subscriptions.select("channel").distinct()
    return found if pattern == "*" else found.where(glob_match(F.col("channel"), pattern))


def windowed(messages: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per channel and window of event time; `late` is how long a stream waits for stragglers."""
    rows = messages.withWatermark("ts", late) if late else messages
    return rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(messages: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = messages.withWatermark("ts", late) if late else messages
    return rows.groupBy(F.session_window("ts", gap), "channel").agg(F.count("*").alias("n"))
