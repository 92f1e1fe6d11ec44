"""Sets: distinct rows (key, member). Several keys combine by one aggregation per member, not by a chain of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.sources.keyspace import draws


def sadd(s: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state after, members added per key)."""
    added = new.select("key", "member").distinct().join(s, ["key", "member"], "left_anti")
    return s.select("key", "member").union(added), added.groupBy("key").agg(F.count("*").alias("added"))


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone, ["key", "member"], "left_anti")


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("card"))


def sismember(s: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, member) with `found`, 0 or 1."""
    return wanted.join(s.select("key", "member", F.lit(1).alias("found")), ["key", "member"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def sinter(s: DataFrame, keys: list[str]) -> DataFrame:
    keys = list(dict.fromkeys(keys))
    return s.where(F.col("key").isin(keys)).groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") == len(keys)).select("member")


def sunion(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(s: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key that no other has: one pass, with a flag per side."""
    first = F.max((F.col("key") == keys[0]).cast("int"))
    rest = F.max(F.col("key").isin(keys[1:]).cast("int"))
    return s.where(F.col("key").isin(keys)).groupBy("member").agg(first.alias("a"), rest.alias("b")).where("a = 1 AND b = 0").select("member")


def sintercard(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = sinter(s, keys).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n")) if limit else n


def stored(members: DataFrame, key: str) -> DataFrame:
    return members.select(F.lit(key).alias("key"), "member")


def smove(s: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """The state after moving a member; nothing changes if the source doesn't have it."""
    moved = F.when((F.col("key") == source) & (F.col("member") == member), F.lit(target)).otherwise(F.col("key"))
    return s.select(moved.alias("key"), "member").distinct()


def srandmember(s: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count distinct members of each key, or with replacement if it is negative."""
    return draws(s, ["key"], "member", count, seed)


def spop(s: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped, left)."""
    popped = srandmember(s, count, seed)
    return popped, s.join(popped, ["key", "member"], "left_anti")
