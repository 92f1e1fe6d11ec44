"""Hashes: rows (key, field, value), each field with an expiry of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.keyspace import draws, first_of, latest


def hset(h: DataFrame, log: DataFrame) -> DataFrame:
    """The state after log (seq, key, field, value): the last write of a field counts."""
    new = latest(log, ["key", "field"]).select("key", "field", F.col("value").alias("new"))
    return h.select("key", "field", "value").join(new, ["key", "field"], "full").select("key", "field", F.coalesce("new", "value").alias("value"))


def hset_added(h: DataFrame, log: DataFrame) -> DataFrame:
    """How many fields the writes add to each key."""
    return log.select("key", "field").distinct().join(h, ["key", "field"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def hsetnx(h: DataFrame, log: DataFrame) -> DataFrame:
    new = first_of(log, ["key", "field"]).join(h, ["key", "field"], "left_anti").select("key", "field", "value")
    return h.select("key", "field", "value").union(new)


def hmget(h: DataFrame, fields: list[str]) -> DataFrame:
    """A column per field, null where a key doesn't have it."""
    return h.where(F.col("field").isin(fields)).groupBy("key").pivot("field", fields).agg(F.first("value"))


def hgetall(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("len"))


def hexists(h: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(h.select("key", "field", F.lit(1).alias("found")), ["key", "field"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone, ["key", "field"], "left_anti")


def hincrby(h: DataFrame, log: DataFrame, kind: str = "long") -> DataFrame:
    """The state after adding log (key, field, delta) to numeric fields; ANSI arithmetic raises on overflow."""
    rows = h.select("key", "field", F.col("value").cast(kind).alias("delta")).union(log.select("key", "field", F.col("delta").cast(kind)))
    return rows.groupBy("key", "field").agg(F.sum("delta").alias("value"))


def hrandfield(h: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count distinct fields of each key, or with replacement if it is negative."""
    return draws(h, ["key"], "field", count, seed)


def hexpire(h: DataFrame, fields: list[str], at: Column, condition: str | None = None) -> DataFrame:
    """Set the expiry of fields under NX, XX, GT or LT; no expiry counts as endless."""
    now = F.col("expire_at")
    allowed = {None: F.lit(True), "NX": now.isNull(), "XX": now.isNotNull(), "GT": now.isNotNull() & (at > now), "LT": now.isNull() | (at < now)}[condition]
    return h.withColumn("expire_at", F.when(F.col("field").isin(fields) & allowed, at).otherwise(now))


def hpersist(h: DataFrame, fields: list[str]) -> DataFrame:
    return h.withColumn("expire_at", F.when(F.col("field").isin(fields), F.lit(None)).otherwise(F.col("expire_at")))
