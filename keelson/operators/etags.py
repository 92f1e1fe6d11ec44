"""Compare-and-set: strings with a version number (etag) that conditional writes test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_etag(log: DataFrame) -> DataFrame:
    """The state after writes (seq, key, value), each of which raises the etag by one."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("etag"))


def getifnotmatch(ks: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (key, seen) with the value only where the etag differs."""
    return seen.join(ks, "key").select("key", "etag", F.when(F.col("etag") != F.col("seen"), F.col("value")).alias("value"))


def setifmatch(ks: DataFrame, writes: DataFrame, expire_at: Column | None = None, noget: bool = False) -> DataFrame:
    """One write (key, new, given) per key at most: it counts if given is the stored etag, which it raises by one.

    With EX or PX a written key has the expiry given; NOGET leaves the value out of what is returned.
    """
    hit = F.col("given").isNotNull() & (F.col("given") == F.col("etag"))
    cells = [] if noget else [F.when(hit, F.col("new")).otherwise(F.col("value")).alias("value")]
    expiry = [] if expire_at is None else [F.when(hit, expire_at).alias("expire_at")]
    return ks.join(writes, "key", "left").select("key", *cells, F.when(hit, F.col("given") + 1).otherwise(F.col("etag")).alias("etag"), *expiry, F.coalesce(hit, F.lit(False)).alias("written"))


def setifgreater(ks: DataFrame, writes: DataFrame, expire_at: Column | None = None, noget: bool = False) -> DataFrame:
    """Any writes (key, new, given): the one with the greatest etag counts if that is above the stored one. EX, PX and
    NOGET as in setifmatch()."""
    best = writes.groupBy("key").agg(F.max(F.struct("given", "new")).alias("w"))
    hit = F.col("w.given") > F.col("etag")
    cells = [] if noget else [F.when(hit, F.col("w.new")).otherwise(F.col("value")).alias("value")]
    expiry = [] if expire_at is None else [F.when(hit, expire_at).alias("expire_at")]
    return ks.join(best, "key", "left").select("key", *cells, F.when(hit, F.col("w.given")).otherwise(F.col("etag")).alias("etag"), *expiry)


def delifgreater(ks: DataFrame, deletes: DataFrame) -> DataFrame:
    top = deletes.groupBy("key").agg(F.max("given").alias("given"))
    return ks.join(top, (ks["key"] == top["key"]) & (top["given"] > ks["etag"]), "left_anti")
