"""Transactions: a DataFrame is a batch that is written whole or not at all; WATCH compares versions before that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watched(log: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, committed): whether a key that was seen at some version is still at it."""
    now = log.groupBy("key").agg(F.max("seq").alias("version"))
    then = seen.groupBy("key").agg(F.max("seq").alias("seen"))
    return now.join(then, "key").select("key", (F.col("version") == F.col("seen")).alias("committed"))


def exec_(log: DataFrame, queued: DataFrame, watches: DataFrame) -> DataFrame:
    """The log with the queued writes of transactions none of whose watched keys has moved.

    queued: tx and the columns of log; watches: tx, key, seen (the version at WATCH).
    """
    now = log.groupBy("key").agg(F.max("seq").alias("version"))
    broken = watches.join(now, "key", "left").where(~F.col("version").eqNullSafe(F.col("seen"))).select("tx").distinct()
    return log.unionByName(queued.join(broken, "tx", "left_anti").drop("tx"))


def runtxp(ks: DataFrame, calls: DataFrame, procedure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The state (key, value) after stored procedures: procedure(state, calls) gives the writes (tx, key, value) of the calls
    that commit, all or none of a call's. Calls of one batch mustn't share keys."""
    writes = procedure(ks, calls).select("key", F.col("value").alias("new"))
    return ks.join(writes, "key", "left").select("key", F.coalesce("new", "value").alias("value"))


def transfer(ks: DataFrame, calls: DataFrame) -> DataFrame:
    """A procedure: calls (tx, source, target, amount) move an amount where the source has it and the target exists."""
    source = ks.select(F.col("key").alias("source"), F.col("value").alias("has"))
    target = ks.select(F.col("key").alias("target"), F.col("value").alias("gets"))
    able = calls.join(source, "source").join(target, "target").where(F.col("has") >= F.col("amount"))
    sides = F.array(F.struct(F.col("source").alias("key"), (F.col("has") - F.col("amount")).alias("value")), F.struct(F.col("target").alias("key"), (F.col("gets") + F.col("amount")).alias("value")))
    return able.select("tx", F.explode(sides).alias("w")).select("tx", "w.*")
