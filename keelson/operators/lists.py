"""Lists: rows (key, pos, value), ordered by pos; an index counts from 0 in its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.sources.keyspace import numbered

KEY = "key"


def indexed(items: DataFrame) -> DataFrame:
    """items with their index; a key may hold most rows (see numbered)."""
    return numbered(items, [KEY], F.asc("pos"))


def with_size(items: DataFrame) -> DataFrame:
    """items with the number `n` of their key's items: a sum of counts, joined."""
    return items.join(items.groupBy(KEY).agg(F.count("*").alias("n")), KEY)


def sized(items: DataFrame) -> DataFrame:
    return with_size(indexed(items))


def ends(items: DataFrame, count: int, left: bool = True) -> DataFrame:
    """The first or last items of each key, numbered from 1 at that end: a top-k, which each task reduces before rows move."""
    order = F.asc("pos") if left else F.desc("pos")
    return items.withColumn("n", F.row_number().over(Window.partitionBy(KEY).orderBy(order))).where(F.col("n") <= count)


def push(items: DataFrame, log: DataFrame) -> DataFrame:
    """The state after pushes (seq, key, side, value): left ones go before, in reverse, right ones behind."""
    edge = items.groupBy(KEY).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    new = log.join(edge, KEY, "left")
    pos = F.when(F.col("side") == "L", F.coalesce("lo", F.lit(0)) - 1 - F.col("seq")).otherwise(F.coalesce("hi", F.lit(0)) + 1 + F.col("seq"))
    return items.select(KEY, "pos", "value").union(new.select(KEY, pos.alias("pos"), "value"))


def push_existing(items: DataFrame, log: DataFrame) -> DataFrame:
    return push(items, log.join(items.select(KEY).distinct(), KEY, "left_semi"))


def pop(items: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped, left over) of each key; popped ones are numbered from 1 in the order in which they go."""
    popped = ends(items, count, left)
    return popped, items.join(popped.select(KEY, "pos"), [KEY, "pos"], "left_anti")


def mpop(items: DataFrame, keys: list[str], count: int = 1, left: bool = True) -> DataFrame:
    """From the first key of the request that has items."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col(KEY))
    rows = items.where(F.col(KEY).isin(keys))
    first = rows.agg(F.min_by(KEY, place).alias(KEY))  # one row
    return pop(rows.join(F.broadcast(first), KEY, "left_semi"), count, left)[0]


def llen(items: DataFrame) -> DataFrame:
    return items.groupBy(KEY).agg(F.count("*").alias("len"))


def lrange(items: DataFrame, start: int, stop: int) -> DataFrame:
    """Items by index: a top-k from either end where both bounds count from it, indexes of all else."""
    if start >= 0 and stop >= 0:
        return ends(items, stop + 1).withColumn("idx", F.col("n") - 1).where(F.col("idx") >= start).drop("n")
    if start < 0 and stop < 0:
        last = ends(items, -start, left=False).where(F.col("n") >= -stop).withColumnRenamed("n", "back")
        return last.join(items.groupBy(KEY).agg(F.count("*").alias("n")), KEY).withColumn("idx", F.col("n") - F.col("back")).drop("n", "back")
    at = lambda i: F.lit(i) if i >= 0 else F.col("n") + i
    return sized(items).where((F.col("idx") >= at(start)) & (F.col("idx") <= at(stop))).drop("n")


def lindex(items: DataFrame, i: int) -> DataFrame:
    return lrange(items, i, i)


def lpos(items: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """Indexes of a value from its rank-th match on, backwards if rank is negative; count 0 means all."""
    rows = sized(items) if rank < 0 and maxlen else indexed(items)
    if maxlen:
        rows = rows.where(F.col("idx") < maxlen if rank > 0 else F.col("idx") >= F.col("n") - maxlen)
    order = F.asc("idx") if rank > 0 else F.desc("idx")
    hits = rows.where(F.col("value") == value)
    if count:
        near = hits.withColumn("hit", F.row_number().over(Window.partitionBy(KEY).orderBy(order))).where(F.col("hit") < abs(rank) + count)
        return near.where(F.col("hit") >= abs(rank)).select(KEY, "idx")
    if abs(rank) == 1:
        return hits.select(KEY, "idx")
    return numbered(hits, [KEY], order, name="hit").where(F.col("hit") >= abs(rank) - 1).select(KEY, "idx")


def lset(items: DataFrame, i: int, value: str) -> DataFrame:
    at = F.lit(i) if i >= 0 else F.col("n") + i
    return sized(items).withColumn("value", F.when(F.col("idx") == at, F.lit(value)).otherwise(F.col("value"))).drop("n")


def linsert(items: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """(key, idx, value) after inserting next to the first match; lists without it stay as they are."""
    rows = indexed(items)
    first = rows.where(F.col("value") == pivot).groupBy(KEY).agg((F.min("idx") + (0 if before else 1)).alias("at"))
    rows = rows.join(first, KEY, "left")
    moved = rows.select(KEY, (F.col("idx") + F.when(F.col("idx") >= F.col("at"), 1).otherwise(0)).alias("idx"), "value")
    new = rows.where(F.col("idx") == 0).where("at IS NOT NULL").select(KEY, F.col("at").alias("idx"), F.lit(value).alias("value"))
    return moved.union(new)


def lrem(items: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first (count > 0), the last (count < 0) or all (0) matches."""
    if count == 0:
        return items.where(F.col("value") != value)
    gone = ends(items.where(F.col("value") == value), abs(count), count > 0).select(KEY, "pos")
    return items.join(gone, [KEY, "pos"], "left_anti")


def ltrim(items: DataFrame, start: int, stop: int) -> DataFrame:
    return lrange(items, start, stop)


def lmove(items: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """The state after moving one item; an empty source moves nothing."""
    ends = items.where(F.col(KEY) == target).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))  # one row
    moved, rest = pop(items.where(F.col(KEY) == source), 1, from_left)
    pos = F.coalesce(F.col("lo") - 1, F.lit(0)) if to_left else F.coalesce(F.col("hi") + 1, F.lit(0))
    into = moved.select("value").join(F.broadcast(ends), F.lit(True)).select(F.lit(target).alias(KEY), pos.alias("pos"), "value")
    return items.where(F.col(KEY) != source).select(KEY, "pos", "value").union(rest.select(KEY, "pos", "value")).union(into)
