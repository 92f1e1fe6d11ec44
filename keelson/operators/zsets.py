"""Sorted sets: rows (key, member, score), ordered by score (NaN lowest) and then by the member's bytes. Members may
have an expiry of their own (expire_at); one that has passed is as good as absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.sources.keyspace import draws, is_live, numbered


def order(reverse: bool = False) -> list[Column]:
    """The total order; Spark itself puts NaN last."""
    cols = [F.isnan("score").cast("int"), F.col("score"), F.col("member")]
    return [F.asc(cols[0]) if reverse else F.desc(cols[0]), *(c.desc() if reverse else c.asc() for c in cols[1:])]


def zrank(z: DataFrame, reverse: bool = False) -> DataFrame:
    """z with `rank` from 0 in its key; a key may hold most rows (see numbered)."""
    return numbered(z, ["key"], *order(reverse), name="rank")


def first(z: DataFrame, count: int, reverse: bool = False) -> DataFrame:
    """The first members of each key with their rank: a top-k, which each task reduces before rows move."""
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order(reverse))) - 1).where(F.col("rank") < count)


def with_size(z: DataFrame) -> DataFrame:
    """z with the number `n` of its key's members: a sum of counts, joined."""
    return z.join(z.groupBy("key").agg(F.count("*").alias("n")), "key")


def span(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """Inclusive index bounds, negative ones from the end."""
    at = lambda i: F.lit(i) if i >= 0 else size + i
    return F.greatest(at(start), F.lit(0)), at(stop)


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by index: a top-k from either end where both bounds count from it, ranks of all else."""
    if start >= 0 and stop >= 0:
        return first(z, stop + 1, reverse).where(F.col("rank") >= start)
    if start < 0 and stop < 0:
        last = first(z, -start, not reverse).where(F.col("rank") >= -stop - 1).withColumnRenamed("rank", "back")
        return last.join(z.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("rank", F.col("n") - 1 - F.col("back")).drop("n", "back")
    low, high = span(start, stop, F.col("n"))
    return with_size(zrank(z, reverse)).where((F.col("rank") >= low) & (F.col("rank") <= high)).drop("n")


def in_scores(low: float, high: float, open_low: bool = False, open_high: bool = False) -> Column:
    s = F.col("score")
    return ~F.isnan(s) & ((s > low) if open_low else (s >= low)) & ((s < high) if open_high else (s <= high))


def zrangebyscore(z: DataFrame, low: float, high: float, offset: int = 0, count: int | None = None, reverse: bool = False, **opened: bool) -> DataFrame:
    inside = z.where(in_scores(low, high, **opened))
    found = zrank(inside, reverse) if count is None else first(inside, offset + count, reverse)
    return found.where(F.col("rank") >= offset)


def in_lex(low: str, high: str) -> Column:
    """`-` and `+` are open ends, `[` includes, `(` excludes."""
    m = F.col("member")
    above = F.lit(True) if low == "-" else (m >= low[1:]) if low[0] == "[" else (m > low[1:])
    below = F.lit(True) if high == "+" else (m <= high[1:]) if high[0] == "[" else (m < high[1:])
    return above & below


def zrangebylex(z: DataFrame, low: str, high: str, reverse: bool = False) -> DataFrame:
    ends = F.desc("member") if reverse else F.asc("member")
    return numbered(z.where(in_lex(low, high)), ["key"], ends, name="rank")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("card"))


def zcount(z: DataFrame, condition: Column) -> DataFrame:
    """Members of each key that meet a condition; keys without any count 0."""
    return z.groupBy("key").agg(F.count_if(condition).alias("n"))


def zscore(z: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, member) with the score, null where there is none."""
    return wanted.join(z.select("key", "member", "score"), ["key", "member"], "left")


def zadd(z: DataFrame, updates: DataFrame, only: str | None = None, compare: str | None = None) -> DataFrame:
    """The state after updates (seq, key, member, score). only: NX or XX; compare: GT or LT.

    Without compare the last update counts, with it the best; NX takes the first for members that are new.
    """
    best = {None: F.max_by("score", "seq"), "GT": F.max("score"), "LT": F.min("score")}[compare]
    new = updates.groupBy("key", "member").agg((F.min_by("score", "seq") if only == "NX" else best).alias("new"))
    joined = z.select("key", "member", F.col("score").alias("old")).join(new, ["key", "member"], "full" if only != "XX" else "left")
    old, fresh = F.col("old"), F.col("new")
    better = {None: fresh, "GT": F.greatest(old, fresh), "LT": F.least(old, fresh)}[compare]
    value = old if only == "NX" else F.coalesce(better, old)
    return joined.select("key", "member", F.when(old.isNull(), fresh).otherwise(value).alias("score"))


def zincrby(z: DataFrame, updates: DataFrame) -> DataFrame:
    """The state after adding updates (key, member, score)."""
    return z.select("key", "member", "score").union(updates.select("key", "member", "score")).groupBy("key", "member").agg(F.sum("score").alias("score"))


def zrem(z: DataFrame, members: DataFrame) -> DataFrame:
    return z.join(members, ["key", "member"], "left_anti")


def combined(z: DataFrame, keys: list[str], weights: list[float] | None = None) -> DataFrame:
    """The rows of the keys in request order `i`, weighted, a NaN product as 0; a key named twice counts twice."""
    weights = weights or [1.0] * len(keys)
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for i, (k, w) in enumerate(zip(keys, weights, strict=True))])
    rows = z.where(F.col("key").isin(keys)).withColumn("a", F.explode(F.filter(asked, lambda a: a["k"] == F.col("key"))))
    return rows.select("member", "a.i", F.nanvl(F.col("score") * F.col("a.w"), F.lit(0.0)).alias("score"))


def folded(how: str) -> Column:
    """SUM folds in request order, with NaN as 0 at every step (inf and -inf meet); MIN and MAX don't depend on it."""
    if how == "MIN":
        return F.min("score")
    if how == "MAX":
        return F.max("score")
    inf = F.max(F.abs("score")) == float("inf")
    in_turn = F.aggregate(F.array_sort(F.collect_list(F.struct("i", "score"))), F.lit(0.0), lambda a, x: F.nanvl(a + x["score"], F.lit(0.0)))  # as many as keys
    return F.when(inf, in_turn).otherwise(F.sum("score"))


def zunion(z: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "SUM") -> DataFrame:
    return combined(z, keys, weights).groupBy("member").agg(folded(how).alias("score"))


def zinter(z: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "SUM") -> DataFrame:
    found = combined(z, keys, weights).groupBy("member").agg(folded(how).alias("score"), F.count("*").alias("n"))
    return found.where(F.col("n") == len(keys)).select("member", "score")


def zdiff(z: DataFrame, keys: list[str]) -> DataFrame:
    first, rest = z.where(F.col("key") == keys[0]), z.where(F.col("key").isin(keys[1:]))
    return first.select("member", "score").join(rest.select("member"), "member", "left_anti")


def zintercard(z: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = zinter(z, keys).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n")) if limit else n


def stored(result: DataFrame, key: str) -> DataFrame:
    """A result as rows of a key."""
    return result.select(F.lit(key).alias("key"), "member", "score")


def zpop(z: DataFrame, count: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, left) for each key."""
    popped = first(z, count, largest)
    return popped, z.join(popped.select("key", "member"), ["key", "member"], "left_anti")


def zmpop(z: DataFrame, keys: list[str], count: int = 1, largest: bool = False) -> DataFrame:
    """From the first key of the request that has members."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    rows = z.where(F.col("key").isin(keys))
    first = rows.select(place.alias("p"), "key").agg(F.min_by("key", "p").alias("key"))  # one row
    return zpop(rows.join(F.broadcast(first), "key", "left_semi"), count, largest)[0]


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    low, high = span(start, stop, F.col("n"))
    return with_size(zrank(z)).where(~((F.col("rank") >= low) & (F.col("rank") <= high))).select("key", "member", "score")


def zrandmember(z: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count distinct members of each key; a negative count draws with replacement."""
    return draws(z, ["key"], "member", count, seed)


# -- expiry of members


def zadd_expiring(z: DataFrame, updates: DataFrame, now: Column, only: str | None = None, compare: str | None = None) -> DataFrame:
    """zadd() for members with expiries: expired ones count as absent; a write that sets a score, or gives the one that
    is there, takes the member's expiry away; one that NX, GT or LT turns down leaves it."""
    there = z.where(is_live(now))
    state = zadd(there, updates, only, compare)
    old = there.select("key", "member", F.col("score").alias("old"), "expire_at")
    counts = {"NX": F.col("score") == F.col("old")}.get(only, {None: F.lit(True), "GT": F.col("score") >= F.col("old"), "LT": F.col("score") <= F.col("old")}[compare])
    touched = updates.join(old, ["key", "member"]).where(counts).select("key", "member").distinct().withColumn("touched", F.lit(True))
    kept_ = old.drop("old").join(touched, ["key", "member"], "left").where("touched IS NULL").drop("touched")
    return state.join(kept_, ["key", "member"], "left")


def zadd_changed(z: DataFrame, updates: DataFrame, only: str | None = None, compare: str | None = None) -> DataFrame:
    """The reply with CH: per key how many members are added, and how many are added or get another score."""
    both = zadd(z, updates, only, compare).join(z.select("key", "member", F.col("score").alias("old")), ["key", "member"], "left")
    added, moved = F.col("old").isNull(), F.col("old") != F.col("score")
    return both.groupBy("key").agg(F.count_if(added).alias("added"), F.count_if(added | F.coalesce(moved, F.lit(False))).alias("changed"))


def zadd_incr(z: DataFrame, key: str, member: str, by: float, only: str | None = None, compare: str | None = None) -> DataFrame:
    """The reply of ZADD INCR: the new score, null if the options turn it down; a NaN sum is an error."""
    old = z.where((F.col("key") == key) & (F.col("member") == member)).agg(F.max("score").alias("old"))  # one row
    new = F.coalesce(F.col("old") + by, F.lit(by))
    new = F.when(F.isnan(new), F.raise_error(F.lit("resulting score is not a number (NaN)")).cast("double")).otherwise(new)
    refused = {"NX": F.col("old").isNotNull(), "XX": F.col("old").isNull()}.get(only, F.lit(False)) | {"GT": F.coalesce(F.col("old") > new, F.lit(False)), "LT": F.coalesce(F.col("old") < new, F.lit(False))}.get(compare, F.lit(False))
    return old.select(F.when(~refused, new).alias("score"))


def zexpire(z: DataFrame, members: DataFrame, at: Column, now: Column, condition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, replies) after setting the expiry of members (key, member) under NX, XX, GT or LT (no expiry is endless).

    Replies: -2 for a member that isn't there, 2 for one deleted as the time has passed, 0 if the condition fails, else 1.
    """
    old = F.col("expire_at")
    allowed = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[condition]
    reply = F.when(at <= now, 2).when(allowed, 1).otherwise(0)
    asked = members.select("key", "member").distinct()
    rows = z.join(asked.withColumn("asked", F.lit(True)), ["key", "member"], "left").withColumn("reply", F.when(F.col("asked"), reply))
    state = rows.where("reply IS NULL OR reply <> 2").withColumn("expire_at", F.when(F.col("reply") == 1, at).otherwise(old)).select(*z.columns)
    replies = asked.join(rows.where("asked").select("key", "member", "reply"), ["key", "member"], "left").select("key", "member", F.coalesce("reply", F.lit(-2)).alias("reply"))
    return state, replies


def zttl(z: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """members (key, member) with the milliseconds that they have left: -1 without an expiry, -2 if they aren't there."""
    left = F.when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(F.unix_millis("expire_at") - F.unix_millis(now))
    found = z.where(is_live(now)).select("key", "member", left.alias("ttl"))
    return members.join(found, ["key", "member"], "left").select("key", "member", F.coalesce("ttl", F.lit(-2)).alias("ttl"))


def zexpiretime(z: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """members (key, member) with the time in milliseconds at which they expire; -1 and -2 as in zttl."""
    at = F.when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(F.unix_millis("expire_at"))
    found = z.where(is_live(now)).select("key", "member", at.alias("at"))
    return members.join(found, ["key", "member"], "left").select("key", "member", F.coalesce("at", F.lit(-2)).alias("at"))


def zpersist(z: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, replies) after taking expiries away: 1, -1 for a member without one, -2 for one that isn't there."""
    asked = members.select("key", "member").distinct()
    rows = z.join(asked.withColumn("asked", F.lit(True)), ["key", "member"], "left")
    state = rows.withColumn("expire_at", F.when(F.col("asked").isNull(), F.col("expire_at"))).select(*z.columns)
    found = rows.where("asked").select("key", "member", F.when(F.col("expire_at").isNull(), -1).otherwise(1).alias("reply"))
    return state, asked.join(found, ["key", "member"], "left").select("key", "member", F.coalesce("reply", F.lit(-2)).alias("reply"))


def zcollect(z: DataFrame, now: Column) -> DataFrame:
    """The state without members whose time has passed."""
    return z.where(is_live(now))
