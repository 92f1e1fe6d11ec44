"""Queries of lists. Positions are made dense and unique, so results don't depend on ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import lists as li
from keelson.plans.base import query
from keelson.sources.keyspace import table

ITEMS = "(SELECT 'user:' || user_id AS key, event_id AS pos, event_type AS value FROM events)"
IDX = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM {ITEMS})"


def items(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))


PUSHES = "(SELECT o_orderkey AS seq, 'user:' || o_custkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, o_orderstatus AS value FROM orders)"


def pushes(spark, d):
    side = F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("user:"), "o_custkey").alias("key"), side.alias("side"), F.col("o_orderstatus").alias("value"))


PUSHED = f"(SELECT key, pos, value FROM {ITEMS} UNION ALL SELECT p.key, CASE WHEN side = 'L' THEN coalesce(lo, 0) - 1 - seq ELSE coalesce(hi, 0) + 1 + seq END, value FROM {PUSHES} p {{}} JOIN (SELECT key, min(pos) AS lo, max(pos) AS hi FROM {ITEMS} GROUP BY key) USING (key))"


@query("lpush_rpush", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM {PUSHED.format('LEFT')}")
def _(spark, d):
    return li.indexed(li.push(items(spark, d), pushes(spark, d))).select("key", "idx", "value")


@query("lpushx_rpushx", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM {PUSHED.format('INNER')}")
def _(spark, d):
    return li.indexed(li.push_existing(items(spark, d), pushes(spark, d))).select("key", "idx", "value")


for left in (True, False):
    at = "idx" if left else "n - 1 - idx"
    query("lpop_count" if left else "rpop_count", f"SELECT key, {at} + 1 AS n, value FROM {IDX} WHERE {at} < 2")(lambda spark, d, left=left: li.pop(items(spark, d), 2, left)[0].select("key", "n", "value"))


@query("lmpop_blmpop", f"SELECT key, value, idx + 1 AS n FROM {IDX} WHERE key = 'user:3' AND idx < 5")
def _(spark, d):
    return li.mpop(items(spark, d), ["user:none", "user:3", "user:4"], 5).select("key", "value", "n")


@query("blpop_brpop", f"SELECT key, client, value FROM (SELECT 'user:' || o_custkey AS key, o_orderkey AS client, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders) c JOIN {IDX} USING (key, idx)")
def _(spark, d):
    from keelson.streaming.blocking import in_turn

    clients = table(spark, d, "orders").select(F.concat(F.lit("user:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("client"), F.col("o_orderkey").alias("at"))
    return in_turn(clients, li.indexed(items(spark, d)).select("key", F.col("idx").alias("place"), "value"))


@query("llen", f"SELECT key, count(*) AS len FROM {ITEMS} GROUP BY key")
def _(spark, d):
    return li.llen(items(spark, d))


@query("lrange", f"SELECT key, idx, value FROM {IDX} WHERE idx BETWEEN 3 AND 8")
def _(spark, d):
    return li.lrange(items(spark, d), 3, 8).select("key", "idx", "value")


@query("lrange_negative", f"SELECT key, idx, value FROM {IDX} WHERE idx >= n - 4 AND idx <= n - 2")
def _(spark, d):
    return li.lrange(items(spark, d), -4, -2).select("key", "idx", "value")


@query("lindex", f"SELECT key, value FROM {IDX} WHERE idx = n - 1")
def _(spark, d):
    return li.lindex(items(spark, d), -1).select("key", "value")


@query("lpos", f"SELECT key, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS hit FROM {IDX} WHERE value = 'click') WHERE hit BETWEEN 2 AND 4")
def _(spark, d):
    return li.lpos(items(spark, d), "click", 2, 3)


@query("lpos_reverse_maxlen", f"SELECT key, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS hit FROM {IDX} WHERE value = 'view' AND idx >= n - 20)")
def _(spark, d):
    return li.lpos(items(spark, d), "view", -1, 0, 20)


@query("lset", f"SELECT key, idx, CASE WHEN idx = n - 2 THEN 'changed' ELSE value END AS value FROM {IDX}")
def _(spark, d):
    return li.lset(items(spark, d), -2, "changed").select("key", "idx", "value")


FIRST = f"(SELECT *, min(CASE WHEN value = 'error' THEN idx END) OVER (PARTITION BY key) AS p FROM {IDX})"


for before in (True, False):
    at = "p" if before else "p + 1"
    sql = f"SELECT key, idx + CASE WHEN idx >= {at} THEN 1 ELSE 0 END AS idx, value FROM {FIRST} UNION ALL SELECT DISTINCT key, {at}, 'new' FROM {FIRST} WHERE p IS NOT NULL"
    query("linsert_before" if before else "linsert_after", sql)(lambda spark, d, before=before: li.linsert(items(spark, d), "error", "new", before))


for count, name in ((2, "lrem_first"), (-2, "lrem_last"), (0, "lrem_all")):
    order = "DESC" if count < 0 else "ASC"
    gone = "value = 'click'" + (f" AND hit <= {abs(count)}" if count else "")
    query(name, f"SELECT key, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos {order}) AS hit FROM {ITEMS}) WHERE NOT ({gone})")(lambda spark, d, count=count: li.lrem(items(spark, d), count, "click"))


@query("ltrim", f"SELECT key, idx, value FROM {IDX} WHERE idx >= 1 AND idx <= n - 2")
def _(spark, d):
    return li.ltrim(items(spark, d), 1, -2).select("key", "idx", "value")


@query("lmove_rpoplpush_blmove", f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM (SELECT key, pos, value FROM {IDX} WHERE NOT (key = 'user:1' AND idx = n - 1) UNION ALL SELECT 'user:2', -1, value FROM {IDX} WHERE key = 'user:1' AND idx = n - 1)")
def _(spark, d):
    return li.indexed(li.lmove(items(spark, d), "user:1", "user:2", from_left=False, to_left=True)).select("key", "idx", "value")
