"""Queries of sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import sets as s
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import table

EV = "(SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS member FROM events)"
SUPP = "(SELECT DISTINCT 'supp:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem)"


def new_members(spark, d):
    return table(spark, d, "orders").select(F.lit("click").alias("key"), F.col("o_custkey").cast("string").alias("member"))


@query("sadd_added", f"SELECT 'click' AS key, count(*) AS added FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS member FROM orders) n WHERE member NOT IN (SELECT member FROM {EV} WHERE key = 'click')")
def _(spark, d):
    return s.sadd(a.event_users(spark, d), new_members(spark, d))[1]


@query("sadd_state", f"SELECT key, member FROM {EV} UNION SELECT 'click', CAST(o_custkey AS VARCHAR) FROM orders")
def _(spark, d):
    return s.sadd(a.event_users(spark, d), new_members(spark, d))[0]


@query("srem", f"SELECT key, member FROM {EV} WHERE NOT (key = 'view' AND CAST(member AS BIGINT) % 2 = 0)")
def _(spark, d):
    users = a.event_users(spark, d)
    return s.srem(users, users.where("key = 'view' AND cast(member as bigint) % 2 = 0"))


@query("scard", f"SELECT key, count(*) AS card FROM {SUPP} GROUP BY key")
def _(spark, d):
    return s.scard(a.supplier_parts(spark, d))


@query("smembers", f"SELECT member FROM {SUPP} WHERE key = 'supp:1'")
def _(spark, d):
    return a.supplier_parts(spark, d).where("key = 'supp:1'").select("member")


@query("sismember_smismember", f"SELECT w.key, w.member, CASE WHEN e.key IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT DISTINCT 'supp:' || l_suppkey AS key, CAST(l_partkey + 1 AS VARCHAR) AS member FROM lineitem) w LEFT JOIN {SUPP} e USING (key, member)")
def _(spark, d):
    wanted = table(spark, d, "lineitem").select(F.concat(F.lit("supp:"), "l_suppkey").alias("key"), (F.col("l_partkey") + 1).cast("string").alias("member")).distinct()
    return s.sismember(a.supplier_parts(spark, d), wanted)


KEYS = ["supp:1", "supp:2", "supp:3"]
IN = "('supp:1', 'supp:2', 'supp:3')"


@query("sinter", f"SELECT member FROM {EV} WHERE key IN ('click', 'view', 'error') GROUP BY member HAVING count(*) = 3")
def _(spark, d):
    return s.sinter(a.event_users(spark, d), ["click", "view", "error"])


@query("sinterstore", f"SELECT 'dst' AS key, member FROM {SUPP} WHERE key IN ('supp:1', 'supp:2') GROUP BY member HAVING count(*) = 2")
def _(spark, d):
    return s.stored(s.sinter(a.supplier_parts(spark, d), KEYS[:2]), "dst")


@query("sintercard_limit", f"SELECT least(count(*), 40) AS n FROM (SELECT member FROM {EV} WHERE key IN ('click', 'view') GROUP BY member HAVING count(*) = 2)")
def _(spark, d):
    return s.sintercard(a.event_users(spark, d), ["click", "view"], 40)


@query("sunion", f"SELECT DISTINCT member FROM {SUPP} WHERE key IN {IN}")
def _(spark, d):
    return s.sunion(a.supplier_parts(spark, d), KEYS)


@query("sunionstore", f"SELECT DISTINCT 'dst' AS key, member FROM {SUPP} WHERE key IN {IN}")
def _(spark, d):
    return s.stored(s.sunion(a.supplier_parts(spark, d), KEYS), "dst")


@query("sdiff", f"SELECT member FROM {SUPP} WHERE key = 'supp:1' EXCEPT SELECT member FROM {SUPP} WHERE key IN ('supp:2', 'supp:3')")
def _(spark, d):
    return s.sdiff(a.supplier_parts(spark, d), KEYS)


@query("sdiffstore", f"SELECT 'dst' AS key, member FROM (SELECT member FROM {EV} WHERE key = 'click' EXCEPT SELECT member FROM {EV} WHERE key = 'error')")
def _(spark, d):
    return s.stored(s.sdiff(a.event_users(spark, d), ["click", "error"]), "dst")


@query("smove", f"SELECT DISTINCT CASE WHEN key = 'click' AND member = '3' THEN 'moved' ELSE key END AS key, member FROM {EV}")
def _(spark, d):
    return s.smove(a.event_users(spark, d), "click", "moved", "3")


LOT = "row_number() OVER (PARTITION BY key ORDER BY md5('11:' || key || ':' || member), member)"


@query("spop", f"SELECT key, member, 'popped' AS side FROM (SELECT *, {LOT} AS lot FROM {EV}) WHERE lot <= 3 UNION ALL SELECT key, member, 'left' FROM (SELECT *, {LOT} AS lot FROM {EV}) WHERE lot > 3")
def _(spark, d):
    popped, left = s.spop(a.event_users(spark, d), 3, 11)
    return popped.select("key", "member", F.lit("popped").alias("side")).union(left.select("key", "member", F.lit("left").alias("side")))


@query("srandmember", f"SELECT key, member FROM (SELECT *, {LOT} AS lot FROM {EV}) WHERE lot <= 4")
def _(spark, d):
    return s.srandmember(a.event_users(spark, d), 4, 11).select("key", "member")


DRAWS = "SELECT key, draw, CAST('0x' || substr(md5('11:' || key || ':' || draw), 1, 8) AS BIGINT) % n AS lot FROM (SELECT key, count(*) AS n FROM {0} GROUP BY key), (SELECT unnest(range(1, {1})) AS draw)"


@query("srandmember_replacing", f"SELECT key, draw, member FROM ({DRAWS.format(EV, 5)}) JOIN (SELECT *, {LOT} - 1 AS lot FROM {EV}) USING (key, lot)")
def _(spark, d):
    return s.srandmember(a.event_users(spark, d), -4, 11).select("key", "draw", "member")


@query("sscan_match", f"SELECT member FROM {EV} WHERE key = 'click' AND member LIKE '1%' AND member > '10' ORDER BY member LIMIT 10")
def _(spark, d):
    from keelson.operators.keys import page

    return page(a.event_users(spark, d).where("key = 'click'").select("member"), "member", "10", "1*", 10)
