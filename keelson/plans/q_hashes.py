"""Queries of hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import hashes as h
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import instant, is_live, table

HASH = "(SELECT 'order:' || o_orderkey AS key, unnest(['o_custkey', 'o_orderstatus', 'o_orderpriority']) AS field, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders)"
LOG = "(SELECT l_linenumber AS seq, 'order:' || l_orderkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'o_orderstatus' ELSE 'flag' END AS field, l_returnflag AS value FROM lineitem)"
#: Line numbers repeat in an order, so the log is made one write per place.
UNIQUE = f"(SELECT seq, key, field, min(value) AS value FROM {LOG} GROUP BY ALL)"


def log(spark, d):
    field = F.when(F.col("l_linenumber") % 2 == 0, "o_orderstatus").otherwise("flag")
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("seq"), F.concat(F.lit("order:"), "l_orderkey").alias("key"), field.alias("field"), F.col("l_returnflag").alias("value"))
    by_field = rows.repartition("key", "field")  # one exchange for this aggregation, that of the last write, and the join
    return by_field.groupBy("seq", "key", "field").agg(F.min("value").alias("value"))


@query("hset", f"SELECT key, field, coalesce(n.value, h.value) AS value FROM {HASH} h FULL JOIN (SELECT key, field, arg_max(value, seq) AS value FROM {UNIQUE} GROUP BY ALL) n USING (key, field)")
def _(spark, d):
    return h.hset(a.order_hash(spark, d), log(spark, d))


@query("hset_added", f"SELECT key, count(*) AS added FROM (SELECT DISTINCT key, field FROM {LOG}) n WHERE (key, field) NOT IN (SELECT (key, field) FROM {HASH}) GROUP BY key")
def _(spark, d):
    return h.hset_added(a.order_hash(spark, d), log(spark, d))


@query("hsetnx", f"SELECT key, field, coalesce(h.value, n.value) AS value FROM {HASH} h FULL JOIN (SELECT key, field, arg_min(value, seq) AS value FROM {UNIQUE} GROUP BY ALL) n USING (key, field)")
def _(spark, d):
    return h.hsetnx(a.order_hash(spark, d), log(spark, d))


@query("hget", f"SELECT key, value FROM {HASH} WHERE field = 'o_orderstatus' AND key IN ('order:1', 'order:5', 'order:99')")
def _(spark, d):
    return a.order_hash(spark, d).where("field = 'o_orderstatus' AND key IN ('order:1', 'order:5', 'order:99')").select("key", "value")


@query("hmget", "SELECT 'order:' || o_orderkey AS key, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(NULL AS VARCHAR) AS missing FROM orders")
def _(spark, d):
    return h.hmget(a.order_hash(spark, d), ["o_orderstatus", "o_custkey", "missing"])


@query("hgetall", "SELECT 'order:' || o_orderkey AS key, 'o_custkey=' || o_custkey || ',o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus AS fields FROM orders")
def _(spark, d):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return h.hgetall(a.order_hash(spark, d)).select("key", F.array_join(pairs, ",").alias("fields"))


@query("hkeys_hvals", f"SELECT key, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals FROM {HASH} GROUP BY key")
def _(spark, d):
    m = h.hgetall(a.order_hash(spark, d))
    return m.select("key", F.array_join(F.map_keys("fields"), ",").alias("fields"), F.array_join(F.map_values("fields"), ",").alias("vals"))


@query("hlen", f"SELECT key, count(*) AS len FROM (SELECT DISTINCT key, field FROM {LOG}) GROUP BY key")
def _(spark, d):
    return h.hlen(log(spark, d).select("key", "field").distinct())


@query("hexists", f"SELECT w.key, w.field, CASE WHEN h.value IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT DISTINCT key, field FROM {LOG}) w LEFT JOIN {HASH} h USING (key, field)")
def _(spark, d):
    return h.hexists(a.order_hash(spark, d), log(spark, d).select("key", "field").distinct())


@query("hstrlen", f"SELECT key, field, strlen(value) AS len FROM {HASH}")
def _(spark, d):
    return a.order_hash(spark, d).select("key", "field", F.octet_length("value").cast("long").alias("len"))


@query("hdel", f"SELECT key, field, value FROM {HASH} WHERE (key, field) NOT IN (SELECT DISTINCT (key, field) FROM {LOG})")
def _(spark, d):
    return h.hdel(a.order_hash(spark, d), log(spark, d).select("key", "field").distinct())


DELTAS = "(SELECT 'user:' || user_id AS key, event_type AS field, event_id % 7 AS delta, value FROM events)"


@query("hincrby", f"SELECT key, field, CAST(sum(delta) AS BIGINT) AS value FROM {DELTAS} GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("field"), (F.col("event_id") % 7).alias("delta"))
    return h.hincrby(e.select("key", "field", F.lit("0").alias("value")).limit(0), e)


@query("hincrbyfloat", f"SELECT key, field, round(sum(value), 4) AS value FROM {DELTAS} GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("field"), F.col("value").alias("delta"))
    return h.hincrby(e.select("key", "field", F.lit("0").alias("value")).limit(0), e, "double").withColumn("value", F.round("value", 4))


LOT = "row_number() OVER (PARTITION BY key ORDER BY md5('5:' || key || ':' || field), field)"


@query("hrandfield", f"SELECT key, field, value FROM (SELECT *, {LOT} AS lot FROM {HASH}) WHERE lot <= 2")
def _(spark, d):
    return h.hrandfield(a.order_hash(spark, d), 2, 5).select("key", "field", "value")


@query("hscan_match", f"SELECT key, field FROM {HASH} WHERE key = 'order:7' AND field LIKE 'o_order%' AND field > 'o_orderp' ORDER BY field LIMIT 10")
def _(spark, d):
    from keelson.operators.keys import page

    return page(a.order_hash(spark, d).where("key = 'order:7'").select("key", "field"), "field", "o_orderp", "o_order*", 10)


NOW = "2024-01-15 00:00:00"
TTL = "(SELECT 'user:' || user_id AS key, event_type AS field, max(ts) + INTERVAL 1 DAY AS expire_at FROM events GROUP BY ALL)"


def fields_with_ttl(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("field")).agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("expire_at"))


for condition, test in ((None, "true"), ("NX", "expire_at IS NULL"), ("XX", "expire_at IS NOT NULL"), ("GT", f"TIMESTAMP '{NOW}' > expire_at"), ("LT", f"TIMESTAMP '{NOW}' < expire_at")):
    sql = f"SELECT key, field, epoch_us(CASE WHEN field = 'click' AND ({test}) THEN TIMESTAMP '{NOW}' ELSE expire_at END) // 1000 AS at FROM {TTL}"
    name = "hexpire" + (f"_{condition.lower()}" if condition else "")
    query(name, sql)(lambda spark, d, condition=condition: h.hexpire(fields_with_ttl(spark, d), ["click"], instant(NOW), condition).select("key", "field", F.unix_millis("expire_at").alias("at")))


@query("httl_hpersist", f"SELECT key, field, CASE WHEN field = 'view' THEN -1 ELSE (epoch_us(expire_at) // 1000) - (epoch_us(TIMESTAMP '{NOW}') // 1000) END AS ttl FROM {TTL} WHERE field = 'view' OR expire_at >= TIMESTAMP '{NOW}'")
def _(spark, d):
    from keelson.operators.keys import ttl_ms

    kept = h.hpersist(fields_with_ttl(spark, d), ["view"])
    return kept.where(is_live(instant(NOW))).select("key", "field", ttl_ms(instant(NOW)).alias("ttl"))


@query("hcollect", f"SELECT key, field FROM {TTL} WHERE expire_at >= TIMESTAMP '{NOW}'")
def _(spark, d):
    return fields_with_ttl(spark, d).where(is_live(instant(NOW))).select("key", "field")
