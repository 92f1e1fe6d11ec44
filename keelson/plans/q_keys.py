"""Queries of keys of any type, transactions, scripts and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import keys as k
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import instant, latest, live, table

PARTS = "(SELECT 'part:' || p_partkey AS key, p_name AS value FROM part)"
NOW = "2024-01-15 12:00:00"
STATE = "(SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS value, arg_max(ts, event_id) + INTERVAL 1 DAY AS expire_at FROM events GROUP BY user_id)"


def state(spark, d):
    rows = a.event_log(spark, d)
    return latest(rows.select("seq", "key", F.col("cmd").alias("value"), "expire_at"), ["key"]).select("key", "value", "expire_at")


@query("oplog_fold", f"SELECT key, value, (epoch_us(expire_at) // 1000) AS at FROM {STATE}")
def _(spark, d):
    return state(spark, d).select("key", "value", F.unix_millis("expire_at").alias("at"))


@query("live_keys_lazy_expiry", f"SELECT key, value FROM {STATE} WHERE expire_at >= TIMESTAMP '{NOW}'")
def _(spark, d):
    return live(state(spark, d), instant(NOW)).select("key", "value")


@query("del_unlink", f"SELECT key, value FROM {PARTS} WHERE key NOT IN (SELECT 'part:' || (o_orderkey * 2) FROM orders)")
def _(spark, d):
    return k.delete(a.part_strings(spark, d), table(spark, d, "orders").select(F.concat(F.lit("part:"), F.col("o_orderkey") * 2).alias("key")))


@query("exists", f"SELECT count(*) AS n FROM (SELECT 'part:' || (o_custkey * 3) AS key FROM orders) w WHERE key IN (SELECT key FROM {PARTS})")
def _(spark, d):
    return k.exists(a.part_strings(spark, d), table(spark, d, "orders").select(F.concat(F.lit("part:"), F.col("o_custkey") * 3).alias("key")))


@query("type_keyspace", "SELECT 'part:' || p_partkey AS key, 'string' AS type FROM part UNION ALL SELECT DISTINCT 'order:' || o_orderkey, 'hash' FROM orders UNION ALL SELECT DISTINCT event_type, 'set' FROM events UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'zset' FROM customer UNION ALL SELECT DISTINCT 'user:' || user_id, 'list' FROM events")
def _(spark, d):
    return k.keyspace({"string": a.part_strings(spark, d), "hash": a.order_hash(spark, d), "set": a.event_users(spark, d), "zset": a.customers_by_nation(spark, d), "list": a.event_list(spark, d)})


for condition, test in ((None, "true"), ("NX", "false"), ("XX", "true"), ("GT", f"TIMESTAMP '2024-01-20' > expire_at"), ("LT", f"TIMESTAMP '2024-01-20' < expire_at")):
    sql = f"SELECT key, epoch_us(CASE WHEN {test} THEN TIMESTAMP '2024-01-20' ELSE expire_at END) // 1000 AS at FROM {STATE} WHERE expire_at >= TIMESTAMP '{NOW}'"
    name = "expire" + (f"_{condition.lower()}" if condition else "")
    query(name, sql)(lambda spark, d, condition=condition: k.expire(live(state(spark, d), instant(NOW)), instant("2024-01-20 00:00:00"), instant(NOW), condition).select("key", F.unix_millis("expire_at").alias("at")))


@query("expire_in_the_past_deletes", f"SELECT key, value FROM {STATE} WHERE expire_at <= TIMESTAMP '2024-01-10'")
def _(spark, d):
    return k.expire(state(spark, d), instant("2024-01-10 00:00:00"), instant(NOW), "LT").select("key", "value")


@query("persist", f"SELECT key, value, -1 AS ttl FROM {STATE}")
def _(spark, d):
    return k.persist(state(spark, d)).select("key", "value", k.ttl_ms(instant(NOW)).cast("int").alias("ttl"))


@query("ttl_pttl", f"SELECT w.key, coalesce((epoch_us(s.expire_at) // 1000) - (epoch_us(TIMESTAMP '{NOW}') // 1000), -2) AS pttl FROM (SELECT 'user:' || c_custkey AS key FROM customer) w LEFT JOIN (SELECT * FROM {STATE} WHERE expire_at >= TIMESTAMP '{NOW}') s USING (key)")
def _(spark, d):
    wanted = table(spark, d, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("key"))
    found = live(state(spark, d), instant(NOW)).select("key", k.ttl_ms(instant(NOW)).alias("p"))
    return wanted.join(found, "key", "left").select("key", F.coalesce("p", F.lit(-2)).alias("pttl"))


@query("expiretime", f"SELECT key, CAST(floor((epoch_us(expire_at) // 1000) / 1000) AS BIGINT) AS s, (epoch_us(expire_at) // 1000) AS ms FROM {STATE}")
def _(spark, d):
    return state(spark, d).select("key", F.unix_seconds("expire_at").alias("s"), F.unix_millis("expire_at").alias("ms"))


def pairs(spark, d):
    return table(spark, d, "part").where("p_partkey % 10 = 1").select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.concat(F.lit("part:"), F.when(F.col("p_partkey") % 20 == 1, F.col("p_partkey") + 1).otherwise(F.col("p_partkey") + 1000000)).alias("new"))


@query("rename", "SELECT 'part:' || CASE WHEN p_partkey % 20 = 1 THEN p_partkey + 1 WHEN p_partkey % 10 = 1 THEN p_partkey + 1000000 ELSE p_partkey END AS key, p_name AS value FROM part WHERE p_partkey % 20 <> 2")
def _(spark, d):
    return k.rename(a.part_strings(spark, d), pairs(spark, d))


@query("renamenx", "SELECT 'part:' || CASE WHEN p_partkey % 20 = 11 OR (p_partkey % 20 = 1 AND p_partkey + 1 NOT IN (SELECT p_partkey FROM part)) THEN p_partkey + CASE WHEN p_partkey % 20 = 11 THEN 1000000 ELSE 1 END ELSE p_partkey END AS key, p_name AS value FROM part")
def _(spark, d):
    return k.rename(a.part_strings(spark, d), pairs(spark, d), only_new=True)


@query("dump_restore", f"SELECT key, value FROM {PARTS}")
def _(spark, d):
    return k.restore(k.dump(a.part_strings(spark, d), ["value"]), "value string")


@query("keys_prefix", f"SELECT key FROM {PARTS} WHERE key LIKE 'part:12%'")
def _(spark, d):
    return k.keys(a.part_strings(spark, d), "part:12*")


@query("keys_glob", f"SELECT key FROM {PARTS} WHERE regexp_full_match(key, 'part:[1-3].[^5-9].*')")
def _(spark, d):
    return k.keys(a.part_strings(spark, d), "part:[1-3]?[^5-9]*")


@query("scan_page", f"SELECT key FROM {PARTS} WHERE key > 'part:1500' AND key LIKE 'part:1%' ORDER BY key LIMIT 25")
def _(spark, d):
    return k.scan(a.part_strings(spark, d), "part:1500", "part:1*", 25)


KINDS = "(SELECT 'part:' || p_partkey AS key, 'string' AS type FROM part UNION ALL SELECT DISTINCT 'order:' || o_orderkey, 'hash' FROM orders UNION ALL SELECT DISTINCT event_type, 'set' FROM events UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'zset' FROM customer UNION ALL SELECT DISTINCT 'user:' || user_id, 'list' FROM events)"


def relations(spark, d):
    return {"string": a.part_strings(spark, d), "hash": a.order_hash(spark, d), "set": a.event_users(spark, d), "zset": a.customers_by_nation(spark, d), "list": a.event_list(spark, d)}


@query("scan_type", f"SELECT key FROM {KINDS} WHERE type = 'hash' AND key LIKE 'order:2%' AND key > 'order:20' ORDER BY key LIMIT 30")
def _(spark, d):
    return k.scan(k.keyspace(relations(spark, d)), "order:20", "order:2*", 30, "hash")


@query("object_encoding_refcount_idletime", f"SELECT key, CASE type WHEN 'string' THEN 'raw' WHEN 'zset' THEN 'skiplist' WHEN 'list' THEN 'quicklist' ELSE 'hashtable' END AS encoding, 1 AS refcount, 0 AS idletime FROM {KINDS}")
def _(spark, d):
    return k.object_info(k.keyspace(relations(spark, d)))


@query("dbsize", f"SELECT count(*) AS n FROM {KINDS}")
def _(spark, d):
    return k.dbsize(relations(spark, d))


@query("expdelscan", f"SELECT count(*) AS deleted FROM {STATE} WHERE expire_at < TIMESTAMP '{NOW}'")
def _(spark, d):
    s = state(spark, d)
    return s.where(F.col("expire_at") < instant(NOW)).agg(F.count("*").alias("deleted"))


@query("flushdb", "SELECT 'part:' || p_partkey AS key FROM part WHERE p_partkey % 4 <> 2")
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("db"), F.concat(F.lit("part:"), "p_partkey").alias("key"))
    return k.flushdb(p, 2).select("key")


@query("swapdb_select", "SELECT 'part:' || p_partkey AS key FROM part WHERE p_partkey % 4 = 3")
def _(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("db"), F.concat(F.lit("part:"), "p_partkey").alias("key"))
    return k.select_db(k.swapdb(p, 1, 3), 1).select("key")


@query("memory_usage", f"SELECT key, CAST(16 + strlen(key) + strlen(value) AS BIGINT) AS bytes FROM {PARTS}")
def _(spark, d):
    return k.memory_usage(a.part_strings(spark, d), ["key", "value"])


@query("watch_exec", "WITH s AS (SELECT user_id, max(event_id) AS version FROM events GROUP BY user_id), w AS (SELECT user_id, max(event_id) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY user_id) SELECT 'user:' || user_id AS key, version = seen AS committed FROM s JOIN w USING (user_id)")
def _(spark, d):
    from keelson.operators.transactions import watched

    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("seq"), "ts")
    return watched(e, e.where("ts < timestamp'2024-01-25 00:00:00 UTC'"))


@query("info_metrics", "SELECT event_type AS cmd, count(*) AS calls, round(avg(value), 6) AS mean, round(max(value), 6) AS worst FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cmd")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("worst"))


@query("slowlog_get", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 32")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(32)


@query("latency_histogram", "SELECT event_type AS cmd, CAST(floor(log2(greatest(value, 1))) AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cmd"), F.floor(F.log2(F.greatest("value", F.lit(1.0)))).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


#: CRC-16 by its table, which is made by the rule, over the bytes of each key.
SLOTS = """WITH RECURSIVE b AS (SELECT x AS byte, x << 8 AS crc, 0 AS i FROM range(256) r(x) UNION ALL SELECT byte, CASE WHEN crc & 32768 <> 0 THEN xor((crc << 1) & 65535, 4129) ELSE (crc << 1) & 65535 END, i + 1 FROM b WHERE i < 8),
t AS MATERIALIZED (SELECT byte, crc FROM b WHERE i = 8),
k AS (SELECT 'order:{' || o_orderkey || '}:x' AS key, CAST(o_orderkey AS VARCHAR) AS tag FROM orders),
c AS (SELECT key, tag, CAST(0 AS BIGINT) AS crc, 1 AS i FROM k UNION ALL SELECT key, tag, xor((c.crc << 8) & 65535, t.crc), i + 1 FROM c JOIN t ON t.byte = xor(c.crc >> 8, ascii(c.tag[i])) WHERE i <= length(tag))"""


@query("countkeysinslot", f"{SLOTS} SELECT CAST(crc % 16384 AS INTEGER) AS slot, count(*) AS n FROM c WHERE i = length(tag) + 1 GROUP BY ALL")
def _(spark, d):
    keys = table(spark, d, "orders").select(F.concat(F.lit("order:{"), F.col("o_orderkey"), F.lit("}:x")).alias("key"))
    return keys.groupBy(k.slot(F.col("key")).alias("slot")).agg(F.count("*").alias("n"))


@query("cluster_keyslot", f"{SLOTS} SELECT key, CAST(crc % 16384 AS INTEGER) AS slot FROM c WHERE i = length(tag) + 1")
def _(spark, d):
    keys = table(spark, d, "orders").select(F.concat(F.lit("order:{"), F.col("o_orderkey"), F.lit("}:x")).alias("key"))
    return keys.select("key", k.slot(F.col("key")).alias("slot"))


LOGGED = "(SELECT event_id AS seq, 'user:' || user_id AS key, event_type AS value, ts FROM events)"


@query("multi_exec", f"WITH l AS (SELECT * FROM {LOGGED}), n AS (SELECT key, max(seq) AS version FROM l GROUP BY key), w AS (SELECT o_orderkey AS tx, 'user:' || o_custkey AS key, seen FROM orders LEFT JOIN (SELECT key, max(seq) AS seen FROM l WHERE ts < TIMESTAMP '2024-01-25' GROUP BY key) s ON s.key = 'user:' || o_custkey) SELECT seq, key, value FROM l UNION ALL SELECT 1000000000 + tx, 'user:' || tx, 'done' FROM w LEFT JOIN n USING (key) WHERE n.version IS NOT DISTINCT FROM w.seen")
def _(spark, d):
    from keelson.operators.transactions import exec_

    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"), "ts")
    seen = rows.where("ts < timestamp'2024-01-25 00:00:00 UTC'").groupBy("key").agg(F.max("seq").alias("seen"))
    o = table(spark, d, "orders")
    watches = o.select(F.col("o_orderkey").alias("tx"), F.concat(F.lit("user:"), "o_custkey").alias("key")).join(seen, "key", "left")
    queued = o.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") + 1000000000).alias("seq"), F.concat(F.lit("user:"), "o_orderkey").alias("key"), F.lit("done").alias("value"))
    return exec_(rows.drop("ts"), queued, watches)


@query("runtxp", "SELECT 'acct:' || c_custkey AS key, CASE WHEN c_custkey % 2 = 1 AND c_acctbal >= 500 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN round(c_acctbal - 500, 2) WHEN c_custkey % 2 = 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 500) THEN round(c_acctbal + 500, 2) ELSE c_acctbal END AS value FROM customer")
def _(spark, d):
    from keelson.operators.transactions import runtxp, transfer

    c = table(spark, d, "customer")
    accounts = c.select(F.concat(F.lit("acct:"), "c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    calls = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("tx"), F.concat(F.lit("acct:"), "c_custkey").alias("source"), F.concat(F.lit("acct:"), F.col("c_custkey") + 1).alias("target"), F.lit(500.0).alias("amount"))
    return runtxp(accounts, calls, transfer).select("key", F.round("value", 2).alias("value"))


@query("custom_object_scan", "SELECT member, n FROM (SELECT CAST(user_id AS VARCHAR) AS member, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) WHERE member LIKE '1%' AND member > '1' ORDER BY member LIMIT 20")
def _(spark, d):
    from keelson.operators.custom import Tally, custom, scan_object

    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("arg"))
    return scan_object(custom(rows.where("key = 'click'"), Tally), "1", "1*", 20).select("member", F.col("value").alias("n"))


@query("custom_object_command", "SELECT event_type AS key, max(n) AS most FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def _(spark, d):
    from keelson.operators.custom import Tally, custom

    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("arg"))
    return custom(rows, Tally).groupBy("key").agg(F.max("value").alias("most"))


@query("script_libraries", "SELECT p_partkey AS id, p_partkey & 255 AS band, xor(p_partkey, p_size) AS bxor, lower(lpad(printf('%x', p_partkey), 8, '0')) AS packed, '{\"n\":' || p_size || ',\"s\":\"' || p_brand || '\"}' AS json FROM part")
def _(spark, d):
    from keelson.functions import scripts

    p = table(spark, d, "part")
    n = F.col("p_partkey")
    return p.select(n.alias("id"), scripts.band(n, F.lit(255)).alias("band"), scripts.bxor(n, F.col("p_size").cast("long")).alias("bxor"), F.lower(F.hex(scripts.pack(n, ">I4"))).alias("packed"), scripts.encode(n=F.col("p_size"), s=F.col("p_brand")).alias("json"))


@query("script_sha1", f"SELECT key, upper(value) AS value, sha1('upper') AS id FROM {PARTS}")
def _(spark, d):
    from keelson.functions.scripts import Scripts

    scripts = Scripts()
    sha = scripts.load("upper", lambda value: F.upper(value))
    return a.part_strings(spark, d).select("key", scripts.call(sha, F.col("value")).alias("value"), F.lit(sha).alias("id"))
