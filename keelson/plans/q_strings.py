"""Queries of strings and of compare-and-set."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import etags, strings as t
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import instant, table

PARTS = "(SELECT 'part:' || p_partkey AS key, p_name AS value FROM part)"
LOG = "(SELECT event_id AS seq, 'part:' || (user_id * 3) AS key, event_type AS value FROM events)"


def log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("part:"), F.col("user_id") * 3).alias("key"), F.col("event_type").alias("value"))


@query("get_mget", f"SELECT o.pos, o.key, p.value FROM (SELECT o_orderkey AS pos, 'part:' || (o_orderkey * 2) AS key FROM orders) o LEFT JOIN {PARTS} p USING (key)")
def _(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("part:"), F.col("o_orderkey") * 2).alias("key"))
    return t.get(a.part_strings(spark, d), wanted)


@query("get_point", f"SELECT key, value FROM {PARTS} WHERE key = 'part:42'")
def _(spark, d):
    return a.part_strings(spark, d).where("key = 'part:42'")


@query("set_mset", f"SELECT key, coalesce(n.value, p.value) AS value FROM {PARTS} p FULL JOIN (SELECT key, arg_max(value, seq) AS value FROM {LOG} GROUP BY key) n USING (key)")
def _(spark, d):
    return t.set_(a.part_strings(spark, d), log(spark, d))


@query("set_nx_setnx", f"SELECT key, coalesce(p.value, n.value) AS value FROM {PARTS} p FULL JOIN (SELECT key, arg_min(value, seq) AS value FROM {LOG} GROUP BY key) n USING (key)")
def _(spark, d):
    return t.set_(a.part_strings(spark, d), log(spark, d), "NX")


@query("set_xx", f"SELECT key, coalesce(n.value, p.value) AS value FROM {PARTS} p LEFT JOIN (SELECT key, arg_max(value, seq) AS value FROM {LOG} GROUP BY key) n USING (key)")
def _(spark, d):
    return t.set_(a.part_strings(spark, d), log(spark, d), "XX")


@query("setex_psetex", "SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS value, (epoch_us(arg_max(ts, event_id)) // 1000) + 90000 AS at FROM events GROUP BY user_id")
def _(spark, d):
    from keelson.sources.keyspace import latest

    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("expire_at"))
    return latest(rows, ["key"]).select("key", "value", F.unix_millis("expire_at").alias("at"))


@query("getset", f"SELECT seq, key, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM {LOG}")
def _(spark, d):
    return t.getset(log(spark, d)).select("seq", "key", "old")


@query("getdel", f"SELECT DISTINCT key, value FROM (SELECT key FROM {LOG}) LEFT JOIN {PARTS} USING (key)")
def _(spark, d):
    return t.getdel(a.part_strings(spark, d), log(spark, d))[0]


@query("getdel_state", f"SELECT key, value FROM {PARTS} WHERE key NOT IN (SELECT key FROM {LOG})")
def _(spark, d):
    return t.getdel(a.part_strings(spark, d), log(spark, d))[1]


NOW = "2024-01-20 00:00:00"
KEYED = "(SELECT 'part:' || p_partkey AS key, p_name AS value, CASE WHEN p_partkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 40) END AS expire_at FROM part)"
LIVE = f"(SELECT * FROM {KEYED} WHERE expire_at IS NULL OR expire_at >= TIMESTAMP '{NOW}')"


def keyed(spark, d):
    at = F.when(F.col("p_partkey") % 3 > 0, F.lit("2024-01-01 00:00:00 UTC").cast("timestamp") + F.make_dt_interval((F.col("p_partkey") % 40).cast("int")))
    return table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.col("p_name").alias("value"), at.alias("expire_at"))


def millis(df):
    return df.withColumn("at", F.unix_millis("expire_at")).drop("expire_at")


@query("getex", f"SELECT DISTINCT key, value FROM (SELECT key FROM {LOG}) LEFT JOIN {LIVE} USING (key)")
def _(spark, d):
    return t.getex(keyed(spark, d), log(spark, d), instant(NOW), instant("2024-02-01 00:00:00"))[0]


for name, at, how in (("getex_ex", "TIMESTAMP '2024-02-01'", {"expire_at": "2024-02-01 00:00:00"}), ("getex_persist", "NULL", {"persist": True}), ("getex_none", "expire_at", {})):
    query(name, f"SELECT key, value, epoch_us(CASE WHEN key IN (SELECT key FROM {LOG}) THEN {at} ELSE expire_at END) // 1000 AS at FROM {LIVE}")(
        lambda spark, d, how=how: millis(t.getex(keyed(spark, d), log(spark, d), instant(NOW), **{k: instant(v) if k == "expire_at" else v for k, v in how.items()})[1])
    )


def rewritten(spark, d):
    return log(spark, d).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


NEW = f"(SELECT key, arg_max(value, seq) AS new FROM {LOG} GROUP BY key)"
for name, test, at, how in (
    ("set_keepttl", "n.new IS NOT NULL", "expire_at", {"keep": True}),
    ("set_ex_nx", "n.new IS NOT NULL AND value IS NULL", "TIMESTAMP '2024-02-01'", {"only": "NX", "expire_at": "2024-02-01 00:00:00"}),
    ("set_px_xx", "n.new IS NOT NULL AND value IS NOT NULL", "TIMESTAMP '2024-02-01'", {"only": "XX", "expire_at": "2024-02-01 00:00:00"}),
):
    rows = f"SELECT key, CASE WHEN {test} THEN n.new ELSE value END AS value, epoch_us(CASE WHEN {test} THEN {at} ELSE expire_at END) // 1000 AS at FROM {KEYED} p {'LEFT' if how.get('only') == 'XX' else 'FULL'} JOIN {NEW} n USING (key)"
    query(name, rows)(lambda spark, d, how=how: millis(t.set_with(keyed(spark, d), rewritten(spark, d), **{k: instant(v) if k == "expire_at" else v for k, v in how.items()})[0]))


@query("set_get", f"SELECT key, value AS old FROM {NEW} LEFT JOIN {KEYED} USING (key)")
def _(spark, d):
    return t.set_with(keyed(spark, d), rewritten(spark, d))[1]


@query("getrange_substr", f"SELECT key, CASE WHEN strlen(value) >= 3 THEN value[-3:] ELSE value END AS tail, value[2:4] AS mid FROM {PARTS}")
def _(spark, d):
    p = a.part_strings(spark, d)
    return p.select("key", t.byte_slice(F.col("value"), -3, -1).cast("string").alias("tail"), t.byte_slice(F.col("value"), 1, 3).cast("string").alias("mid"))


@query("setrange", f"SELECT key, value[1:2] || 'XY' || value[5:] AS value FROM {PARTS}")
def _(spark, d):
    return a.part_strings(spark, d).select("key", t.setrange(F.col("value"), 2, "XY").cast("string").alias("value"))


@query("append", f"SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM {LOG} GROUP BY key")
def _(spark, d):
    return t.append(log(spark, d))


@query("strlen", f"SELECT key, strlen(value) AS len FROM {PARTS}")
def _(spark, d):
    return a.part_strings(spark, d).select("key", F.octet_length("value").cast("long").alias("len"))


@query("incrby_decrby", "SELECT 'user:' || user_id AS key, CAST(sum(CASE WHEN event_type = 'error' THEN -2 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events")
    return t.incrby(e.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.when(F.col("event_type") == "error", -2).otherwise(1).alias("delta")))


@query("incrbyfloat", "SELECT event_type AS key, round(sum(value), 3) AS value FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events")
    return t.incrbyfloat(e.select(F.col("event_type").alias("key"), F.col("value").alias("delta"))).withColumn("value", F.round("value", 3))


@query("msetnx_blocked", f"SELECT key, value FROM {PARTS}")
def _(spark, d):
    p = a.part_strings(spark, d)
    new = p.where("key = 'part:1'").select("key", F.lit("x").alias("value")).union(p.sparkSession.createDataFrame([("fresh", "y")], "key string, value string"))
    return t.msetnx(p, new)


@query("msetnx", f"SELECT key, value FROM {PARTS} UNION ALL SELECT 'fresh', 'y'")
def _(spark, d):
    return t.msetnx(a.part_strings(spark, d), spark.createDataFrame([("fresh", "y")], "key string, value string"))


#: The table of the usual algorithm, row by row: a cell is the best of those before it, of the one above, and of a match.
LCS_ROWS = """WITH RECURSIVE s AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part),
r AS (SELECT id, 0 AS i, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS line FROM s
  UNION ALL SELECT id, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN greatest(line[k], line[k - 1] + 1) ELSE line[k] END)))
  FROM r JOIN s USING (id) WHERE i < length(a))"""


@query("lcs_len", f"{LCS_ROWS} SELECT id, CAST(line[-1] AS INTEGER) AS len FROM r JOIN s USING (id) WHERE i = length(a)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select(F.col("p_partkey").alias("id"), t.lcs_length(F.lower("p_name"), F.lower("p_type")).alias("len"))


@query("lcs_idx", f"{LCS_ROWS} SELECT id AS key, CAST(line[-1] AS INTEGER) AS len, CAST(line[-1] AS INTEGER) AS matched FROM r JOIN s USING (id) WHERE i = length(a)")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return t.lcs(p).select("key", "len", F.aggregate("matches", F.lit(0), lambda s, m: s + m["len"]).alias("matched"))


# compare-and-set
STATE = f"(SELECT key, arg_max(value, seq) AS value, count(*) AS etag FROM {LOG} GROUP BY key)"


@query("setwithetag_getwithetag", f"SELECT key, value, etag FROM {STATE}")
def _(spark, d):
    return etags.with_etag(log(spark, d))


def given(spark, d):
    """A write per user: with the right etag for odd ones."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select(F.concat(F.lit("part:"), F.col("user_id") * 3).alias("key"), F.concat(F.lit("new"), "user_id").alias("new"), F.when(F.col("user_id") % 2 == 1, F.col("n")).otherwise(F.col("n") + 5).alias("given"))


GIVEN = "(SELECT 'part:' || (user_id * 3) AS key, 'new' || user_id AS new, count(*) + CASE WHEN user_id % 2 = 1 THEN 0 ELSE 5 END AS given FROM events GROUP BY user_id)"


@query("getifnotmatch", f"SELECT key, etag, CASE WHEN etag <> given THEN value END AS value FROM {STATE} JOIN {GIVEN} USING (key)")
def _(spark, d):
    return etags.getifnotmatch(etags.with_etag(log(spark, d)), given(spark, d).select("key", F.col("given").alias("seen")))


@query("setifmatch", f"SELECT key, CASE WHEN given = etag THEN new ELSE value END AS value, CASE WHEN given = etag THEN given + 1 ELSE etag END AS etag, given = etag AS written FROM {STATE} JOIN {GIVEN} USING (key)")
def _(spark, d):
    return etags.setifmatch(etags.with_etag(log(spark, d)), given(spark, d))


@query("setifgreater", f"SELECT key, CASE WHEN given > etag THEN new ELSE value END AS value, CASE WHEN given > etag THEN given ELSE etag END AS etag FROM {STATE} JOIN {GIVEN} USING (key)")
def _(spark, d):
    return etags.setifgreater(etags.with_etag(log(spark, d)), given(spark, d))


@query("delifgreater", f"SELECT key, value, etag FROM {STATE} JOIN {GIVEN} USING (key) WHERE given <= etag")
def _(spark, d):
    return etags.delifgreater(etags.with_etag(log(spark, d)), given(spark, d))


@query("setifmatch_ex_noget", f"SELECT key, CASE WHEN given = etag THEN given + 1 ELSE etag END AS etag, CASE WHEN given = etag THEN epoch_us(TIMESTAMP '2024-02-01') // 1000 END AS at, given = etag AS written FROM {STATE} JOIN {GIVEN} USING (key)")
def _(spark, d):
    return millis(etags.setifmatch(etags.with_etag(log(spark, d)), given(spark, d), instant("2024-02-01 00:00:00"), noget=True))


@query("setifgreater_px", f"SELECT key, CASE WHEN given > etag THEN new ELSE value END AS value, CASE WHEN given > etag THEN given ELSE etag END AS etag, CASE WHEN given > etag THEN epoch_us(TIMESTAMP '2024-02-01') // 1000 END AS at FROM {STATE} JOIN {GIVEN} USING (key)")
def _(spark, d):
    return millis(etags.setifgreater(etags.with_etag(log(spark, d)), given(spark, d), instant("2024-02-01 00:00:00")))
