"""Queries of bitmaps, bit fields, roaring bitmaps and distinct counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import bits as b
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import table

BITS = "(SELECT DISTINCT event_type AS key, user_id AS off FROM events)"
LOG = "(SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'view' END AS key, o_custkey AS off, CAST(o_orderkey % 3 > 0 AS INTEGER) AS bit FROM orders)"


def log(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, "click").otherwise("view").alias("key"), F.col("o_custkey").alias("off"), (F.col("o_orderkey") % 3 > 0).cast("int").alias("bit"))


SET = f"SELECT key, off FROM {BITS} WHERE (key, off) NOT IN (SELECT (key, off) FROM (SELECT key, off, arg_max(bit, seq) AS bit FROM {LOG} GROUP BY ALL) WHERE bit = 0) UNION SELECT key, off FROM (SELECT key, off, arg_max(bit, seq) AS bit FROM {LOG} GROUP BY ALL) WHERE bit = 1"
for name in ("setbit", "r_setbit"):
    query(name, SET)(lambda spark, d: b.setbit(a.event_bits(spark, d), log(spark, d)))

GET = f"SELECT w.key, w.off, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS bit FROM (SELECT DISTINCT 'click' AS key, o_custkey AS off FROM orders) w LEFT JOIN {BITS} s USING (key, off)"
for name in ("getbit", "r_getbit"):
    query(name, GET)(lambda spark, d: b.getbit(a.event_bits(spark, d), table(spark, d, "orders").select(F.lit("click").alias("key"), F.col("o_custkey").alias("off")).distinct()))


for name in ("bitcount", "r_bitcount"):
    query(name, f"SELECT key, count(*) AS n FROM {BITS} GROUP BY key")(lambda spark, d: b.bitcount(a.event_bits(spark, d)))


@query("bitcount_range", f"SELECT key, count(*) FILTER (off BETWEEN 16 AND 63) AS n FROM {BITS} GROUP BY key")
def _(spark, d):
    return b.bitcount(a.event_bits(spark, d), 2, 7)


for name in ("bitpos_one", "r_bitpos_one"):
    query(name, f"SELECT key, coalesce(min(off) FILTER (off >= 40), -1) AS pos FROM {BITS} GROUP BY key")(lambda spark, d: b.bitpos_one(a.event_bits(spark, d), 40))

ZERO = f"SELECT k.key, min(o.off) AS pos FROM (SELECT DISTINCT key FROM {BITS}) k, (SELECT unnest(range(3, (SELECT max(user_id) + 3 FROM events))) AS off) o WHERE (k.key, o.off) NOT IN (SELECT (key, off) FROM {BITS}) GROUP BY k.key"
for name in ("bitpos_zero", "r_bitpos_zero"):
    query(name, ZERO)(lambda spark, d: b.bitpos_zero(a.event_bits(spark, d), 3))

C, V = f"SELECT off FROM {BITS} WHERE key = 'click'", f"SELECT off FROM {BITS} WHERE key = 'view'"
for op, sql in (("AND", f"{C} INTERSECT {V}"), ("OR", f"{C} UNION {V}"), ("XOR", f"({C} EXCEPT {V}) UNION ({V} EXCEPT {C})"), ("DIFF", f"{C} EXCEPT {V}")):
    query(f"bitop_{op.lower()}", sql)(lambda spark, d, op=op: b.bitop(a.event_bits(spark, d), op, ["click", "view"]))


@query("bitop_not", f"SELECT unnest(range(0, (SELECT CAST(max(off) // 8 * 8 + 8 AS BIGINT) FROM {BITS} WHERE key = 'click'))) AS off EXCEPT {C}")
def _(spark, d):
    return b.bitop(a.event_bits(spark, d), "NOT", ["click"])


@query("bitfield_get", "SELECT p_partkey AS id, CAST(ascii(p_name[1]) AS BIGINT) AS u8, CAST((ascii(p_name[1]) & 15) * 16 + (ascii(p_name[2]) >> 4) AS BIGINT) AS mid, CAST(CASE WHEN (ascii(p_name[1]) & 31) >= 16 THEN (ascii(p_name[1]) & 31) - 32 ELSE ascii(p_name[1]) & 31 END AS BIGINT) AS i5 FROM part")
def _(spark, d):
    v = F.col("p_name").cast("binary")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), b.field(v, "u8", 0).alias("u8"), b.field(v, "u8", 4).alias("mid"), b.field(v, "i5", 3).alias("i5"))


@query("bitfield_incrby", "WITH s AS (SELECT p_partkey AS id, p_partkey % 256 - 128 AS v, p_size * 4 AS delta FROM part) SELECT id, CAST((v + delta + 128) % 256 - 128 AS BIGINT) AS wrapped, CAST(least(v + delta, 127) AS BIGINT) AS held, CASE WHEN v + delta <= 127 THEN CAST(v + delta AS BIGINT) END AS checked FROM s")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 256 - 128).alias("v"), (F.col("p_size") * 4).alias("delta"))
    return p.select("id", *[b.overflowed(F.col("v"), F.col("delta"), "i8", how).alias(name) for how, name in (("WRAP", "wrapped"), ("SAT", "held"), ("FAIL", "checked"))])


def seen(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value"))


@query("setbit_replies", f"SELECT seq, key, off, coalesce(lag(bit) OVER (PARTITION BY key, off ORDER BY seq), CASE WHEN s.stored THEN 1 ELSE 0 END) AS previous FROM {LOG} LEFT JOIN (SELECT *, true AS stored FROM {BITS}) s USING (key, off)")
def _(spark, d):
    return b.setbit_replies(a.event_bits(spark, d), log(spark, d))


@query("bitfield_set", "SELECT p_partkey AS id, lower(hex(encode(p_name[1]))) AS was, lower(printf('%02x%02x', (ascii(p_name[1]) & 240) + ((p_partkey & 255) >> 4), ((p_partkey & 15) << 4) + (ascii(p_name[2]) & 15))) AS head FROM part")
def _(spark, d):
    v = F.col("p_name").cast("binary")
    new = b.set_field(v, "u8", 4, F.col("p_partkey"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.hex(F.substring(v, 1, 1))).alias("was"), F.lower(F.hex(F.substring(new, 1, 2))).alias("head"))


@query("bitfield_fail", "SELECT p_partkey AS id, CASE WHEN p_partkey % 128 + p_size * 4 <= 127 THEN CAST(p_partkey % 128 + p_size * 4 AS BIGINT) END AS reply, CASE WHEN p_partkey % 128 + p_size * 4 <= 127 THEN CAST(p_partkey % 128 + p_size * 4 AS BIGINT) ELSE 0 END AS after FROM part")
def _(spark, d):
    stored = F.unhex(F.lpad(F.hex(F.col("p_partkey") % 128), 2, "0"))
    reply, after = b.bitfield_incrby(stored, "i8", 0, F.col("p_size") * 4, "FAIL")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), reply.alias("reply"), b.field(after, "i8", 0).alias("after"))


#: The standard error of a sketch of 2^14 registers is below 1 %; four of them, and one for small counts.
CLOSE = "abs(n - exact) <= 0.04 * exact + 1"


@query("pfcount", "SELECT event_type AS key, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY event_type")
def _(spark, d):
    exact = seen(spark, d).groupBy("key").agg(F.countDistinct("value").alias("exact"))
    return b.pfcount(b.pfadd(seen(spark, d))).join(exact, "key").select("key", "exact", F.expr(CLOSE).alias("close"))


@query("pfmerge", "SELECT count(DISTINCT user_id) AS exact, true AS close FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    exact = seen(spark, d).where("key IN ('click', 'view')").agg(F.countDistinct("value").alias("exact"))  # one row
    merged = b.pfmerge(b.pfadd(seen(spark, d)), ["click", "view"]).select(F.hll_sketch_estimate("sketch").alias("n"))
    return merged.crossJoin(exact).select("exact", F.expr(CLOSE).alias("close"))


@query("pfadd_changed", "SELECT event_type AS key, bool_or(user_id < 0) AS changed FROM events GROUP BY event_type")
def _(spark, d):
    return b.pfadd_changed(seen(spark, d), seen(spark, d).distinct())
