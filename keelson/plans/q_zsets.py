"""Queries of sorted sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import zsets as z
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import instant

CUST = "(SELECT 'nation:' || c_nationkey AS key, c_name AS member, c_acctbal AS score FROM customer)"
PART = "(SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS member, p_retailprice AS score FROM part)"
EV = "(SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY ALL)"


def ranked(source: str, how: str = "score, member") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY {how}) - 1 AS rank FROM {source})"


REV = "score DESC, member DESC"


@query("zrange_rev_withscores", f"SELECT key, rank, member, score FROM {ranked(CUST, REV)} WHERE rank <= 9")
def _(spark, d):
    return z.zrange(a.customers_by_nation(spark, d), 0, 9, reverse=True).select("key", "rank", "member", "score")


@query("zrange_index", f"SELECT key, rank, member, score FROM {ranked(PART)} WHERE rank BETWEEN 5 AND 14")
def _(spark, d):
    return z.zrange(a.parts_by_brand(spark, d), 5, 14).select("key", "rank", "member", "score")


@query("zrange_negative", f"SELECT key, rank, member FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {ranked(CUST)}) WHERE rank >= n - 3 AND rank <= n - 1")
def _(spark, d):
    return z.zrange(a.customers_by_nation(spark, d), -3, -1).select("key", "rank", "member")


@query("zrevrange", f"SELECT key, rank, member, score FROM {ranked(PART, REV)} WHERE rank <= 4")
def _(spark, d):
    return z.zrange(a.parts_by_brand(spark, d), 0, 4, reverse=True).select("key", "rank", "member", "score")


@query("zrank", f"SELECT key, member, rank FROM {ranked(CUST)}")
def _(spark, d):
    return z.zrank(a.customers_by_nation(spark, d)).select("key", "member", "rank")


@query("zrevrank_withscore", f"SELECT key, member, rank, score FROM {ranked(EV, REV)}")
def _(spark, d):
    return z.zrank(a.users_by_event(spark, d), reverse=True).select("key", "member", "rank", "score")


@query("zrangebyscore_limit", f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM {CUST} WHERE score > 1000 AND score <= 5000) WHERE r > 2 AND r <= 12")
def _(spark, d):
    return z.zrangebyscore(a.customers_by_nation(spark, d), 1000.0, 5000.0, 2, 10, open_low=True).select("key", "member", "score")


@query("zrevrangebyscore", f"SELECT key, member, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {REV}) - 1 AS rank FROM {CUST} WHERE score >= 0 AND score < 9000) WHERE rank < 5")
def _(spark, d):
    return z.zrangebyscore(a.customers_by_nation(spark, d), 0.0, 9000.0, 0, 5, reverse=True, open_high=True).select("key", "member", "rank", "score")


@query("zrangebylex", f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rank FROM {PART} WHERE member >= '1' AND member < '2'")
def _(spark, d):
    return z.zrangebylex(a.parts_by_brand(spark, d), "[1", "(2").select("key", "member", "rank")


@query("zrevrangebylex", f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS rank FROM {PART} WHERE member > '5'")
def _(spark, d):
    return z.zrangebylex(a.parts_by_brand(spark, d), "(5", "+", reverse=True).select("key", "member", "rank")


@query("zrangestore", f"SELECT 'top' AS key, member, score FROM {ranked(EV, REV)} WHERE key = 'click' AND rank < 10")
def _(spark, d):
    users = a.users_by_event(spark, d).where("key = 'click'")
    return z.stored(z.zrange(users, 0, 9, reverse=True), "top")


@query("zcard", f"SELECT key, count(*) AS card FROM {CUST} GROUP BY key")
def _(spark, d):
    return z.zcard(a.customers_by_nation(spark, d))


@query("zcount", f"SELECT key, count(*) FILTER (score >= 0 AND score < 5000) AS n FROM {CUST} GROUP BY key")
def _(spark, d):
    return z.zcount(a.customers_by_nation(spark, d), z.in_scores(0.0, 5000.0, open_high=True))


@query("zlexcount", f"SELECT key, count(*) FILTER (member > '1' AND member <= '3') AS n FROM {PART} GROUP BY key")
def _(spark, d):
    return z.zcount(a.parts_by_brand(spark, d), z.in_lex("(1", "[3"))


@query("zscore_zmscore", f"SELECT w.key, w.member, s.score FROM (SELECT 'nation:' || (c_nationkey + 1) AS key, c_name AS member FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'nation:' || c_nationkey, c_name FROM customer WHERE c_custkey % 2 = 1) w LEFT JOIN {CUST} s USING (key, member)")
def _(spark, d):
    from keelson.sources.keyspace import table

    c = table(spark, d, "customer")
    odd = (F.col("c_custkey") % 2).cast("int")
    wanted = c.select(F.concat(F.lit("nation:"), (F.col("c_nationkey") + 1 - odd).cast("string")).alias("key"), F.col("c_name").alias("member"))
    return z.zscore(a.customers_by_nation(spark, d), wanted)


def updates(spark, d):
    from keelson.sources.keyspace import table

    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"))


UP = "(SELECT event_id AS seq, event_type AS key, CAST(user_id AS VARCHAR) AS member, value AS score FROM events)"
SEED = f"(SELECT key, member, 50.0::DOUBLE AS score FROM {UP} WHERE CAST(member AS BIGINT) % 3 = 0 GROUP BY ALL)"


def seed(spark, d):
    return updates(spark, d).where("cast(member as bigint) % 3 = 0").select("key", "member").distinct().withColumn("score", F.lit(50.0))


for only, compare, value in (
    (None, None, "coalesce(n.last, o.score)"),
    (None, "GT", "greatest(o.score, n.hi)"),
    (None, "LT", "least(o.score, n.lo)"),
    ("NX", None, "coalesce(o.score, n.first)"),
    ("XX", None, "coalesce(n.last, o.score)"),
):
    join = "LEFT" if only == "XX" else "FULL"
    name = "zadd" + (f"_{only.lower()}" if only else "") + (f"_{compare.lower()}" if compare else "")
    sql = f"SELECT key, member, {value} AS score FROM {SEED} o {join} JOIN (SELECT key, member, max(score) AS hi, min(score) AS lo, arg_max(score, seq) AS last, arg_min(score, seq) AS first FROM {UP} GROUP BY ALL) n USING (key, member)"
    query(name, sql)(lambda spark, d, only=only, compare=compare: z.zadd(seed(spark, d), updates(spark, d), only, compare))


@query("zincrby", f"SELECT key, member, round(sum(score), 4) AS score FROM (SELECT key, member, score FROM {SEED} UNION ALL SELECT key, member, score FROM {UP}) GROUP BY ALL")
def _(spark, d):
    return z.zincrby(seed(spark, d), updates(spark, d)).withColumn("score", F.round("score", 4))


@query("zrem", f"SELECT key, member, score FROM {EV} WHERE CAST(member AS BIGINT) % 5 <> 0")
def _(spark, d):
    users = a.users_by_event(spark, d)
    return z.zrem(users, users.where("cast(member as bigint) % 5 = 0").select("key", "member"))


KEYS, WEIGHTS = ["click", "view", "error"], [1.0, 2.0, 0.5]
WEIGHTED = f"(SELECT member, score * CASE key WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 ELSE 0.5 END AS score FROM {EV} WHERE key IN ('click', 'view', 'error'))"
for how in ("SUM", "MIN", "MAX"):
    query(f"zunion_{how.lower()}", f"SELECT member, {how}(score)::DOUBLE AS score FROM {WEIGHTED} GROUP BY member")(lambda spark, d, how=how: z.zunion(a.users_by_event(spark, d), KEYS, WEIGHTS, how))
    query(f"zinter_{how.lower()}", f"SELECT member, {how}(score)::DOUBLE AS score FROM {WEIGHTED} GROUP BY member HAVING count(*) = 3")(lambda spark, d, how=how: z.zinter(a.users_by_event(spark, d), KEYS, WEIGHTS, how))


@query("zunionstore", f"SELECT 'dst' AS key, member, sum(score)::DOUBLE AS score FROM {EV} WHERE key IN ('click', 'view') GROUP BY member")
def _(spark, d):
    return z.stored(z.zunion(a.users_by_event(spark, d), ["click", "view"]), "dst")


@query("zinterstore", f"SELECT 'dst' AS key, member, sum(score)::DOUBLE AS score FROM {EV} WHERE key IN ('click', 'view') GROUP BY member HAVING count(*) = 2")
def _(spark, d):
    return z.stored(z.zinter(a.users_by_event(spark, d), ["click", "view"]), "dst")


@query("zdiff", f"SELECT member, score FROM {EV} WHERE key = 'click' AND member NOT IN (SELECT member FROM {EV} WHERE key = 'error')")
def _(spark, d):
    return z.zdiff(a.users_by_event(spark, d), ["click", "error"])


@query("zdiffstore", f"SELECT 'dst' AS key, member, score FROM {EV} WHERE key = 'view' AND member NOT IN (SELECT member FROM {EV} WHERE key IN ('error', 'click'))")
def _(spark, d):
    return z.stored(z.zdiff(a.users_by_event(spark, d), ["view", "error", "click"]), "dst")


@query("zintercard_limit", f"SELECT least(count(*), 25) AS n FROM (SELECT member FROM {EV} WHERE key IN ('click', 'view') GROUP BY member HAVING count(*) = 2)")
def _(spark, d):
    return z.zintercard(a.users_by_event(spark, d), ["click", "view"], 25)


for largest, how in ((False, "score, member"), (True, REV)):
    query("zpopmax" if largest else "zpopmin", f"SELECT key, member, score FROM {ranked(CUST, how)} WHERE rank < 3")(lambda spark, d, largest=largest: z.zpop(a.customers_by_nation(spark, d), 3, largest)[0].select("key", "member", "score"))


@query("zmpop", f"SELECT key, member, score FROM {ranked(CUST)} WHERE key = 'nation:3' AND rank < 4")
def _(spark, d):
    return z.zmpop(a.customers_by_nation(spark, d), ["nation:none", "nation:3", "nation:4"], 4).select("key", "member", "score")


@query("zremrangebyrank", f"SELECT key, member, score FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {ranked(CUST)}) WHERE NOT (rank >= 2 AND rank <= n - 4)")
def _(spark, d):
    return z.zremrangebyrank(a.customers_by_nation(spark, d), 2, -4)


@query("zremrangebyscore", f"SELECT key, member, score FROM {CUST} WHERE NOT (score >= 0 AND score <= 8000)")
def _(spark, d):
    return a.customers_by_nation(spark, d).where(~z.in_scores(0.0, 8000.0))


@query("zremrangebylex", f"SELECT key, member, score FROM {PART} WHERE NOT (member >= '1' AND member <= '8')")
def _(spark, d):
    return a.parts_by_brand(spark, d).where(~z.in_lex("[1", "[8"))


LOT = "row_number() OVER (PARTITION BY key ORDER BY md5('7:' || key || ':' || member), member)"


@query("zrandmember", f"SELECT key, member, score FROM (SELECT *, {LOT} AS lot FROM {CUST}) WHERE lot <= 2")
def _(spark, d):
    return z.zrandmember(a.customers_by_nation(spark, d), 2, 7).select("key", "member", "score")


DRAWS = f"SELECT key, draw, CAST('0x' || substr(md5('7:' || key || ':' || draw), 1, 8) AS BIGINT) % n AS lot FROM (SELECT key, count(*) AS n FROM {CUST} GROUP BY key), (SELECT unnest(range(1, 4)) AS draw)"


@query("zrandmember_replacing", f"SELECT key, draw, member, score FROM ({DRAWS}) JOIN (SELECT *, {LOT} - 1 AS lot FROM {CUST}) USING (key, lot)")
def _(spark, d):
    return z.zrandmember(a.customers_by_nation(spark, d), -3, 7).select("key", "draw", "member", "score")


@query("zscan_match", f"SELECT member, score FROM {EV} WHERE key = 'view' AND member LIKE '2%' AND member > '20' ORDER BY member LIMIT 12")
def _(spark, d):
    from keelson.operators.keys import page

    return page(a.users_by_event(spark, d).where("key = 'view'").select("member", "score"), "member", "20", "2*", 12)


@query("bzpopmin_bzpopmax", f"SELECT key, client, member, score FROM (SELECT o_custkey % 5 AS k, o_orderkey AS client, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS rank FROM orders) c JOIN (SELECT *, CASE key WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS k FROM {ranked(EV)}) s USING (k, rank)")
def _(spark, d):
    from keelson.sources.keyspace import table
    from keelson.streaming.blocking import in_turn

    key = F.element_at(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    clients = table(spark, d, "orders").select(key.alias("key"), F.col("o_orderkey").alias("client"), F.col("o_orderkey").alias("at"))
    return in_turn(clients, z.zrank(a.users_by_event(spark, d)).withColumnRenamed("rank", "place"))


@query("bzmpop", f"SELECT key, member, score FROM {ranked(EV, REV)} WHERE key = 'error' AND rank < 2")
def _(spark, d):
    return z.zmpop(a.users_by_event(spark, d), ["absent", "error", "click"], 2, largest=True).select("key", "member", "score")


# -- expiry of members

NOW = "2024-01-20 00:00:00"
TTL = "(SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score, CASE WHEN user_id % 4 > 0 THEN max(ts) + INTERVAL 1 DAY END AS expire_at FROM events GROUP BY event_type, user_id)"
ASKED = "(SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'view' END AS key, CAST(o_custkey AS VARCHAR) AS member FROM orders)"
AT = "TIMESTAMP '2024-01-26'"


def expiring(spark, d):
    from keelson.sources.keyspace import table

    at = F.when(F.col("user_id") % 4 > 0, F.max("ts") + F.expr("INTERVAL 1 DAY"))
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), "user_id").agg(F.count("*").cast("double").alias("score"), at.alias("expire_at"))
    return rows.select("key", F.col("user_id").cast("string").alias("member"), "score", "expire_at")


def asked(spark, d):
    from keelson.sources.keyspace import table

    return table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "click").otherwise("view").alias("key"), F.col("o_custkey").cast("string").alias("member")).distinct()


def millis(df):
    return df.withColumn("at", F.unix_millis("expire_at")).drop("expire_at")


for condition, test in ((None, "true"), ("NX", "expire_at IS NULL"), ("XX", "expire_at IS NOT NULL"), ("GT", f"coalesce({AT} > expire_at, false)"), ("LT", f"coalesce({AT} < expire_at, true)")):
    name = "zexpire_zpexpireat" + (f"_{condition.lower()}" if condition else "")
    query(name, f"SELECT key, member, score, epoch_us(CASE WHEN q.member IS NOT NULL AND ({test}) THEN {AT} ELSE expire_at END) // 1000 AS at FROM {TTL} t LEFT JOIN {ASKED} q USING (key, member)")(
        lambda spark, d, condition=condition: millis(z.zexpire(expiring(spark, d), asked(spark, d), instant("2024-01-26 00:00:00"), instant(NOW), condition)[0])
    )
    query(name + "_replies", f"SELECT key, member, CASE WHEN t.score IS NULL THEN -2 WHEN {test} THEN 1 ELSE 0 END AS reply FROM {ASKED} q LEFT JOIN {TTL} t USING (key, member)")(
        lambda spark, d, condition=condition: z.zexpire(expiring(spark, d), asked(spark, d), instant("2024-01-26 00:00:00"), instant(NOW), condition)[1]
    )


@query("zexpire_in_the_past", f"SELECT key, member, score FROM {TTL} t ANTI JOIN {ASKED} q USING (key, member)")
def _(spark, d):
    return z.zexpire(expiring(spark, d), asked(spark, d), instant("2024-01-02 00:00:00"), instant(NOW))[0].select("key", "member", "score")


LIVE = f"(SELECT * FROM {TTL} WHERE expire_at IS NULL OR expire_at >= TIMESTAMP '{NOW}')"


@query("zttl_zpttl", f"SELECT key, member, CASE WHEN t.score IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE epoch_us(expire_at) // 1000 - epoch_us(TIMESTAMP '{NOW}') // 1000 END AS ttl FROM {ASKED} q LEFT JOIN {LIVE} t USING (key, member)")
def _(spark, d):
    return z.zttl(expiring(spark, d), asked(spark, d), instant(NOW))


@query("zexpiretime_zpexpiretime", f"SELECT key, member, CASE WHEN t.score IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE epoch_us(expire_at) // 1000 END AS at FROM {ASKED} q LEFT JOIN {LIVE} t USING (key, member)")
def _(spark, d):
    return z.zexpiretime(expiring(spark, d), asked(spark, d), instant(NOW))


@query("zpersist", f"SELECT key, member, CASE WHEN t.score IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE 1 END AS reply FROM {ASKED} q LEFT JOIN {TTL} t USING (key, member)")
def _(spark, d):
    return z.zpersist(expiring(spark, d), asked(spark, d))[1]


@query("zpersist_state", f"SELECT key, member, score, epoch_us(CASE WHEN q.member IS NULL THEN expire_at END) // 1000 AS at FROM {TTL} t LEFT JOIN {ASKED} q USING (key, member)")
def _(spark, d):
    return millis(z.zpersist(expiring(spark, d), asked(spark, d))[0])


@query("zcollect", f"SELECT key, member, score FROM {LIVE}")
def _(spark, d):
    return z.zcollect(expiring(spark, d), instant(NOW)).select("key", "member", "score")


#: Writes to expiring members: of odd users the score that they have, of others their number.
WRITES = "(SELECT event_id AS seq, event_type AS key, CAST(user_id AS VARCHAR) AS member, CASE WHEN user_id % 2 = 1 THEN CAST(count(*) OVER (PARTITION BY event_type, user_id) AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) END AS score FROM events)"


def writes(spark, d):
    from keelson.sources.keyspace import table

    e = table(spark, d, "events")
    n = e.groupBy("event_type", "user_id").agg(F.count("*").cast("double").alias("n"))
    return e.join(n, ["event_type", "user_id"]).select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.when(F.col("user_id") % 2 == 1, F.col("n")).otherwise((F.col("event_id") % 50).cast("double")).alias("score"))


for only, compare, value, counts in (
    (None, None, "n.last", "true"),
    (None, "GT", "greatest(o.score, n.hi)", "w.score >= o.score"),
    (None, "LT", "least(o.score, n.lo)", "w.score <= o.score"),
    ("NX", None, "coalesce(o.score, n.first)", "w.score = o.score"),
):
    name = "zadd_drops_ttl" + (f"_{only.lower()}" if only else "") + (f"_{compare.lower()}" if compare else "")
    sql = f"""WITH t AS MATERIALIZED (SELECT * FROM {LIVE}), w AS MATERIALIZED (SELECT * FROM {WRITES}),
        n AS (SELECT key, member, max(score) AS hi, min(score) AS lo, arg_max(score, seq) AS last, arg_min(score, seq) AS first FROM w GROUP BY ALL),
        touched AS (SELECT DISTINCT w.key, w.member FROM w JOIN t o USING (key, member) WHERE {counts})
        SELECT key, member, coalesce({value}, o.score) AS score, epoch_us(CASE WHEN (key, member) NOT IN (SELECT (key, member) FROM touched) THEN o.expire_at END) // 1000 AS at FROM t o FULL JOIN n USING (key, member)"""
    query(name, sql)(lambda spark, d, only=only, compare=compare: millis(z.zadd_expiring(expiring(spark, d), writes(spark, d), instant(NOW), only, compare)))


@query("zadd_ch", f"SELECT key, count(*) FILTER (o.score IS NULL) AS added, count(*) FILTER (o.score IS NULL OR greatest(o.score, n.hi) <> o.score) AS changed FROM {SEED} o FULL JOIN (SELECT key, member, max(score) AS hi FROM {UP} GROUP BY ALL) n USING (key, member) GROUP BY key")
def _(spark, d):
    return z.zadd_changed(seed(spark, d), updates(spark, d), compare="GT")


@query("zadd_incr", f"SELECT max(score) + 2.5 AS score FROM {EV} WHERE key = 'click' AND member = '3'")
def _(spark, d):
    return z.zadd_incr(a.users_by_event(spark, d), "click", "3", 2.5, compare="GT")
