"""Queries of places. Distances are compared to six digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import geo as g, zsets
from keelson.plans.base import query
from keelson.sources import adapters as a

PLACES = "(SELECT 'customers' AS key, c_name AS member, (c_custkey * 7919) % 36000 / 100 - 180 AS lon, (c_custkey * 104729) % 18001 / 100 - 90 AS lat FROM customer)"
CELLS = f"(SELECT *, least(CAST(floor((lon + 180.0) / 360.0 * 67108864.0) AS BIGINT), 67108863) AS x, least(CAST(floor((lat + 90.0) / 180.0 * 67108864.0) AS BIGINT), 67108863) AS y FROM {PLACES})"
BITS = " + ".join(f"(((y >> {i}) & 1) << {2 * i}) + (((x >> {i}) & 1) << {2 * i + 1})" for i in range(26))
POS = f"(SELECT key, member, -180.0 + (x + 0.5) / 67108864.0 * 360.0 AS lon, -90.0 + (y + 0.5) / 67108864.0 * 180.0 AS lat FROM {CELLS})"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    u, v = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    return f"2.0 * 6372797.560856 * asin(sqrt({u} * {u} + cos(radians({lat1})) * cos(radians({lat2})) * {v} * {v}))"


@query("geoadd", f"SELECT key, member, CAST({BITS} AS DOUBLE) AS score FROM {CELLS}")
def _(spark, d):
    return g.geoadd(a.places(spark, d))


@query("geopos", f"SELECT key, member, round(lon, 9) AS lon, round(lat, 9) AS lat FROM {POS}")
def _(spark, d):
    return g.geopos(g.geoadd(a.places(spark, d))).select("key", "member", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


STD = f"(SELECT member, {BITS} AS h FROM {CELLS})"
SIGNS = " || ".join(f"substr('{g.ALPHABET}', CAST((h >> {52 - 5 * (i + 1)}) & 31 AS INTEGER) + 1, 1)" for i in range(10))


@query("geohash", f"SELECT member, {SIGNS} || '0' AS hash FROM {STD}")
def _(spark, d):
    return a.places(spark, d).select("member", g.geohash(F.col("lon"), F.col("lat")).alias("hash"))


@query("geodist", f"SELECT a.member AS a, b.member AS b, round(({haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}) / 1000, 6) AS dist FROM {POS} a JOIN {POS} b ON CAST(substr(b.member, 10) AS BIGINT) = CAST(substr(a.member, 10) AS BIGINT) + 1")
def _(spark, d):
    z = g.geoadd(a.places(spark, d))
    n = F.substring("member", 10, 20).cast("long") + 1
    pairs = z.select("key", F.col("member").alias("a"), F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0")).alias("b"))
    return g.geodist(z, pairs, "km").select("a", "b", F.round("dist", 6).alias("dist"))


def near(where: str, order: str = "") -> str:
    return f"SELECT member, round(dist, 6) AS dist FROM (SELECT member, ({haversine('15.0', '37.0', 'lon', 'lat')}) / 1000 AS dist, ({haversine('15.0', 'lat', 'lon', 'lat')}) / 1000 AS across, ({haversine('15.0', '37.0', '15.0', 'lat')}) / 1000 AS along FROM {POS}) WHERE {where} {order}"


@query("geosearch_radius", near("dist < 2000"))
def _(spark, d):
    return g.geosearch(g.geoadd(a.places(spark, d)), 15.0, 37.0, radius=2000.0, unit="km").select("member", F.round("dist", 6).alias("dist"))


@query("geosearch_box_count", near("across <= 2000 AND along <= 1500", "ORDER BY dist, member LIMIT 20"))
def _(spark, d):
    return g.geosearch(g.geoadd(a.places(spark, d)), 15.0, 37.0, box=(4000.0, 3000.0), unit="km", count=20).select("member", F.round("dist", 6).alias("dist"))


@query("geosearchstore_storedist", f"SELECT 'near' AS key, member, dist AS score FROM ({near('dist < 3000', 'ORDER BY dist DESC, member LIMIT 10')})")
def _(spark, d):
    found = g.geosearch(g.geoadd(a.places(spark, d)), 15.0, 37.0, radius=3000.0, unit="km", count=10, reverse=True)
    return found.select(F.lit("near").alias("key"), "member", F.round("dist", 6).alias("score"))


@query("georadiusbymember", f"SELECT b.member, round({haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 4) AS dist FROM {POS} a, {POS} b WHERE a.member = 'Customer#000000007' AND {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 1500000")
def _(spark, d):
    z = g.geoadd(a.places(spark, d))
    p = g.geopos(z)
    centre = F.broadcast(p.where("member = 'Customer#000000007'").select("key", F.col("lon").alias("x"), F.col("lat").alias("y")))  # one row
    found = p.join(centre, "key").withColumn("dist", g.distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))
    return found.where("dist < 1500000").select("member", F.round("dist", 4).alias("dist"))


#: Places given anew: of every third customer that of the next, and of customers that aren't there yet.
MOVED = PLACES.replace("c_name AS member", "CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'new' || c_custkey END AS member").replace("c_custkey * 7919", "(c_custkey + 1) * 7919")
NEW = f"(SELECT key, member, CAST({BITS} AS DOUBLE) AS score FROM {CELLS.replace(PLACES, MOVED)} WHERE member IS NOT NULL)"
OLD = f"(SELECT key, member, CAST({BITS} AS DOUBLE) AS score FROM {CELLS})"


def moved(spark, d):
    from keelson.sources.keyspace import table

    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    lon = (F.pmod((k + 1) * 7919, F.lit(36000)) / 100 - 180).alias("lon")
    member = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat(F.lit("new"), k.cast("string")))
    return g.geoadd(c.select(k.alias("seq"), F.lit("customers").alias("key"), member.alias("member"), lon, (F.pmod(k * 104729, F.lit(18001)) / 100 - 90).alias("lat")).where("member IS NOT NULL"))


for only, value, how in (("NX", "coalesce(o.score, n.score)", "FULL"), ("XX", "coalesce(n.score, o.score)", "LEFT")):
    query(f"geoadd_{only.lower()}", f"SELECT key, member, {value} AS score FROM {OLD} o {how} JOIN {NEW} n USING (key, member)")(lambda spark, d, only=only: zsets.zadd(g.geoadd(a.places(spark, d)), moved(spark, d), only))


@query("geoadd_ch", f"SELECT key, count(*) FILTER (o.score IS NULL) AS added, count(*) FILTER (o.score IS NULL OR n.score <> o.score) AS changed FROM {OLD} o FULL JOIN {NEW} n USING (key, member) GROUP BY key")
def _(spark, d):
    return zsets.zadd_changed(g.geoadd(a.places(spark, d)), moved(spark, d))


@query("georadius_withdist_withhash", f"SELECT member, round(({haversine('-122.4194', '37.7749', 'lon', 'lat')}) / 1609.34, 6) AS dist, hash FROM {POS} JOIN (SELECT member, CAST({BITS} AS BIGINT) AS hash FROM {CELLS}) USING (member) WHERE ({haversine('-122.4194', '37.7749', 'lon', 'lat')}) / 1609.34 < 900")
def _(spark, d):
    z = g.geoadd(a.places(spark, d))
    found = g.geosearch(z, -122.4194, 37.7749, radius=900.0, unit="mi").select("member", F.round("dist", 6).alias("dist"))
    return found.join(z.select("member", F.col("score").cast("long").alias("hash")), "member")


@query("georadius_store", f"SELECT 'found' AS key, member, CAST({BITS} AS DOUBLE) AS score FROM {CELLS} WHERE member IN (SELECT member FROM ({near('dist < 1200')}))")
def _(spark, d):
    z = g.geoadd(a.places(spark, d))
    found = g.geosearch(z, 15.0, 37.0, radius=1200.0, unit="km").select("member")
    return zsets.stored(z.join(found, "member", "left_semi"), "found")
