"""Queries of vector sets and ordered range indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import ranges, vectors as v
from keelson.plans.base import query
from keelson.sources import adapters as a
from keelson.sources.keyspace import table

QUERY = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
L2 = "list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
DOT = "list_inner_product(embedding::DOUBLE[], q::DOUBLE[])"


def nearest(dist: str, where: str = "true", n: int = 10) -> str:
    return f"SELECT CAST(vec_id AS VARCHAR) AS element, round({dist}, 5) AS dist FROM embeddings, {QUERY} WHERE {where} ORDER BY {dist}, CAST(vec_id AS VARCHAR) LIMIT {n}"


def shown(df):
    return df.select("element", F.round("dist", 5).alias("dist"))


@query("vsim_l2", nearest(L2))
def _(spark, d):
    return shown(v.vsim_element(a.vectors(spark, d), "0"))


@query("vsim_cosine", nearest(f"(1 - {DOT} / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(q::DOUBLE[], q::DOUBLE[])))"))
def _(spark, d):
    return shown(v.vsim_element(a.vectors(spark, d), "0", metric="COSINE"))


@query("vsim_ip", nearest(f"(-{DOT})"))
def _(spark, d):
    return shown(v.vsim_element(a.vectors(spark, d), "0", metric="IP"))


@query("vsim_filter", nearest(L2, "label IS NOT NULL AND (label * 2 >= 4 AND NOT vec_id % 3 = 0 OR label IN (0, 1))", 15))
def _(spark, d):
    return shown(v.vsim_element(a.vectors(spark, d), "0", count=15, where=".label * 2 >= 4 and not .id % 3 == 0 or .label in [0, 1]"))


@query("vadd_vcard_vdim_vinfo", "SELECT 'emb' AS key, count(*) + 1 AS card, max(len(embedding)) AS dim FROM embeddings")
def _(spark, d):
    rows = a.vectors(spark, d)
    new = rows.where("element IN ('0', '1')").select(F.lit(1).alias("seq"), "key", F.when(F.col("element") == "0", "fresh").otherwise(F.col("element")).alias("element"), "embedding", "attrs")
    return v.vinfo(v.vadd(rows, new))


@query("vrem_vismember", "SELECT CAST(vec_id AS VARCHAR) AS element FROM embeddings WHERE vec_id % 2 = 0")
def _(spark, d):
    rows = a.vectors(spark, d)
    return v.vrem(rows, rows.where("cast(element as bigint) % 2 = 1").select("key", "element")).select("element")


@query("vgetattr_vsetattr", "SELECT CAST(vec_id AS VARCHAR) AS element, CASE WHEN vec_id = 3 THEN '7' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def _(spark, d):
    rows = a.vectors(spark, d)
    new = spark.createDataFrame([(1, "emb", "3", '{"label":6}'), (2, "emb", "3", '{"label":7}')], "seq long, key string, element string, attrs string")
    return v.vsetattr(rows, new).select("element", F.get_json_object("attrs", "$.label").alias("label"))


@query("vemb", "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings")
def _(spark, d):
    return a.vectors(spark, d).select(F.col("element").cast("long").alias("vec_id"), F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("value"))


@query("vismember", "SELECT CAST(o_orderkey AS VARCHAR) AS element, CASE WHEN o_orderkey IN (SELECT vec_id FROM embeddings) THEN 1 ELSE 0 END AS found FROM orders")
def _(spark, d):
    return v.vismember(a.vectors(spark, d), table(spark, d, "orders").select(F.lit("emb").alias("key"), F.col("o_orderkey").cast("string").alias("element"))).select("element", "found")


M = "list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))"
for kind, cell in (("Q8", f"CASE WHEN {M} = 0 THEN 0.0 ELSE round(x / m * 127) + 0.0 END"), ("BIN", "CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END")):
    query(f"vadd_{kind.lower()}", f"SELECT vec_id, pos, CAST({cell.replace(M, 'm')} AS DOUBLE) AS value FROM (SELECT vec_id, {M} AS m, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)")(
        lambda spark, d, kind=kind: a.vectors(spark, d).select(F.col("element").cast("long").alias("vec_id"), F.posexplode(v.quantised(F.col("embedding"), kind)).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    )


@query("vlinks", f"SELECT of, element, round(dist, 5) AS dist FROM (SELECT CAST(b.vec_id AS VARCHAR) AS of, CAST(a.vec_id AS VARCHAR) AS element, {L2.replace('q)', 'b.embedding)').replace('(embedding', '(a.embedding')} AS dist, row_number() OVER (PARTITION BY b.vec_id ORDER BY dist, CAST(a.vec_id AS VARCHAR)) AS rn FROM embeddings a, embeddings b WHERE b.vec_id IN (1, 2, 3) AND a.vec_id <> b.vec_id) WHERE rn <= 5")
def _(spark, d):
    return v.vlinks(a.vectors(spark, d), ["1", "2", "3"]).select("of", "element", F.round("dist", 5).alias("dist"))


@query("vrandmember", "SELECT element FROM (SELECT CAST(vec_id AS VARCHAR) AS element FROM embeddings) ORDER BY md5('3:emb:' || element), element LIMIT 4")
def _(spark, d):
    return v.vrandmember(a.vectors(spark, d), 4, 3).select("element")


# range indexes: fields in order, and Parquet row groups skipped by their bounds

RANGE = "(SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS field, o_orderpriority AS value FROM orders)"


@query("ri_set_get_del", f"SELECT field, CASE WHEN field = '000000000005' THEN 'changed' ELSE value END AS value FROM {RANGE} WHERE field <> '000000000007'")
def _(spark, d):
    index = ranges.create("orders")
    log = spark.createDataFrame([(1, "orders", "000000000005", "x"), (2, "orders", "000000000005", "changed"), (3, "orders", "000000000007", None)], "seq long, key string, field string, value string")
    return ranges.written(a.order_range(spark, d), log, index).select("field", "value")


@query("ri_create", "SELECT 'orders' AS key, 'DISK' AS backend, 8192 AS max_record_size, 64 AS max_key_len")
def _(spark, d):
    return spark.createDataFrame([ranges.create("orders", max_record_size=8192, max_key_len=64)]).select("key", "backend", F.col("max_record_size").cast("int").alias("max_record_size"), F.col("max_key_len").cast("int").alias("max_key_len"))


@query("ri_scan", f"SELECT field, value FROM {RANGE} WHERE field >= '000000000100' ORDER BY field LIMIT 50")
def _(spark, d):
    return ranges.scanned(a.order_range(spark, d), ranges.create("orders"), "000000000100", 50).select("field", "value")


for fields, cells in (("BOTH", "field, value"), ("KEY", "field"), ("VALUE", "value")):
    query("ri_range" + ("" if fields == "BOTH" else f"_{fields.lower()}"), f"SELECT {cells} FROM {RANGE} WHERE field BETWEEN '000000000100' AND '000000000300'")(
        lambda spark, d, fields=fields: ranges.ranged(a.order_range(spark, d), ranges.create("orders"), "000000000100", "000000000300", fields)
    )


@query("ri_count_len_exists", "SELECT 'orders' AS key, count(*) AS n, true AS found FROM orders")
def _(spark, d):
    return a.order_range(spark, d).groupBy("key").agg(F.count("*").alias("n")).withColumn("found", F.lit(True))


@query("ri_bulk_load", f"SELECT field, value FROM {RANGE}")
def _(spark, d):
    return a.order_range(spark, d).repartitionByRange("field").sortWithinPartitions("field").select("field", "value")


@query("ri_config_metrics", "SELECT 'orders' AS key, min(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS low, max(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS high, CAST(sum(12 + strlen(o_orderpriority)) AS BIGINT) AS bytes FROM orders")
def _(spark, d):
    r = a.order_range(spark, d)
    return r.groupBy("key").agg(F.min("field").alias("low"), F.max("field").alias("high"), F.sum(F.octet_length("field") + F.octet_length("value")).alias("bytes"))
