"""The driver's tables as keyspace relations: projections alone, so that Spark prunes columns down to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.keyspace import table


def customers_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """zset: a nation's customers by account balance."""
    return table(spark, d, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def parts_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """zset: a brand's parts by price."""
    return table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"), F.col("p_retailprice").alias("score"))


def users_by_event(spark: SparkSession, d: str) -> DataFrame:
    """zset: the users of an event type by number of events."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))


def event_users(spark: SparkSession, d: str) -> DataFrame:
    """set: the users of an event type."""
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    """set: the parts that a supplier ships."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("supp:"), "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member")).distinct()


def order_hash(spark: SparkSession, d: str) -> DataFrame:
    """hash: an order's columns as fields."""
    cells = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.explode(F.create_map(*[x for c in cells for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))


def event_list(spark: SparkSession, d: str) -> DataFrame:
    """list: a user's event types in order of time."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), (F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("pos"), F.col("event_type").alias("value"), "event_id")


def part_strings(spark: SparkSession, d: str) -> DataFrame:
    """string: a part's name."""
    return table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.col("p_name").alias("value"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """oplog: each event writes its user's key, at its time, to live for a day."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("cmd"), F.col("value").alias("value"), "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expire_at"))


def event_bits(spark: SparkSession, d: str) -> DataFrame:
    """bitmap: the users of an event type as offsets."""
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("off")).distinct()


def event_json(spark: SparkSession, d: str) -> DataFrame:
    """json: an event's properties."""
    return table(spark, d, "events").select(F.concat(F.lit("event:"), "event_id").alias("key"), F.col("props").alias("doc"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """geo: customers at places made from their keys."""
    c = table(spark, d, "customer")
    return c.select(F.lit("customers").alias("key"), F.col("c_name").alias("member"), (F.pmod(F.col("c_custkey") * 7919, F.lit(36000)) / 100 - 180).alias("lon"), (F.pmod(F.col("c_custkey") * 104729, F.lit(18001)) / 100 - 90).alias("lat"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.lit("emb").alias("key"), F.col("vec_id").cast("string").alias("element"), "embedding", F.concat(F.lit('{"label":'), F.coalesce(F.col("label").cast("string"), F.lit("null")), F.lit(',"id":'), F.col("vec_id").cast("string"), F.lit("}")).alias("attrs"))


def order_range(spark: SparkSession, d: str) -> DataFrame:
    """range: orders by zero-padded key."""
    return table(spark, d, "orders").select(F.lit("orders").alias("key"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("field"), F.col("o_orderpriority").alias("value"))
