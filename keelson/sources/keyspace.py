"""Keyspace relations: the live rows of one, the op-log that states are folded from, and places in an order.

A keyspace is a set of relations with one row per element: strings, hash fields, list items, set members, scored
members, bitmap offsets, JSON documents, vectors and ordered fields. A key exists as long as it has rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set. Times without a zone are read as UTC, whatever the session's zone is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp") for c in zoneless}) if zoneless else df


def instant(text: str) -> Column:
    """One literal time (UTC) for a whole query, so that all of its rows are judged alike."""
    return F.lit(f"{text} UTC").cast("timestamp")


def is_live(now: Column, expire: str = "expire_at") -> Column:
    """A row can be read up to and including the instant at which it expires."""
    return F.col(expire).isNull() | (F.col(expire) >= now)


def live(df: DataFrame, now: Column) -> DataFrame:
    return df.where(is_live(now))


def latest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row per key of a log: max_by over a struct combines map-side, unlike a window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def first_of(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


#: The folders of local sessions for which none is set, by application.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one; a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in LOCAL:
            LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='keelson-shared-')}"  # driver and executor are one process here
        path = LOCAL[app]
    return path.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended, and with it what could delete the folder
        return


def kept(df: DataFrame) -> DataFrame:
    """df as rows written to the shared folder: what is derived from it sees the same rows each time, whatever is lost or
    run again meanwhile. The folder (`written_at`) goes when the program ends, if not before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson-rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "idx") -> DataFrame:
    """df with each row's place, from 0, among the rows of its keys in a total order.

    A key may hold most rows, so this is no window over a key: rows are range-partitioned by keys and order, numbered
    within a range, and offset by what the key has in the ranges before (a window of one row for each range and key).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, count = f"part_{uuid.uuid4().hex}", f"count_{uuid.uuid4().hex}"
    ranged = kept(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part, *keys).agg(F.count("*").alias(count))
    offsets = sizes.select(part, *keys, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(count))
    here = ranged.withColumn(name, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)))
    return here.join(offsets, [part, *keys]).select(*df.columns, (F.col(name) + F.col(count) - 1).alias(name))


def drawn(seed: int, *cells: str) -> Column:
    """A draw for each row that doesn't depend on where or how often it is made: its place in a hash of seed and cells."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cells))


def draws(df: DataFrame, keys: list[str], cell: str, count: int, seed: int) -> DataFrame:
    """count distinct rows of each key at random, or with replacement (a negative count): then row `draw` of -count."""
    lot = drawn(seed, *keys, cell)
    if count >= 0:
        return df.withColumn("lot", F.row_number().over(Window.partitionBy(*keys).orderBy(lot, cell))).where(F.col("lot") <= count).drop("lot")
    placed = numbered(df, keys, lot, F.col(cell), name="lot")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("size"))
    asked = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count))))
    place = F.conv(F.substring(drawn(seed, *keys, "draw"), 1, 8), 16, 10).cast("long") % F.col("size")
    return asked.withColumn("lot", place).join(placed, [*keys, "lot"]).select("draw", *df.columns)


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
