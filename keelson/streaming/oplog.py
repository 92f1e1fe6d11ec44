"""The op-log as a stream: tailing it, and the state of a keyspace kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.keyspace import latest


def tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """New log files as they appear; `per_trigger` bounds a batch, so a backlog is worked off in steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def monitor(log: DataFrame, commands: list[str] | None = None) -> DataFrame:
    """The commands as they come, of some kinds or all."""
    return log.where(F.col("cmd").isin(commands)) if commands else log


def folded(log: DataFrame) -> DataFrame:
    """Last write wins; a `del` as the last write leaves no key."""
    return latest(log, ["key"]).where(F.col("cmd") != "del")


def compacted(log: DataFrame) -> DataFrame:
    """The log without writes that later ones of their key hide: the fold is the same."""
    return latest(log, ["key"])


def sink(log: DataFrame, path: str, segments: int) -> None:
    """Append a log (seq, ...) to files: `segments` of them, each a range of seq in order, so that a replay from an address
    (a seq) skips those before it by their bounds."""
    log.repartitionByRange(segments, "seq").sortWithinPartitions("seq").write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """The log from one address up to another."""
    rows = spark.read.parquet(path).where(F.col("seq") >= start)
    return rows if end is None else rows.where(F.col("seq") < end)


def checkpointed(batch: DataFrame, path: str, number: int) -> None:
    """Write what a batch leaves of its keys; a batch of the same number is written over."""
    compacted(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def snapshots(log: DataFrame, path: str, checkpoint: str):
    """A query that writes what each batch leaves of its keys: work is in proportion to the batch, whatever the state. A
    batch that is run again overwrites its own folder, so the result is as if each batch ran once."""
    return log.writeStream.foreachBatch(lambda batch, number: checkpointed(batch, path, number)).option("checkpointLocation", checkpoint)


def restored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state of all batches: the last write of each key, those whose last write is a `del` left out."""
    return folded(spark.read.schema(schema).parquet(f"{path}/batch=*"))
