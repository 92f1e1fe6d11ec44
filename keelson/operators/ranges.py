"""Ordered range indexes: rows (key, field, value) in the order of field, whose files and row groups a range skips by
their bounds. An index has a configuration that writes are held against."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.sources.keyspace import latest

# What a configuration holds where nothing else is said.
DEFAULTS = {"backend": "DISK", "min_record_size": 8, "max_record_size": 1024, "max_key_len": 128}
BACKENDS = ("DISK", "MEMORY")


def create(key: str, known: tuple[str, ...] = (), **tuning: Any) -> dict[str, Any]:
    """RI.CREATE: the configuration of a new index; 0 stands for a default. A key that has one already is an error."""
    if key in known:
        raise ValueError("ERR index already exists")
    index = {"key": key} | DEFAULTS | {k: v for k, v in tuning.items() if v}
    if index["backend"] not in BACKENDS or index.keys() - DEFAULTS.keys() - {"key"}:
        raise ValueError("ERR unknown option of RI.CREATE")
    if index["min_record_size"] > index["max_record_size"]:
        raise ValueError("ERR the smallest record is larger than the largest")
    return index


def written(rows: DataFrame, log: DataFrame, index: dict[str, Any]) -> DataFrame:
    """The state after RI.SET and RI.DEL (seq, key, field, value; a null value deletes). Records beyond the index's sizes
    are errors."""
    size = F.octet_length("field") + F.octet_length("value")
    wrong = (F.octet_length("field") > index["max_key_len"]) | (F.octet_length("field") == 0) | (F.col("value").isNotNull() & ~size.between(index["min_record_size"], index["max_record_size"]))
    sound = log.withColumn("field", F.when(wrong, F.raise_error(F.lit("ERR record doesn't fit the index")).cast("string")).otherwise(F.col("field")))
    new = latest(sound.where(F.col("key") == index["key"]), ["key", "field"]).select("key", "field", "value")
    kept = rows.select("key", "field", "value").join(new, ["key", "field"], "left_anti")
    return kept.union(new.where("value IS NOT NULL"))


def ordered(index: dict[str, Any]) -> None:
    """Scans need the order on disk."""
    if index["backend"] == "MEMORY":
        raise ValueError("ERR RI.SCAN and RI.RANGE need an index on disk")


def scanned(rows: DataFrame, index: dict[str, Any], start: str, count: int) -> DataFrame:
    """RI.SCAN: so many fields from a start on, as a top-k."""
    ordered(index)
    return rows.where((F.col("key") == index["key"]) & (F.col("field") >= start)).orderBy("field").limit(count)


def ranged(rows: DataFrame, index: dict[str, Any], start: str, end: str, fields: str = "BOTH") -> DataFrame:
    """RI.RANGE: the fields between two bounds, both included; fields is KEY, VALUE or BOTH."""
    ordered(index)
    cells = {"KEY": ["field"], "VALUE": ["value"], "BOTH": ["field", "value"]}[fields]
    return rows.where((F.col("key") == index["key"]) & F.col("field").between(start, end)).select(*cells)
