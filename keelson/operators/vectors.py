"""Vector sets: rows (key, element, embedding, attrs). Searches are exact: one scan, a filter before the distances,
and a top-k that each partition reduces first (TakeOrderedAndProject)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.filters import compile_filter
from keelson.sources.keyspace import draws


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "L2") -> Column:
    """L2 (squared), COSINE (1 - cosine), IP (negated inner product) or XCOSINE_NORMALIZED (vectors of length one)."""
    if metric == "L2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "COSINE":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return 1 - dot(a, b) if metric == "XCOSINE_NORMALIZED" else -dot(a, b)


def vsim(v: DataFrame, query: list[float], count: int = 10, metric: str = "L2", where: str | None = None, epsilon: float | None = None) -> DataFrame:
    """The nearest elements to a vector, ties by element."""
    rows = v.where(compile_filter(where, F.col("attrs"))) if where else v
    found = rows.withColumn("dist", distance(F.col("embedding"), F.array(*map(F.lit, query)), metric))
    if epsilon is not None:
        found = found.where(F.col("dist") <= epsilon)
    return found.orderBy("dist", "element").limit(count)


def vsim_element(v: DataFrame, element: str, **how) -> DataFrame:
    """The nearest to a stored element: one row is fetched, the rest is vsim."""
    row = v.where(F.col("element") == element).select("embedding").first()
    return vsim(v, list(row["embedding"]) if row else [], **how)


def quantised(embedding: Column, kind: str) -> Column:
    """An embedding as a quantiser keeps it: NOQUANT as it is, BIN by its signs, Q8 in 127 steps of its largest component."""
    if kind == "NOQUANT":
        return F.transform(embedding, lambda x: x.cast("double"))
    if kind == "BIN":
        return F.transform(embedding, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    largest = F.array_max(F.transform(embedding, lambda x: F.abs(x.cast("double"))))
    return F.transform(embedding, lambda x: F.when(largest == 0, 0.0).otherwise(F.round(x.cast("double") / largest * 127)))


def reduced(embedding: Column, dim: int, seed: int = 0) -> Column:
    """REDUCE: an embedding in fewer dimensions, by a projection on random signs (a hash of seed, row and column), scaled so
    that lengths are kept on average."""
    sign = lambda i, j: F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), j), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    row = lambda i: F.aggregate(F.transform(embedding, lambda x, j: x.cast("double") * sign(i, j)), F.lit(0.0), lambda s, x: s + x) / math.sqrt(dim)
    return F.array(*[row(i) for i in range(dim)])


def vadd(v: DataFrame, log: DataFrame) -> DataFrame:
    """The state after adding (seq, key, element, embedding, attrs): the last of an element counts."""
    new = log.groupBy("key", "element").agg(F.max_by(F.struct("embedding", "attrs"), "seq").alias("r")).select("key", "element", "r.*")
    return v.join(new, ["key", "element"], "left_anti").select("key", "element", "embedding", "attrs").union(new)


def vrem(v: DataFrame, gone: DataFrame) -> DataFrame:
    return v.join(gone, ["key", "element"], "left_anti")


def vismember(v: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, element) with `found`, 0 or 1."""
    return wanted.join(v.select("key", "element", F.lit(1).alias("found")), ["key", "element"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def vsetattr(v: DataFrame, log: DataFrame) -> DataFrame:
    """The state after setting attributes (seq, key, element, attrs) of elements that are there; empty ones take them away."""
    new = log.groupBy("key", "element").agg(F.max_by("attrs", "seq").alias("new"))
    both = v.join(new, ["key", "element"], "left")
    return both.withColumn("attrs", F.when(F.col("new").isNull(), F.col("attrs")).otherwise(F.nullif("new", F.lit("")))).select(*v.columns)


def vinfo(v: DataFrame) -> DataFrame:
    return v.groupBy("key").agg(F.count("*").alias("card"), F.max(F.size("embedding")).alias("dim"))


def vrandmember(v: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """count distinct elements of each key, or with replacement if it is negative."""
    return draws(v, ["key"], "element", count, seed)


def vlinks(v: DataFrame, elements: list[str], m: int = 5) -> DataFrame:
    """The m nearest neighbours of a few stated elements, which are the links that a graph index would keep."""
    asked = F.broadcast(v.where(F.col("element").isin(elements)).select(F.col("element").alias("of"), F.col("embedding").alias("q")))  # as many as stated
    found = v.join(asked, F.col("element") != F.col("of")).withColumn("dist", distance(F.col("embedding"), F.col("q")))
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("of").orderBy("dist", "element"))).where(F.col("rn") <= m).select("of", "element", "dist")
