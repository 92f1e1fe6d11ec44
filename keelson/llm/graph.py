"""Connected components of an edge list, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import materialise, release


def pointed(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (u, v) with u < v."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, label): the smallest vertex reachable, for each vertex that has an edge. Vertices are longs.

    Each round hangs the neighbours of a vertex on the smallest of them, first the larger ones, then the others. The
    rounds end when the edges are stars already; their number grows with the logarithm of the largest component.
    Minima are combined before the shuffle, and a vertex with many neighbours is on the side of a join that Spark
    can split. Every round is written to the shared folder, so a lost executor costs no earlier round.
    """
    e = materialise(pointed(edges, a, b), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(lowest, "v")
        small = pointed(hung.select("m", F.explode(F.array("u", "v")).alias("x")), "m", "x")
        spent, e = e, materialise(small, "edges")
        release(spent)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("v").alias("vertex"), F.col("u").alias("label")).union(e.select(F.col("u").alias("vertex"), F.col("u").alias("label")).distinct())
