"""Strings: rows (key, value). Byte positions are those of the value's UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.keyspace import first_of, is_live, latest, numbered


def get(ks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, key) with the value, null where there is none; pos keeps the order of the request."""
    return wanted.join(ks.select("key", "value"), "key", "left").select("pos", "key", "value")


def set_(ks: DataFrame, log: DataFrame, only: str | None = None) -> DataFrame:
    """The state after writes (seq, key, value), NX on absent keys alone, XX on present ones."""
    new = (first_of if only == "NX" else latest)(log, ["key"]).select("key", F.col("value").alias("new"))
    both = ks.select("key", "value").join(new, "key", "left" if only == "XX" else "full")
    return both.select("key", (F.coalesce("value", "new") if only == "NX" else F.coalesce("new", "value")).alias("value"))


def set_with(ks: DataFrame, writes: DataFrame, only: str | None = None, expire_at: Column | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state, replies) after SET with GET and EX, PX or KEEPTTL. ks: key, value, expire_at; writes: one (key, value) a key.

    A written key gets the given expiry, keeps its own (keep), or loses it. Replies are the values before.
    """
    new = writes.select("key", F.col("value").alias("new"))
    both = ks.select("key", "value", "expire_at").join(new, "key", "left" if only == "XX" else "full")
    there = F.col("value").isNotNull()
    written = F.col("new").isNotNull() & (~there if only == "NX" else there if only == "XX" else F.lit(True))
    expiry = F.col("expire_at") if keep else F.lit(None).cast("timestamp") if expire_at is None else expire_at
    state = both.select("key", F.when(written, F.col("new")).otherwise(F.col("value")).alias("value"), F.when(written, expiry).otherwise(F.col("expire_at")).alias("expire_at"))
    return state, new.join(ks.select("key", "value"), "key", "left").select("key", F.col("value").alias("old"))


def getset(log: DataFrame) -> DataFrame:
    """Each write with the value that it replaces within the log: the one a place before in its key's order."""
    placed = numbered(log, ["key"], F.asc("seq"), name="place")
    before = placed.select("key", (F.col("place") + 1).alias("place"), F.col("value").alias("old"))
    return placed.join(before, ["key", "place"], "left").drop("place")


def getdel(ks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values of the wanted keys, null where there is none; the state without them)."""
    asked = wanted.select("key").distinct()
    return asked.join(ks.select("key", "value"), "key", "left"), ks.join(asked, "key", "left_anti")


def getex(ks: DataFrame, wanted: DataFrame, now: Column, expire_at: Column | None = None, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """(values of the wanted keys, state): the expiry of those that live is set, taken away (persist) or left.

    An expiry that isn't in the future deletes the key once its value has been read.
    """
    asked = wanted.select("key").distinct().withColumn("asked", F.lit(True))
    live = ks.where(is_live(now))
    values = asked.join(live.select("key", "value"), "key", "left").select("key", "value")
    at = F.lit(None).cast("timestamp") if persist else F.col("expire_at") if expire_at is None else expire_at
    rows = live.join(asked, "key", "left").withColumn("expire_at", F.when(F.col("asked"), at).otherwise(F.col("expire_at")))
    return values, rows.where(F.col("asked").isNull() | F.col("expire_at").isNull() | (F.col("expire_at") > now)).select(*ks.columns)


def byte_slice(value: Column, start: int, end: int) -> Column:
    """Bytes start..end, both included, negative ones from the end; empty if there are none."""
    b = value.cast("binary")
    n = F.octet_length(b)
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = at(start), F.least(at(end) if end >= 0 else n + end, n - 1)
    return F.when((n == 0) | (first > last), F.lit("").cast("binary")).otherwise(F.substring(b, first + 1, last - first + 1))


def setrange(value: Column, offset: int, patch: str) -> Column:
    """The value with bytes from offset on overwritten, zero bytes between."""
    b = F.coalesce(value.cast("binary"), F.lit("").cast("binary"))
    n, width = F.octet_length(b), len(patch.encode())
    head = F.rpad(F.substring(b, F.lit(1), F.lit(offset)), offset, F.unhex(F.lit("00"))) if offset else F.lit("").cast("binary")
    tail = F.when(n > offset + width, F.substring(b, F.lit(offset + width + 1), n - offset - width)).otherwise(F.lit("").cast("binary"))
    return F.concat(head, F.lit(patch).cast("binary"), tail)


def append(log: DataFrame, glue: str = "") -> DataFrame:
    """Each key's values, one after the other in order of seq. A value is one cell, so it has the bound of a cell (the
    store's is 512 MB)."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return log.groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["value"]), glue).alias("value"))


def incrby(log: DataFrame) -> DataFrame:
    """Counters: the sum of whole deltas per key; ANSI arithmetic raises on overflow."""
    return log.groupBy("key").agg(F.sum(F.col("delta").cast("long")).alias("value"))


def incrbyfloat(log: DataFrame) -> DataFrame:
    """Sums of floats; NaN and infinite results are errors."""
    total = log.groupBy("key").agg(F.sum(F.col("delta").cast("double")).alias("value"))
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return total.withColumn("value", F.when(bad, F.raise_error(F.lit("increment would produce NaN or Infinity"))).otherwise(F.col("value")))


def msetnx(ks: DataFrame, new: DataFrame) -> DataFrame:
    """All of new (key, value), or nothing if any of the keys exists."""
    clash = new.join(ks, "key", "left_semi").agg(F.count("*").alias("clashes"))  # one row
    fresh = new.join(F.broadcast(clash), F.col("clashes") == 0).select("key", "value")
    return ks.select("key", "value").union(fresh)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table, in higher-order functions."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.size(y)), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        start = F.array(F.lit(0))
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(y, j) == c, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(above, j + 1)))))
        return F.when(F.size(y) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(y)), start, step))

    table = F.aggregate(x, zero, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def lcs_matches(a: str, b: str, least: int = 1) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
    """LCS IDX: the stretches of a longest common subsequence as (range in a, range in b, length), the last first."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(table[-1][j] + 1 if x == y else max(row[j], table[-1][j + 1]))
        table.append(row)
    out: list[list[int]] = []
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            if out and out[-1][0] == i and out[-1][2] == j:
                out[-1][0], out[-1][2] = i - 1, j - 1
            else:
                out.append([i - 1, i - 1, j - 1, j - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return [((a0, a1), (b0, b1), a1 - a0 + 1) for a0, a1, b0, b1 in out if a1 - a0 + 1 >= least]


LCS = "lcs string, len int, matches array<struct<a0: int, a1: int, b0: int, b1: int, len: int>>"


def lcs(pairs: DataFrame, least: int = 1) -> DataFrame:
    """pairs (key, a, b) with the subsequence itself, its length, and the stretches of `least` signs or more (IDX,
    MINMATCHLEN, WITHMATCHLEN). Walking back through the table is no column arithmetic, so this runs in Arrow batches."""
    import pandas as pd

    def run(batches):
        for df in batches:
            rows = []
            for a, b in zip(df.a, df.b, strict=True):
                found = lcs_matches(a or "", b or "")
                text = "".join((a or "")[r[0][0] : r[0][1] + 1] for r in reversed(found))
                rows.append((text, len(text), [(*r[0], *r[1], r[2]) for r in found if r[2] >= least]))
            out = pd.DataFrame(rows, columns=["lcs", "len", "matches"])
            out.insert(0, "key", df.key.to_numpy())
            yield out

    return pairs.select("key", "a", "b").mapInPandas(run, f"key {pairs.schema['key'].dataType.simpleString()}, {LCS}")
