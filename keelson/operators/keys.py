"""Keys of any type: existence, expiry, scans, renames, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.glob import glob_match
from keelson.sources.keyspace import discard, kept


def delete(ks: DataFrame, gone: DataFrame) -> DataFrame:
    return ks.join(gone.select("key"), "key", "left_anti")


def exists(ks: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the wanted keys there are; a key asked for twice counts twice."""
    return wanted.join(ks.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def keyspace(relations: dict[str, DataFrame]) -> DataFrame:
    """(key, type) of all keys of typed relations."""
    parts = [df.select("key").distinct().withColumn("type", F.lit(kind)) for kind, df in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def expire(ks: DataFrame, at: Column, now: Column, condition: str | None = None) -> DataFrame:
    """Set an expiry under NX, XX, GT or LT; one that isn't in the future deletes at once."""
    old = F.col("expire_at")
    allowed = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[condition]
    return ks.where(~(allowed & (at <= now))).withColumn("expire_at", F.when(allowed, at).otherwise(old))


def persist(ks: DataFrame) -> DataFrame:
    return ks.withColumn("expire_at", F.lit(None).cast("timestamp"))


def ttl_ms(now: Column) -> Column:
    """Milliseconds left, -1 without expiry; a missing key's -2 comes from a left join."""
    return F.when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(F.unix_millis("expire_at") - F.unix_millis(now))


def rename(ks: DataFrame, pairs: DataFrame, only_new: bool = False) -> DataFrame:
    """The state after renaming pairs (key, new) at once: the target's old rows go, unless only_new protects them."""
    moves = granted(ks, pairs) if only_new else pairs.join(ks.select("key").distinct(), "key", "left_semi")
    stay = ks.join(moves.select(F.col("new").alias("key")), "key", "left_anti")
    moved = ks.join(moves, "key").select(F.col("new").alias("key"), *[c for c in ks.columns if c != "key"])
    return stay.join(moves.select("key"), "key", "left_anti").select(*ks.columns).union(moved.select(*ks.columns))


def granted(ks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (key, new) whose target is free: not there, or moved away by another of the pairs that are granted. Of a
    key's pairs, then of those to a target, the first counts. Pairs in a ring wait for one another: none is granted.

    A pair whose target is moved itself waits for that pair's answer. Each round doubles how far it looks ahead, so
    rounds grow with the logarithm of the longest chain; what still waits after a round without answers is a ring.
    """
    there = ks.select("key").distinct()
    first = pairs.join(there, "key", "left_semi").groupBy("key").agg(F.min("new").alias("new")).groupBy("new").agg(F.min("key").alias("key"))
    marked = lambda keys, name: keys.select(F.col("key").alias("new"), F.lit(True).alias(name))
    goes = F.when(F.col("taken").isNull(), True).when(F.col("leaves").isNull(), False)
    state = kept(first.join(marked(there, "taken"), "new", "left").join(marked(first, "leaves"), "new", "left").select("key", "new", F.col("new").alias("ahead"), goes.alias("goes")))
    waiting = state.where("goes IS NULL").count()
    while waiting:
        answers = state.select(F.col("key").alias("ahead"), F.col("ahead").alias("further"), F.col("goes").alias("answer"))
        told = state.where("goes IS NULL").join(answers, "ahead").select("key", "new", F.col("further").alias("ahead"), F.col("answer").alias("goes"))
        spent, state = state, kept(state.where("goes IS NOT NULL").union(told))
        discard(ks.sparkSession, spent.written_at)
        before, waiting = waiting, state.where("goes IS NULL").count()
        if waiting == before:
            break
    return state.where("goes").select("key", "new")


def keys(ks: DataFrame, pattern: str) -> DataFrame:
    """Keys that match a glob; the pattern * itself means all."""
    found = ks.select("key").distinct()
    return found if pattern == "*" else found.where(glob_match(F.col("key"), pattern))


def scan(ks: DataFrame, cursor: str | None, pattern: str = "*", count: int = 10, kind: str | None = None) -> DataFrame:
    """The next page of keys after a cursor, which is the last key of the page before; of one type, if kind is given
    (then ks has a column `type`, as keyspace() gives it)."""
    rows = ks if kind is None else ks.where(F.col("type") == kind)
    return page(rows.select("key").distinct(), "key", cursor, pattern, count)


def page(rows: DataFrame, cell: str, cursor: str | None, pattern: str = "*", count: int = 10) -> DataFrame:
    """HSCAN, SSCAN, ZSCAN: the next rows in the order of a cell (field or member) after a cursor, which is the last cell
    of the page before. The cursor is a filter, and the page a top-k."""
    found = rows if pattern == "*" else rows.where(glob_match(F.col(cell), pattern))
    if cursor is not None:
        found = found.where(F.col(cell) > cursor)
    return found.orderBy(cell).limit(count)


# How a type of key is stored.
ENCODINGS = {"string": "raw", "range": "raw", "vector": "raw", "zset": "skiplist", "list": "quicklist", "hash": "hashtable", "set": "hashtable"}


def object_info(typed: DataFrame) -> DataFrame:
    """OBJECT of keys (key, type): encoding, refcount and idletime. FREQ isn't kept."""
    names = F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair])
    return typed.select("key", F.element_at(names, F.col("type")).alias("encoding"), F.lit(1).alias("refcount"), F.lit(0).alias("idletime"))


def dbsize(relations: dict[str, DataFrame]) -> DataFrame:
    """The number of keys of all relations; a key is in one of them."""
    return keyspace(relations).agg(F.count("*").alias("n"))


def flushdb(rows: DataFrame, db: int | None = None) -> DataFrame:
    """The rows (db, ...) that are left without those of a database, or of all of them."""
    return rows.limit(0) if db is None else rows.where(F.col("db") != db)


def select_db(rows: DataFrame, db: int) -> DataFrame:
    return rows.where(F.col("db") == db)


def swapdb(rows: DataFrame, a: int, b: int) -> DataFrame:
    return rows.withColumn("db", F.when(F.col("db") == a, b).when(F.col("db") == b, a).otherwise(F.col("db")))


def slot(key: Column) -> Column:
    """The cluster slot of a key: CRC-16 (polynomial 0x1021) of its tag modulo 16384. The tag is what stands between the
    first { and the next }, if anything does, else the whole key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    data = F.when(tag != "", tag).otherwise(key).cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int")
    bit = lambda crc, _: F.when(crc.bitwiseAND(0x8000) != 0, F.shiftleft(crc, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(crc, 1)).bitwiseAND(F.lit(0xFFFF))
    eight = F.array(*[F.lit(i) for i in range(8)])
    step = lambda crc, i: F.aggregate(eight, crc.bitwiseXOR(F.shiftleft(byte(i), 8)), bit)
    return F.when(F.octet_length(data) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), F.lit(0), step)) % 16384


def memory_usage(ks: DataFrame, cells: list[str], overhead: int = 16) -> DataFrame:
    """Bytes per key: its cells and a fixed cost per row."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cells), F.lit(overhead))
    return ks.groupBy("key").agg(F.sum(size).alias("bytes"))


def dump(ks: DataFrame, cells: list[str], version: int = 1) -> DataFrame:
    """A payload per row: version, JSON, and a checksum over both."""
    body = F.concat(F.lit(f"{version}:"), F.to_json(F.struct(*cells)))
    return ks.select("key", F.concat(body, F.lit(":"), F.lpad(F.lower(F.hex(F.crc32(body.cast("binary")))), 8, "0")).alias("payload"))


def restore(dumped: DataFrame, schema: str, version: int = 1) -> DataFrame:
    """Rows of payloads; one that is of another version or damaged is an error."""
    body = F.regexp_extract("payload", r"(?s)^(.*):[0-9a-f]{8}$", 1)
    sound = (F.lpad(F.lower(F.hex(F.crc32(body.cast("binary")))), 8, "0") == F.substring("payload", -8, 8)) & F.col("payload").startswith(f"{version}:")
    row = F.from_json(F.substring(body, F.lit(len(f"{version}:") + 1), F.length(body)), schema)
    return dumped.select("key", F.when(sound, row).otherwise(F.raise_error(F.lit("DUMP payload version or checksum are wrong"))).alias("r")).select("key", "r.*")
