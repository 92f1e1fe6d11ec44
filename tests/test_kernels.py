"""Small golden cases of what SQL can't say."""

import json

import pytest
from pyspark.sql import functions as F

from keelson.functions import jsonpath
from keelson.functions.filters import compile_filter
from keelson.functions.glob import glob_to_regex
from keelson.operators import bits, geo, keys, lists, ranges, strings, zsets
from keelson.sources import keyspace


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "n"), [("ohmytext", "mynewtext", 6), ("", "abc", 0), ("abc", "", 0), ("abc", "abc", 3), ("abc", "xyz", 0)])
def test_lcs(spark, a, b, n):
    assert one(spark, strings.lcs_length(F.lit(a), F.lit(b))) == n


# Latitude, longitude, the 52-bit hash and its string.
GEOHASHES = [
    (30.5388942218, 104.0555758833, 4024744861876082, "wm3vxz6vyw0"), (27.988056, 86.925278, 3636631039000829, "tuvz4p141z0"), (37.502669, 15.087269, 3476216502357864, "sqdtr74hyu0"),
    (38.115556, 13.361389, 3476004292229755, "sqc8b49rny0"), (38.918250, -77.427944, 1787100258949719, "dqbvqhfenp0"), (0.0, 0.0, 0xC000000000000, "s0000000000"),
    (-90.0, -180.0, 0, "00000000000"), (90.0, 180.0, 0xFFFFFFFFFFFFF, "zzzzzzzzzz0"), (89.99999999999999, 179.99999999999997, 0xFFFFFFFFFFFFF, "zzzzzzzzzz0"),
]


def test_geohashes(spark):
    df = spark.createDataFrame([(str(i), lat, lon) for i, (lat, lon, _, _) in enumerate(GEOHASHES)], "member string, lat double, lon double")
    z = geo.geoadd(df.withColumn("key", F.lit("k")))
    hashes = {r["member"]: r["h"] for r in df.select("member", geo.geohash(F.col("lon"), F.col("lat")).alias("h")).collect()}
    for r in geo.geopos(z).join(z, "member").collect():
        lat, lon, score, text = GEOHASHES[int(r["member"])]
        assert (r["score"], hashes[r["member"]]) == (score, text)
        assert abs(r["lat"] - lat) < 1e-5 and abs(r["lon"] - lon) < 1e-5


def test_places_off_the_globe_are_errors(spark):
    for lon, lat in ((0.0, 90.1), (180.5, 0.0)):
        df = spark.createDataFrame([("k", "m", lon, lat)], "key string, member string, lon double, lat double")
        with pytest.raises(Exception, match="invalid longitude"):
            geo.geoadd(df).collect()


@pytest.mark.parametrize(("pattern", "yes", "no"), [("*", ["a"], [""]), ("h?llo", ["hello"], ["hllo"]), ("h[^e]llo", ["hallo"], ["hello"]), ("h[a-b]llo", ["hbllo"], ["hcllo"]), (r"a\*b", ["a*b"], ["axb"]), ("", [""], ["a"])])
def test_glob(pattern, yes, no):
    import re

    rx = re.compile(glob_to_regex(pattern))
    assert all(rx.search(s) for s in yes) and not any(rx.search(s) for s in no)


def test_nan_is_lowest_and_counts_as_zero(spark):
    z = spark.createDataFrame([("a", "x", float("nan")), ("a", "y", -1.0), ("b", "x", 2.0), ("a", "w", float("inf")), ("b", "w", float("-inf"))], "key string, member string, score double")
    assert [r["member"] for r in zsets.zrank(z).where("key = 'a'").orderBy("rank").collect()] == ["x", "y", "w"]
    assert {r["member"]: r["score"] for r in zsets.zunion(z, ["a", "b"]).collect()} == {"x": 2.0, "y": -1.0, "w": 0.0}


def test_bitfields(spark):
    v = F.unhex(F.lit("00ff7f80"))
    assert one(spark, bits.field(v, "u8", 4)) == 0x0F
    assert one(spark, bits.field(v, "i8", 8)) == -1
    assert one(spark, bits.field(v, "u16", 24)) == 0x8000  # beyond the end: zeros
    assert one(spark, bits.overflowed(F.lit(127), F.lit(1), "i8", "WRAP")) == -128
    assert one(spark, bits.overflowed(F.lit(127), F.lit(1), "i8", "SAT")) == 127
    assert one(spark, bits.overflowed(F.lit(127), F.lit(1), "i8", "FAIL")) is None
    assert one(spark, bits.overflowed(F.lit(0), F.lit(-1), "u8", "WRAP")) == 255


def test_dump_is_checked(spark):
    ks = spark.createDataFrame([("k", "v:w\n1")], "key string, value string")
    dumped = keys.dump(ks, ["value"])
    assert keys.restore(dumped, "value string").collect() == ks.collect()
    broken = dumped.withColumn("payload", F.regexp_replace("payload", "w", "x"))
    with pytest.raises(Exception, match="checksum"):
        keys.restore(broken, "value string").collect()


DOC = {"a": {"b": [1, 2, {"c": "10"}, 4]}, "c": True, "d": [{"n": 1, "s": "x"}, {"n": 5, "s": "xyz"}]}


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("$", [DOC]), ("$.a.b[0]", [1]), ("$.a.b[-1]", [4]), ("$.a.b[1:3]", [2, {"c": "10"}]), ("$..c", [True, "10"]), ("$.a.b[0,3]", [1, 4]), ("$['a','c']", [DOC["a"], True]),
        ("$.d[?(@.n > 2)].s", ["xyz"]), ("$.d[?(@.s =~ /^x$/)].n", [1]), ("$.d[?(@.n == '5')].n", [5]), ("$.d[?(@.n === '5')].n", []), ("$.d[?(!@.q && @.n in [1, 2])].s", ["x"]), ("$.x", []), ("$.d[*].n", [1, 5]),
    ],
)
def test_json_paths(path, found):
    assert sorted(map(json.dumps, jsonpath.select(DOC, path))) == sorted(map(json.dumps, found))


@pytest.mark.parametrize(("text", "holds"), [(".y >= 2000 and .r > 7", True), ("not .y == 1", True), (".t in ['a', 'b']", True), (".y ** 2 > 4000000 or .q == 1", True), (".q < 3", False), ("(.r + 1) * 2 == 18", True), (".t == 'z'", False)])
def test_filters(spark, text, holds):
    assert one(spark, compile_filter(text, F.lit('{"y": 2001, "r": 8, "t": "a"}'))) is holds


def test_hrandfield_draws_from_every_key(spark):
    from keelson.plans import catalogue
    from keelson.sources import adapters
    from tests.oracle import SF

    found = {r["key"]: r["n"] for r in catalogue.queries()["hrandfield"](spark, SF).groupBy("key").count().withColumnRenamed("count", "n").collect()}
    keys = {r["key"] for r in adapters.order_hash(spark, SF).select("key").distinct().collect()}
    assert found.keys() == keys and set(found.values()) == {2}


def test_ranks_of_one_key_that_holds_every_row(spark, monkeypatch):
    """Rows are dealt evenly, whatever their keys, and ranks and indexes are those of a window."""
    seen = []
    kept = keyspace.kept
    monkeypatch.setattr(keyspace, "kept", lambda df: seen.append(kept(df)) or seen[-1])
    rows = spark.range(20_000).selectExpr("'hot' AS key", "cast(id AS string) AS member", "cast(id % 7 AS double) AS score", "id AS pos", "id % 3 AS value")
    few = spark.createDataFrame([("cold", "a", 1.0, 1, 1), ("cold", "b", 0.0, 2, 2)], "key string, member string, score double, pos long, value long")
    both = rows.union(few)
    want = sorted(((i % 7, str(i)) for i in range(20_000)))
    ranked = zsets.zrank(both)
    assert [r["member"] for r in ranked.where("key = 'hot' AND rank < 5 OR key = 'hot' AND rank IN (9999, 19999)").orderBy("rank").collect()] == [m for _, m in [*want[:5], want[9999], want[19999]]]
    assert {(r["member"], r["rank"]) for r in ranked.where("key = 'cold'").collect()} == {("b", 0), ("a", 1)}
    assert [(r["idx"], r["pos"]) for r in lists.lrange(both.select("key", "pos", "value"), 1, -19999).where("key = 'hot'").collect()] == [(1, 1)]
    for df in seen:
        sizes = sorted(r["count"] for r in df.groupBy([c for c in df.columns if c.startswith("part_")][0]).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_negative_and_mixed_bounds(spark):
    z = spark.createDataFrame([("k", m, float(i)) for i, m in enumerate("abcdefgh")], "key string, member string, score double")
    at = lambda df: [(r["rank"], r["member"]) for r in df.orderBy("rank").collect()]
    assert at(zsets.zrange(z, -3, -2)) == [(5, "f"), (6, "g")] and at(zsets.zrange(z, -2, -1, True)) == [(6, "b"), (7, "a")]
    assert at(zsets.zrange(z, 2, -4)) == [(2, "c"), (3, "d"), (4, "e")] and at(zsets.zrange(z, -20, -8)) == [(0, "a")] and at(zsets.zrange(z, -1, 3)) == []


def test_draws_are_stable(spark):
    s = spark.range(50).selectExpr("'k' AS key", "cast(id AS string) AS member")
    from keelson.operators import sets

    once, again = ({r["member"] for r in sets.srandmember(df, 7, 3).collect()} for df in (s, s.repartition(5, "member")))
    assert once == again and len(once) == 7
    popped, left = sets.spop(s, 7, 3)
    assert {r["member"] for r in popped.collect()} | {r["member"] for r in left.collect()} == {str(i) for i in range(50)} and left.count() == 43
    assert sets.srandmember(s, -60, 3).count() == 60


@pytest.mark.parametrize(("a", "b", "text", "found"), [("ohmytext", "mynewtext", "mytext", [((4, 7), (5, 8), 4), ((2, 3), (0, 1), 2)]), ("", "x", "", []), ("abc", "abc", "abc", [((0, 2), (0, 2), 3)])])
def test_lcs_stretches(spark, a, b, text, found):
    assert strings.lcs_matches(a, b) == found and strings.lcs_matches(a, b, 4) == [f for f in found if f[2] >= 4]
    row = strings.lcs(spark.createDataFrame([("k", a, b)], "key string, a string, b string")).first()
    assert row["lcs"] == text and row["len"] == len(text)


def test_fields_are_set(spark):
    v = F.unhex(F.lit("ff00ff"))
    after = lambda kind, at, x: one(spark, F.lower(F.hex(bits.set_field(v, kind, at, F.lit(x)))))
    assert after("u8", 0, 1) == "0100ff" and after("u4", 4, 0) == "f000ff" and after("i8", 12, -1) == "ff0fff" and after("u8", 32, 7) == "ff00ff0007"
    reply, field = bits.bitfield_incrby(F.unhex(F.lit("7f")), "i8", 0, F.lit(1), "FAIL")
    assert one(spark, reply) is None and one(spark, bits.field(field, "i8", 0)) == 0


def test_slots(spark):
    assert [one(spark, keys.slot(F.lit(k))) for k in ("123456789", "foo", "{foo}.a", "{}x", "")] == [12739, 12182, 12182, one(spark, keys.slot(F.lit("{}x"))), 0]


def test_range_indexes_hold_their_limits(spark):
    rows = spark.createDataFrame([("k", "a", "1")], "key string, field string, value string")
    with pytest.raises(ValueError, match="exists"):
        ranges.create("k", ("k",))
    with pytest.raises(ValueError, match="on disk"):
        ranges.ranged(rows, ranges.create("k", backend="MEMORY"), "a", "b")
    log = spark.createDataFrame([(1, "k", "b" * 9, "2")], "seq long, key string, field string, value string")
    assert ranges.written(rows, log, ranges.create("k")).count() == 2
    with pytest.raises(Exception, match="fit the index"):
        ranges.written(rows, log, ranges.create("k", max_key_len=5)).collect()


def test_script_libraries(spark):
    from keelson.functions import scripts as s

    x = F.lit(0xFFFFFFFF)
    assert one(spark, s.band(x, F.lit(-1))) == -1 and one(spark, s.bor(F.lit(1), F.lit(6))) == 7 and one(spark, s.bnot(F.lit(0))) == -1
    assert one(spark, s.lshift(F.lit(1), 31)) == -(1 << 31) and one(spark, s.rshift(F.lit(-1), 28)) == 15 and one(spark, s.arshift(F.lit(-8), 1)) == -4
    for kind, digits in ((">I4", "000004D2"), ("<I4", "D2040000"), (">i2", "04D2"), ("<I8", "D204000000000000")):
        assert one(spark, F.hex(s.pack(F.lit(1234), kind))) == digits and one(spark, s.unpack(F.unhex(F.lit(digits)), kind)) == 1234
    assert one(spark, s.unpack(s.pack(F.lit(-2), ">i4"), ">i4")) == -2 and one(spark, s.decode(F.lit('{"a":3}'), "a int"))["a"] == 3


def test_projections_keep_lengths(spark):
    from keelson.operators import vectors

    v = spark.range(60).select(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.sin(F.col("id") * 7 + j * j).cast("float")).alias("e"))
    rows = v.select(vectors.dot(F.col("e"), F.col("e")).alias("a"), vectors.reduced(F.col("e"), 40).alias("r")).select("a", "r", vectors.dot(F.col("r"), F.col("r")).alias("b")).collect()
    assert all(len(r["r"]) == 40 for r in rows) and 0.7 < sum(r["b"] for r in rows) / sum(r["a"] for r in rows) < 1.3


def test_pfadd_replies_by_registers(spark):
    seen = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "even").alias("key"), F.col("id").alias("value")).coalesce(1)  # a key is null
    said = lambda old, new: {r["key"]: r["changed"] for r in bits.pfadd_changed(old, new).collect()}
    assert said(seen, seen.distinct()) == said(seen.repartition(8), seen) == {None: False, "even": False}
    assert said(seen, seen.withColumn("value", F.col("value") + 20000)) == {None: True, "even": True}
    few = seen.where("value < 20")  # still a list of hashes
    assert said(few, few) == {None: False, "even": False} and said(few, seen) == {None: True, "even": True} and said(seen, few) == {None: False, "even": False}
    assert said(few, few.select(F.lit("even").alias("key"), F.lit(7).cast("long").alias("value"))) == {"even": True}
    assert said(few, few.select(F.lit("new").alias("key"), F.col("value"))) == {"new": True}
    assert said(few, few.select(F.lit("even").alias("key"), F.lit(None).cast("long").alias("value"))) == {"even": None}


def test_pfadd_sees_each_register(spark):
    sketch = lambda df: bytes(df.agg(F.hll_sketch_agg("value", F.lit(14)).alias("s")).first()["s"])
    old = spark.range(20000).select(F.lit("k").alias("key"), F.col("id").alias("value"))
    found = sketch(old)[bits.HEAD :]
    alone = spark.range(20000, 20060).groupBy("id").agg(F.hll_sketch_agg("id", F.lit(14)).alias("s")).collect()
    hashes = {r["id"]: int.from_bytes(bytes(r["s"])[8:12], "little") for r in alone}  # a lone value's: 6 bits of rank, 26 of place
    higher = {v for v, h in hashes.items() if h >> 26 > found[h % bits.REGISTERS]}
    assert 0 < len(higher) < 60
    keyed = lambda df: df.select(F.col("id").alias("key"), F.col("value"))
    many = spark.range(20000, 20060).repartition(2)
    states = keyed(many.crossJoin(old.select("value")))
    changed = bits.pfadd_changed(states, many.select(F.col("id").alias("key"), F.col("id").alias("value"))).where("changed").collect()
    assert {r["key"] for r in changed} == higher


def renamed_in_turn(state: dict, pairs: list) -> dict:
    """RENAMENX, pair by pair and over again, until none finds its target free."""
    state, left, found = dict(state), sorted(pairs), True
    while found:
        found = next(((a, b) for a, b in left if a in state and b not in state), None)
        if found:
            state[found[1]] = state.pop(found[0])
            left.remove(found)
    return state


@pytest.mark.parametrize(
    "pairs",
    [
        [("a", "b"), ("b", "z")],  # b is free once it has moved
        [("b", "a"), ("a", "z")],
        [("a", "b"), ("b", "c")],  # c stays, so both do
        [("a", "a"), ("b", "a")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("d", "z")],  # a ring
        [("a", "z"), ("b", "z"), ("c", "b")],  # one of two gets the target
        [("a", "z"), ("a", "z")],
        [(chr(97 + i), chr(98 + i)) for i in range(11)],  # a chain of eleven
        [(chr(97 + i), chr(98 + i)) for i in range(11)][::-1] + [("l", "c")],
        [("x", "y")],
    ],
)
def test_renamenx_as_in_turn(spark, pairs):
    held = {chr(97 + i): str(i) for i in range(12)} if len(pairs) > 10 else {k: k.upper() for k in "abcd"}
    if len(pairs) == 11:
        del held["l"]
    ks = spark.createDataFrame(list(held.items()), "key string, value string")
    found = keys.rename(ks, spark.createDataFrame(pairs, "key string, new string"), only_new=True).collect()
    assert sorted(map(tuple, found)) == sorted(renamed_in_turn(held, list(dict.fromkeys(pairs))).items())


def test_renamenx_of_keys_that_leave(spark, tmp_path):
    from keelson.plans import catalogue
    from tests.oracle import same

    parts = [(i, f"part {i}") for i in (0, 1, 2, 11, 21, 31, 1000011, 1000031, 2000011)]  # 11 moves to where 1000011 leaves
    path = f"{tmp_path}/part.parquet"
    spark.createDataFrame(parts, "p_partkey long, p_name string").toPandas().to_parquet(path)
    same(catalogue.queries()["renamenx"](spark, str(tmp_path)), catalogue.oracle_sql()["renamenx"], str(tmp_path))
