"""Queries of JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import jsons as j
from keelson.plans.base import query
from keelson.sources.keyspace import table

#: An event as a document with an object, an array and values of each type.
DOC = """(SELECT event_id AS id, '{"t":"' || event_type || '","v":{"k":' || json_extract_string(props, '$.k') || ',"on":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '},"a":[' || (event_id % 5) || ',' || (event_id % 7) || ',' || (event_id % 3) || ']}' AS doc, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def docs(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    body = F.concat(
        F.lit('{"t":"'), F.col("event_type"), F.lit('","v":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"on":'), F.when(n % 2 == 0, "true").otherwise("false"),
        F.lit('},"a":['), (n % 5).cast("string"), F.lit(","), (n % 7).cast("string"), F.lit(","), (n % 3).cast("string"), F.lit("]}"),
    )
    return e.select(n.alias("key"), body.alias("doc"))


@query("json_get_mget", f"SELECT id AS key, json_extract_string(doc, '$.v.k') AS value FROM {DOC}")
def _(spark, d):
    return j.get(docs(spark, d), "$.v.k")


@query("json_get_typed", f"SELECT id AS key, k AS value FROM {DOC}")
def _(spark, d):
    return j.typed(docs(spark, d), "$.v.k", "long")


def over(name: str, sql: str, fn) -> None:
    query(name, sql)(lambda spark, d: docs(spark, d).select("key", fn(F.col("doc")).alias("value")))


def rebuilt(t="event_type", k="k", on="CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END", a="(id % 5) || ',' || (id % 7) || ',' || (id % 3)", more="''") -> str:
    return f"""SELECT id AS key, '{{"t":"' || {t} || '","v":{{"k":' || {k} || ',"on":' || {on} || '}},"a":[' || {a} || ']' || {more} || '}}' AS value FROM (SELECT event_id AS id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


over("json_get_scan", f"SELECT id AS key, '[' || k || ']' AS value FROM {DOC}", j.select_all("$..k"))
over("json_get_slice", "SELECT event_id AS key, '[' || (event_id % 7) || ',' || (event_id % 3) || ']' AS value FROM events", j.select_all("$.a[1:]"))
over("json_get_filter", "SELECT event_id AS key, '[' || array_to_string(list_filter([event_id % 5, event_id % 7, event_id % 3], lambda x: x > 1 AND x <> 4), ',') || ']' AS value FROM events", j.select_all("$.a[?(@ > 1 && @ != 4)]"))
over("json_set", rebuilt(t="'new'"), j.set_("$.t", "new"))
over("json_set_nx", rebuilt(more="""',"x":1'"""), j.set_("$.x", 1, "NX"))
over("json_set_xx", rebuilt(), j.set_("$.x", 1, "XX"))
over("json_del_forget", """SELECT event_id AS key, '{"t":"' || event_type || '","a":[' || (event_id % 5) || ',' || (event_id % 3) || ']}' AS value FROM events""", lambda c: j.delete("$.a[1]")(j.delete("$.v")(c)))
over("json_numincrby", rebuilt(k="(k + 5)"), j.numincrby("$.v.k", 5))
over("json_nummultby", rebuilt(k="(k * 3)"), j.nummultby("$..k", 3))
over("json_toggle", rebuilt(on="CASE WHEN id % 2 = 1 THEN 'true' ELSE 'false' END"), j.toggle("$.v.on"))
over("json_clear", """SELECT event_id AS key, '{"t":"' || event_type || '","v":{},"a":[]}' AS value FROM events""", lambda c: j.clear("$.a")(j.clear("$.v")(c)))
over("json_strappend", rebuilt(t="event_type || '-x'"), j.strappend("$.t", "-x"))
over("json_strlen", "SELECT event_id AS key, CAST(length(event_type) AS INTEGER) AS value FROM events", lambda c: F.length(F.get_json_object(c, "$.t")))
over("json_arrlen", "SELECT event_id AS key, 3 AS value FROM events", lambda c: F.json_array_length(F.get_json_object(c, "$.a")))
over("json_arrappend", rebuilt(a="(id % 5) || ',' || (id % 7) || ',' || (id % 3) || ',9'"), j.arrappend("$.a", 9))
over("json_arrinsert", rebuilt(a="(id % 5) || ',8,' || (id % 7) || ',' || (id % 3)"), j.arrinsert("$.a", 1, 8))
over("json_arrpop", rebuilt(a="(id % 5) || ',' || (id % 7)"), j.arrpop("$.a"))
over("json_arrpop_reply", "SELECT event_id AS key, CAST(event_id % 3 AS VARCHAR) AS value FROM events", j.arrpop_reply("$.a"))
over("json_get_paths", f"""SELECT id AS key, '{{ "$.t": [ "' || json_extract_string(doc, '$.t') || '" ], "$..k": [ ' || k || ' ] }}' AS value FROM {DOC}""", lambda c: F.regexp_replace(j.get_paths("$.t", "$..k", indent=" ", newline="\n", space=" ")(c), r"\s+", " "))
over("json_type_path", "SELECT event_id AS key, 'integer,boolean,object' AS value FROM events", lambda c: F.concat_ws(",", j.types_at("$.v.*")(c), j.types_at("$.v")(c)))
over("json_arrtrim", rebuilt(a="(id % 7) || ',' || (id % 3)"), j.arrtrim("$.a", 1, -1))
over("json_arrindex", "SELECT event_id AS key, CAST(coalesce(list_position([event_id % 5, event_id % 7, event_id % 3], 2), 0) - 1 AS BIGINT) AS value FROM events", j.arrindex("$.a", 2))
over("json_objkeys_objlen", "SELECT event_id AS key, 't,v,a:3' AS value FROM events", lambda c: F.concat(F.array_join(F.json_object_keys(c), ","), F.lit(":"), F.size(F.json_object_keys(c)).cast("string")))
over("json_type", "SELECT event_id AS key, 'object' AS value FROM events", j.type_name)


over("json_resp", """SELECT event_id AS key, '[["[",' || (event_id % 5) || ',' || (event_id % 7) || ',' || (event_id % 3) || '],["{","k",' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"on","' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '"]]' AS value FROM events""", j.resp("$['a','v']"))
