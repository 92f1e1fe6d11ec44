"""Chat formatting with linked tool calls, by DataFrame operations alone.

Calls and results meet by a hash join on (conversation, call id): the side that is built has one row for each id. A
call's arguments may refer to earlier results ({"$ref": "<call id>"}, at any depth); those references and the turn order
give the order: a call comes after what it refers to, a result after its call. Arguments are validated against the
tool's schema, and each message is serialised as canonical JSON: keys sorted at every depth, no blanks, the shortest
escapes, decimals without trailing zeros (a number written with an exponent is a double, and 1e2 is 100.0).

Topological order. A message's level is the longest way to it: level(result) = level(call) + 1, level(call) = 1 + the
highest level of the results that it refers to, 0 without any. Calls are settled in rounds, each a few joins: a call
is settled once all calls that it refers to are, and a reference to a call that waits for one other only is led on to
that other, so that the rest of a chain halves in each round. The rounds end when one settles no call: each call left
then waits for one that is left too, so it lies on a cycle or behind one. It is flagged (`cyclic`), not dropped, and
comes after the settled results that it refers to. Messages are then ordered by (conversation, level, turn, kind, id).
The place of a message in its conversation isn't found by a window over the conversation, as one conversation may hold
a third of all rows: messages are range-partitioned by the order itself, and places are counted per range and
conversation and offset by the ranges before.

Duplicates. Of several calls with one id in a conversation, the first by (turn, tool, arguments) is the call and the
others are `duplicate`; all results that name its id are linked to it, the first by (turn, content) is the answer.

Defined cases: a call without result is `unanswered`, a result without call an `orphan`; a null id never links; null
arguments are an empty object; arguments that aren't a JSON object, or that hold a key twice at any depth, are invalid
and go out as a string; a tool without schema is `unknown`; a null conversation, turn or text is carried as null;
repeated rows are each returned; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import materialise, release, table

# The types of JSON Schema, and the types of variants that each of them takes.
KINDS = {"string": "STRING", "object": "OBJECT.*", "array": "ARRAY.*", "boolean": "BOOLEAN", "null": "VOID", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DECIMAL.*|DOUBLE|FLOAT"}
#: Columns of a schema's rows beyond tool, name, type and required, which may be left out.
FACETS = {"enum": "array<string>", "max_length": "int", "items": "string"}


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is."""
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, '"', r'\\"')
    for sign, escaped in (("\b", r"\\b"), ("\f", r"\\f"), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        c = F.regexp_replace(c, sign, escaped)
    for code in (*range(0, 8), 11, *range(14, 32)):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_object(fields: dict[str, Column]) -> Column:
    """A JSON object of fields that are JSON already, in order of their names; null fields are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def parsed(arguments: Column) -> Column:
    """The arguments as a variant; null if they are no JSON object, or hold a key twice."""
    v = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def is_a(value: Column, kind: Column) -> Column:
    """Whether a variant is of a type of JSON Schema; any other name of a type takes all."""
    own = F.schema_of_variant(value)
    return F.coalesce(*[F.when(kind == k, own.rlike(f"^({pattern})$")) for k, pattern in KINDS.items()], F.lit(True))


def fits(given: Column, params: Column) -> Column:
    """Whether an object keeps to a tool's parameters: structs of name, type, required and FACETS. A name with dots lies
    deeper and is required where its parent is there; members at the top that have no row aren't allowed."""
    segments = lambda name: F.concat(F.lit("$"), F.array_join(F.transform(F.split(name, r"\."), lambda x: F.concat(F.lit("['"), x, F.lit("']"))), ""))
    value = lambda name: F.try_variant_get(given, segments(name), "variant")
    parent = lambda name: F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)

    def one(p: Column) -> Column:
        v = value(p["name"])
        within = F.when(p["enum"].isNotNull(), F.array_contains(p["enum"], F.to_json(v))).otherwise(F.lit(True))
        short = F.when(p["max_length"].isNotNull() & is_a(v, F.lit("string")), F.length(F.try_variant_get(v, F.lit("$"), "string")) <= p["max_length"]).otherwise(F.lit(True))
        each = F.when(p["items"].isNotNull() & is_a(v, F.lit("array")), F.forall(F.try_variant_get(v, F.lit("$"), "array<variant>"), lambda x: is_a(x, p["items"]))).otherwise(F.lit(True))
        missing = p["required"] & ((parent(p["name"]) == "") | value(parent(p["name"])).isNotNull())
        return F.when(v.isNull(), ~F.coalesce(missing, F.lit(False))).otherwise(F.coalesce(is_a(v, p["type"]) & within & short & each, F.lit(False)))

    members = F.map_keys(F.try_variant_get(given, F.lit("$"), "map<string,variant>"))
    return F.forall(params, one) & F.forall(members, lambda k: F.exists(params, lambda p: p["name"] == k))


def settle(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of the calls in edges (conv_id, call_id, to); see the module's text.

    However many rounds it takes, what they settled is gathered in one table after every `rounds` of them.
    """
    key = ["conv_id", "call_id"]
    callers = edges.select(*key).distinct()
    fresh = materialise(edges.select("conv_id", F.col("to").alias("call_id")).distinct().join(callers, key, "left_anti").withColumn("level", F.lit(0)), "levels")
    settled, loose = [fresh], []
    # open references: to what, how many levels below it, and how low the call's level can be at least
    left = materialise(edges.select(*key, "to", F.lit(2).alias("step"), F.lit(0).alias("least")), "references")
    while left.limit(1).count():
        seen = left.join(fresh.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below")), ["conv_id", "to"], "left")
        least = F.max(F.greatest("least", F.col("below") + F.col("step")))  # a null bound doesn't count
        state = materialise(seen.groupBy(*key).agg(least.alias("least"), F.count(F.when(F.col("below").isNull(), 1)).alias("open")), "levels")
        fresh = materialise(state.where("open = 0").select(*key, F.col("least").alias("level")), "levels")
        if not fresh.limit(1).count():
            break
        settled.append(fresh)
        if len(settled) > rounds:
            spent, settled = settled, [materialise(reduce(DataFrame.union, settled), "levels")]
            release(*spent[:-2])  # this round still reads the last ones
            loose += spent[-2:]
        rest = seen.where("below IS NULL").select(*key, "to", "step").join(state.where("open > 0").select(*key, "least"), key)
        # a reference to a call that waits for one other only is led on to that one
        on = rest.join(state.where("open = 1").select(*key), key, "left_semi").select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("step").alias("more"), F.col("least").alias("base"))
        led = rest.join(on, ["conv_id", "to"], "left").select(*key, F.coalesce("next", "to").alias("to"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.greatest("least", F.col("base") + F.col("step")).alias("least"))
        spent, left = left, materialise(led.groupBy(*key, "to").agg(F.max("step").alias("step"), F.max("least").alias("least")), "references")
        release(spent, state)
    levels = reduce(DataFrame.union, settled)
    after = edges.join(left.select(*key).distinct(), key, "left_semi").join(levels.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
    cyclic = after.groupBy(*key).agg(F.coalesce(F.max("level") + 2, F.lit(0)).alias("level"))
    out = materialise(levels.withColumn("cyclic", F.lit(False)).union(cyclic.withColumn("cyclic", F.lit(True))), "levels")
    release(left, *settled, *loose)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, rounds: int = 64) -> DataFrame:
    """Messages in order.

    calls: conv_id, turn, call_id, tool, arguments (JSON object). results: conv_id, turn, call_id, content.
    schemas: tool, name, type (of JSON Schema), required (boolean), and any of enum (JSON texts), max_length (characters)
    and items (the type of an array's items): one row per parameter, a null name for a tool without any.
    Returns conv_id, place, level, turn, kind (call or result), call_id, tool, status, valid, cyclic, json.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), F.col("tool").cast("string").alias("tool"), F.coalesce(F.col("arguments").cast("string"), F.lit("{}")).alias("arguments"))
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content"))

    # which call an id names, and which result answers it: map-side minima, no group in one place
    named = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "tool", "arguments")).alias("call"))
    answers = results.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.xxhash64("content").alias("h"))).alias("answer"))
    both = materialise(named.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full"), "linked")

    # references: "$ref" strings within the arguments of calls that count
    refs = F.array_distinct(F.regexp_extract_all("call.arguments", F.lit(r'"\$ref"\s*:\s*"([^"\\]+)"'), F.lit(1)))
    edges = both.where("call IS NOT NULL").select("conv_id", "call_id", F.explode(refs).alias("to"))
    answered = both.where("call IS NOT NULL AND answer IS NOT NULL").select("conv_id", F.col("call_id").alias("to"))
    edges = materialise(edges.join(answered.hint("shuffle_hash"), ["conv_id", "to"]), "references")
    levels = settle(edges, rounds)
    release(edges)
    known = materialise(both.join(levels.hint("shuffle_hash"), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "call", "answer", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")), "linked")
    release(both, levels)

    # validation: one row per tool with its parameters, which a schema bounds
    facets = [F.col(c).cast(t).alias(c) if c in schemas.columns else F.lit(None).cast(t).alias(c) for c, t in FACETS.items()]
    rows = schemas.select("tool", "name", "type", "required", *facets)
    params = rows.groupBy("tool").agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "type", "required", *FACETS))).alias("params"))
    calls = calls.join(params, "tool", "left").withColumn("given", parsed(F.col("arguments")))
    calls = calls.withColumn("valid", F.when(F.col("params").isNull() | F.col("given").isNull(), F.lit(False)).otherwise(F.coalesce(fits(F.col("given"), F.col("params")), F.lit(False))))

    calls = calls.join(known.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    counted = F.struct("turn", "tool", "arguments").eqNullSafe(F.col("call"))
    call_status = F.when(F.col("call_id").isNull() | ~counted, F.when(F.col("call_id").isNull(), "unanswered").otherwise("duplicate")).when(F.col("answer").isNull(), "unanswered").when(F.col("params").isNull(), "unknown").otherwise("linked")
    made = json_object({"arguments": F.coalesce(F.to_json("given"), quoted(F.col("arguments"))), "id": quoted(F.col("call_id")), "name": quoted(F.col("tool")), "role": F.lit('"assistant"'), "type": F.lit('"function_call"')})
    call_rows = calls.select("conv_id", F.coalesce("level", F.lit(0)).alias("level"), "turn", F.lit("call").alias("kind"), "call_id", "tool", call_status.alias("status"), "valid", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), made.alias("json"))

    results = results.join(known.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    is_answer = F.struct("turn", F.xxhash64("content").alias("h")).eqNullSafe(F.col("answer"))
    result_status = F.when(F.col("call").isNull(), "orphan").when(is_answer, "linked").otherwise("duplicate")
    said = json_object({"content": quoted(F.coalesce("content", F.lit(""))), "id": quoted(F.col("call_id")), "role": F.lit('"tool"'), "type": F.lit('"function_result"')})
    level = F.when(F.col("call").isNull(), 0).otherwise(F.coalesce("level", F.lit(0)) + 1)
    result_rows = results.select("conv_id", level.alias("level"), "turn", F.lit("result").alias("kind"), "call_id", F.col("call.tool").alias("tool"), result_status.alias("status"), F.lit(None).cast("boolean").alias("valid"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), said.alias("json"))
    messages = materialise(call_rows.union(result_rows), "messages")  # the ranges' sample reads them, too
    release(known)
    return placed(messages)


def placed(messages: DataFrame) -> DataFrame:
    """messages with `place`, from 0 in each conversation, by range partitions of the order and their counts."""
    spark = messages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "level", "turn", "kind", "call_id", "json"]
    ranged = materialise(messages.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "messages")
    sizes = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    # within a conversation the ranges follow each other; at most n of them
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = Window.partitionBy("part", "conv_id").orderBy(*order[1:])  # a range's rows, a task's worth
    release(messages)
    joined = ranged.withColumn("rn", F.row_number().over(here)).join(offsets.toDF("p", "c", "offset"), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", (F.col("offset") + F.col("rn") - 1).cast("long").alias("place"), "level", "turn", "kind", "call_id", "tool", "status", "valid", "cyclic", "json")


def from_turns(conversations: DataFrame, ring: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results. Each user or system turn asks the tool named by its role, with the text,
    the turn and, if the turn before is a reply, a reference to the call that it answers; each assistant turn is the
    result of the turn before it. Where ring holds, turns 0 and 1 also refer to the call two and three turns on, which
    closes a ring with the references back where those turns are calls."""
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks = F.coalesce(F.col("role") != "assistant", F.lit(True)) & whole
    ref = lambda turn: F.concat(F.lit('{"$ref":'), quoted(name(turn)), F.lit("}"))
    replies = conversations.where(~asks & whole).select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).distinct()
    turns = conversations.where(asks).join(replies.hint("shuffle_hash"), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    after = F.when(F.col("t").isNotNull(), F.concat(F.lit(',"after":'), ref(F.col("turn") - 2))).otherwise(F.lit(""))
    first = F.when((F.lit(False) if ring is None else ring) & (F.col("turn") < 2), F.concat(F.lit(',"before":['), ref(F.col("turn") + 2), F.lit("]"))).otherwise(F.lit(""))
    arguments = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"text":'), quoted(F.coalesce("text", F.lit(""))), after, first, F.lit("}"))
    calls = turns.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.coalesce("role", F.lit("user")).alias("tool"), arguments.alias("arguments"))
    results = conversations.where(~asks).select("conv_id", "turn", F.when(whole, name(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: The tools that turns ask. A text may have so many characters; a system turn comes first, and takes no references.
LONGEST = 1000
SCHEMAS = [
    *[(tool, "text", "string", True, None, LONGEST, None) for tool in ("user", "system")],
    ("user", "turn", "integer", True, None, None, None),
    ("system", "turn", "integer", True, ["0"], None, None),
    ("user", "after", "object", False, None, None, None),
    ("user", "after.$ref", "string", True, None, None, None),
    ("user", "before", "array", False, None, None, "object"),
]


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_turns(table(spark, sf_dir, "conversations"), F.col("conv_id") % 10 == 0)
    schemas = spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean, enum array<string>, max_length int, items string")
    found = link(calls, results, schemas)
    return found.select("conv_id", "place", "level", "turn", "kind", "call_id", "tool", "status", "valid", "cyclic", F.sha2("json", 256).alias("json_sha256"))


OP4_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT *, '"' || replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(8), '\b'), chr(12), '\f'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS js FROM c),
says AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id,
    '{"content":' || js || ',"id":"' || conv_id || ':' || (turn - 1) || '","role":"tool","type":"function_result"}' AS js FROM q WHERE role = 'assistant'),
asks AS (SELECT q.conv_id, q.turn, q.conv_id || ':' || q.turn AS call_id, role AS tool, text, r.turn IS NOT NULL AS follows, q.conv_id % 10 = 0 AND q.turn < 2 AS rings, q.js AS quoted
    FROM q LEFT JOIN (SELECT DISTINCT conv_id, turn FROM says) r ON r.conv_id = q.conv_id AND r.turn = q.turn - 1 WHERE role <> 'assistant'),
calls AS (SELECT *, CASE WHEN tool = 'system' THEN length(text) <= 1000 AND turn = 0 AND NOT follows AND NOT rings ELSE length(text) <= 1000 END AS valid,
    '{"arguments":{' || CASE WHEN follows THEN '"after":{"$ref":"' || conv_id || ':' || (turn - 2) || '"},' ELSE '' END || CASE WHEN rings THEN '"before":[{"$ref":"' || conv_id || ':' || (turn + 2) || '"}],' ELSE '' END
    || '"text":' || quoted || ',"turn":' || turn || '},"id":"' || call_id || '","name":"' || tool || '","role":"assistant","type":"function_call"}' AS js FROM asks),
refs AS (SELECT conv_id, turn, turn - 2 AS target FROM asks WHERE follows UNION SELECT conv_id, turn, turn + 2 FROM asks WHERE rings),
edges AS (SELECT DISTINCT r.conv_id, r.turn, r.target FROM refs r JOIN asks a ON a.conv_id = r.conv_id AND a.turn = r.target JOIN says s ON s.conv_id = r.conv_id AND s.turn = r.target + 1),
many AS (SELECT conv_id, count(*) AS n FROM asks GROUP BY conv_id),
paths AS (SELECT conv_id, turn, target, 1 AS steps FROM edges
    UNION SELECT p.conv_id, p.turn, e.target, p.steps + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.turn = p.target JOIN many m ON m.conv_id = p.conv_id WHERE p.steps <= m.n),
longest AS (SELECT conv_id, turn, max(steps) AS steps FROM paths GROUP BY conv_id, turn),
settled AS (SELECT a.conv_id, a.turn, coalesce(l.steps, 0) > m.n AS cyclic, 2 * coalesce(l.steps, 0) AS level FROM asks a JOIN many m USING (conv_id) LEFT JOIN longest l ON l.conv_id = a.conv_id AND l.turn = a.turn),
levels AS (SELECT s.conv_id, s.turn, s.cyclic, CASE WHEN s.cyclic THEN coalesce((SELECT max(t.level) + 2 FROM edges e JOIN settled t ON t.conv_id = e.conv_id AND t.turn = e.target AND NOT t.cyclic WHERE e.conv_id = s.conv_id AND e.turn = s.turn), 0) ELSE s.level END AS level FROM settled s),
m AS (
  SELECT a.conv_id, l.level, a.turn, 'call' AS kind, a.call_id, a.tool,
         CASE WHEN s.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, a.valid, l.cyclic, a.js
  FROM calls a JOIN levels l ON l.conv_id = a.conv_id AND l.turn = a.turn LEFT JOIN (SELECT DISTINCT conv_id, call_id FROM says) s ON s.conv_id = a.conv_id AND s.call_id = a.call_id
  UNION ALL
  SELECT s.conv_id, CASE WHEN a.call_id IS NULL THEN 0 ELSE l.level + 1 END, s.turn, 'result', s.call_id, a.tool,
         CASE WHEN a.call_id IS NULL THEN 'orphan' ELSE 'linked' END, NULL, coalesce(l.cyclic, false), s.js
  FROM says s LEFT JOIN asks a ON a.conv_id = s.conv_id AND a.call_id = s.call_id LEFT JOIN levels l ON l.conv_id = a.conv_id AND l.turn = a.turn)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, kind, call_id, js) - 1 AS place,
       level, turn, kind, call_id, tool, status, valid, cyclic, sha256(js) AS json_sha256
FROM m
"""
