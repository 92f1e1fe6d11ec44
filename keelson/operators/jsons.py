"""JSON documents: rows (key, doc). Plain paths of fields stay in the JVM; scans, slices, filters and updates go
through a path engine in a pandas UDF, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from keelson.functions import jsonpath


def get(docs: DataFrame, path: str) -> DataFrame:
    """(key, value): the value at a plain path as JSON text or bare string."""
    return docs.select("key", F.get_json_object("doc", path).alias("value"))


def typed(docs: DataFrame, path: str, kind: str) -> DataFrame:
    return docs.select("key", F.try_variant_get(F.parse_json("doc"), path, kind).alias("value"))


def dumps(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def select_all(path: str) -> Callable[[Column], Column]:
    """A function of a document column: the JSON array of all matches of any path, null for a null document."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else dumps(jsonpath.select(json.loads(d), path)))

    return run


def changed(path: str, change: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A function of a document column: the document with each match replaced by change(match)."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str | None) -> str | None:
            if d is None:
                return None
            holder, places = jsonpath.evaluate(json.loads(d), path)
            for p in places:
                p[0][p[1]] = change(jsonpath.get(p))
            return dumps(holder["$"])

        return docs.map(one)

    return run


def set_(path: str, value: Any, only: str | None = None) -> Callable[[Column], Column]:
    """JSON.SET: replaces matches; a last field that is missing is made, unless only is XX; NX changes no match."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str | None) -> str | None:
            if d is None:
                return None
            holder, places = jsonpath.evaluate(json.loads(d), path)
            if places and only != "NX":
                for p in places:
                    p[0][p[1]] = value
            elif not places and only != "XX":
                *head, (kind, name) = jsonpath.steps(path)
                if kind == "field":
                    parents: list = [(holder, "$")]
                    for k, arg in head:
                        parents = [q for p in parents for q in (jsonpath.below(p) if k == "down" else jsonpath.step(p, k, arg, holder["$"]))]
                    for p in parents:
                        if isinstance(jsonpath.get(p), dict):
                            jsonpath.get(p)[name] = value
            return dumps(holder["$"])

        return docs.map(one)

    return run


def delete(path: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str | None) -> str | None:
            if d is None:
                return None
            holder, places = jsonpath.evaluate(json.loads(d), path)
            for p in sorted(places, key=lambda p: p[1] if isinstance(p[1], int) else -1, reverse=True):  # later items first
                del p[0][p[1]]
            return dumps(holder["$"]) if "$" in holder else None

        return docs.map(one)

    return run


def numincrby(path: str, by: float) -> Callable[[Column], Column]:
    return changed(path, lambda v: v + by if isinstance(v, int | float) and not isinstance(v, bool) else v)


def nummultby(path: str, by: float) -> Callable[[Column], Column]:
    return changed(path, lambda v: v * by if isinstance(v, int | float) and not isinstance(v, bool) else v)


def toggle(path: str) -> Callable[[Column], Column]:
    return changed(path, lambda v: not v if isinstance(v, bool) else v)


def clear(path: str) -> Callable[[Column], Column]:
    """Containers become empty, numbers zero."""
    return changed(path, lambda v: {} if isinstance(v, dict) else [] if isinstance(v, list) else 0 if isinstance(v, int | float) and not isinstance(v, bool) else v)


def strappend(path: str, more: str) -> Callable[[Column], Column]:
    return changed(path, lambda v: v + more if isinstance(v, str) else v)


def arrappend(path: str, *items: Any) -> Callable[[Column], Column]:
    return changed(path, lambda v: [*v, *items] if isinstance(v, list) else v)


def arrinsert(path: str, index: int, *items: Any) -> Callable[[Column], Column]:
    def change(v: Any) -> Any:
        if not isinstance(v, list):
            return v
        at = max(0, index + len(v)) if index < 0 else min(index, len(v))
        return [*v[:at], *items, *v[at:]]

    return changed(path, change)


def arrpop(path: str, index: int = -1) -> Callable[[Column], Column]:
    """The array without an item; indexes beyond its ends mean the end."""

    def change(v: Any) -> Any:
        if not isinstance(v, list) or not v:
            return v
        at = max(-len(v), min(index, len(v) - 1)) % len(v)
        return v[:at] + v[at + 1 :]

    return changed(path, change)


def arrpop_reply(path: str, index: int = -1) -> Callable[[Column], Column]:
    """What JSON.ARRPOP returns: the popped item of the first match as JSON, null for an empty or other value."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str | None) -> str | None:
            found = [] if d is None else jsonpath.select(json.loads(d), path)
            array = found[0] if found and isinstance(found[0], list) else []
            return dumps(array[max(-len(array), min(index, len(array) - 1))]) if array else None

        return docs.map(one)

    return run


# The names of the types of JSON values.
TYPE_NAMES = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object"), (type(None), "null"))


def types_at(path: str) -> Callable[[Column], Column]:
    """JSON.TYPE by path: the types of all matches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(docs: pd.Series) -> pd.Series:
        name = lambda v: next(n for t, n in TYPE_NAMES if isinstance(v, t))
        return docs.map(lambda d: None if d is None else [name(v) for v in jsonpath.select(json.loads(d), path)])

    return run


def protocol(v: Any) -> Any:
    """A value as the protocol's tree: objects and arrays as lists that begin with their bracket, booleans by name."""
    if isinstance(v, dict):
        return ["{", *(x for k, w in v.items() for x in (k, protocol(w)))]
    if isinstance(v, list):
        return ["[", *map(protocol, v)]
    return ("true" if v else "false") if isinstance(v, bool) else v


def resp(path: str = "$") -> Callable[[Column], Column]:
    """JSON.RESP: the protocol's tree of each match, as a JSON array."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else dumps([protocol(v) for v in jsonpath.select(json.loads(d), path)]))

    return run


def laid_out(v: Any, indent: str, newline: str, space: str, depth: int = 0) -> str:
    """JSON with the given signs before members, between lines and after colons."""
    if not isinstance(v, dict | list) or not v:
        return dumps(v)
    inner = [(dumps(k) + ":" + space if isinstance(v, dict) else "") + laid_out(v[k] if isinstance(v, dict) else k, indent, newline, space, depth + 1) for k in v]
    begin, end = "{}" if isinstance(v, dict) else "[]"
    return begin + newline + ("," + newline).join(indent * (depth + 1) + x for x in inner) + newline + indent * depth + end


def get_paths(*paths: str, indent: str = "", newline: str = "", space: str = "") -> Callable[[Column], Column]:
    """JSON.GET of one path (the array of its matches) or several (an object of such arrays by path), laid out."""

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str | None) -> str | None:
            if d is None:
                return None
            doc = json.loads(d)
            found = {p: jsonpath.select(doc, p) for p in paths}
            return laid_out(found if len(paths) > 1 else found[paths[0]], indent, newline, space)

        return docs.map(one)

    return run


def arrtrim(path: str, start: int, stop: int) -> Callable[[Column], Column]:
    def change(v: Any) -> Any:
        if not isinstance(v, list):
            return v
        n = len(v)
        a, b = (max(0, i + n) if i < 0 else i for i in (start, stop))
        return v[a : b + 1]

    return changed(path, change)


def arrindex(path: str, item: Any, start: int = 0, stop: int = 0) -> Callable[[Column], Column]:
    """The index of an item in the first match, -1 if it isn't there; stop 0 means the end."""

    @F.pandas_udf(T.LongType())
    def run(docs: pd.Series) -> pd.Series:
        def one(d: str) -> int:
            found = jsonpath.select(json.loads(d), path)
            array = found[0] if found and isinstance(found[0], list) else []
            return next((i for i in range(len(array))[start : stop or None] if array[i] == item and type(array[i]) is type(item)), -1)

        return docs.map(one)

    return run


def type_name(c: Column) -> Column:
    """The type of a document's root, from its VARIANT's schema."""
    v = F.schema_of_variant(F.parse_json(c))
    return F.when(v.startswith("OBJECT"), "object").when(v.startswith("ARRAY"), "array").when(v == "STRING", "string").when(v == "BOOLEAN", "boolean").when(v == "VOID", "null").when(v == "BIGINT", "integer").otherwise("number")
