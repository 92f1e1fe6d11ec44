"""Attribute filters of vector searches, compiled to column expressions: `.year >= 2000 and .rating * 2 > 7`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(?P<sel>\.[A-Za-z_]\w*)|(?P<num>\d+(?:\.\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<op>\*\*|<=|>=|==|!=|[<>+\-*/%()\[\],]|\band\b|\bor\b|\bnot\b|\bin\b|!|&&|\|\|))")
LEVELS = [("or", "||"), ("and", "&&"), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"), ("**",)]


def compile_filter(text: str, attrs: Column) -> Column:
    """The filter over a column of JSON attributes. A missing attribute makes a comparison false."""
    tokens, i = [], 0
    while i < len(text.rstrip()):
        m = TOKEN.match(text, i)
        if not m:
            raise ValueError(f"bad filter at {text[i:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) else None

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def level(k: int):
        if k == len(LEVELS):
            return unary()
        left = level(k + 1)
        while peek() in LEVELS[k]:
            op = take()[1]
            left = apply(op, left, level(k if op == "**" else k + 1))
        return left

    def unary():
        if peek() in ("not", "!"):
            take()
            kind, inner = level(2)
            return "bool", ~F.coalesce(inner, F.lit(False))
        if peek() == "-":
            take()
            return "num", -numeric(unary())
        kind, said = take()
        if said == "(":
            inner = level(0)
            take()
            return inner
        if said == "[":
            items = []
            while peek() != "]":
                items.append(unary())
                if peek() == ",":
                    take()
            take()
            return "list", items
        if kind == "sel":
            return "sel", F.get_json_object(attrs, "$" + said)
        return ("num", F.lit(float(said))) if kind == "num" else ("str", F.lit(said[1:-1]))

    def numeric(x) -> Column:
        return x[1].try_cast("double") if x[0] in ("sel", "str") else x[1]

    def apply(op: str, a, b):
        if op in ("and", "&&"):
            return "bool", F.coalesce(a[1], F.lit(False)) & F.coalesce(b[1], F.lit(False))
        if op in ("or", "||"):
            return "bool", F.coalesce(a[1], F.lit(False)) | F.coalesce(b[1], F.lit(False))
        if op == "in":
            tests = [apply("==", a, x)[1] for x in b[1]]
            out = F.lit(False)
            for t in tests:
                out = out | F.coalesce(t, F.lit(False))
            return "bool", out
        if op in ("+", "-", "*", "/", "%", "**"):
            x, y = numeric(a), numeric(b)
            return "num", {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y), "**": F.pow(x, y)}[op]
        text_like = "str" in (a[0], b[0])
        x, y = (a[1], b[1]) if text_like else (numeric(a), numeric(b))
        return "bool", {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    out = level(0)[1]
    if at != len(tokens):
        raise ValueError("filter goes on where it should end")
    return F.coalesce(out, F.lit(False))
