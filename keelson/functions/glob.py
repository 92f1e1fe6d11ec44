"""Glob patterns: * ? [abc] [^a-z] and \\ as escape. An empty string matches the empty pattern alone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """A Java and Python regular expression for a glob; * doesn't match the empty target."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and (end := pattern.find("]", i + 1)) > i + 1:
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out += "[" + "^" * negated + re.sub(r"([\\\[\]&~^])", r"\\\1", body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?!$){out}$" if pattern else "^$"


def glob_match(c: Column, pattern: str) -> Column:
    """A pattern of a literal and a last * becomes startswith, which Parquet can be asked; an exact literal becomes =."""
    plain = lambda p: not re.search(r"[*?\[\\]", p)
    if pattern and plain(pattern):
        return c == pattern
    if len(pattern) > 1 and pattern[-1] == "*" and plain(pattern[:-1]):
        return c.startswith(pattern[:-1])
    return c.rlike(glob_to_regex(pattern))
