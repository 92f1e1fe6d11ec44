"""A registry of scripts by the SHA-1 of their source: functions of columns, which stay within the JVM; and what scripts
find in their libraries (bit, struct, cjson), as functions of columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scripts:
    def __init__(self):
        self.known: dict[str, Callable[..., Column]] = {}

    def load(self, source: str, fn: Callable[..., Column]) -> str:
        sha = hashlib.sha1(source.encode()).hexdigest()
        self.known[sha] = fn
        return sha

    def exists(self, *shas: str) -> list[bool]:
        return [s in self.known for s in shas]

    def flush(self) -> None:
        self.known.clear()

    def call(self, sha: str, *args: Column) -> Column:
        if sha not in self.known:
            raise KeyError("NOSCRIPT no matching script")
        return self.known[sha](*args)


def tobit(x: Column) -> Column:
    """A number as a signed 32-bit one, as bit operations give it."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32)


def band(a: Column, b: Column) -> Column:
    return tobit(a.cast("long").bitwiseAND(b.cast("long")))


def bor(a: Column, b: Column) -> Column:
    return tobit(a.cast("long").bitwiseOR(b.cast("long")))


def bxor(a: Column, b: Column) -> Column:
    return tobit(a.cast("long").bitwiseXOR(b.cast("long")))


def bnot(a: Column) -> Column:
    return tobit(F.bitwise_not(a.cast("long")))


def lshift(a: Column, n: int) -> Column:
    return tobit(F.shiftleft(a.cast("long"), n % 32))


def rshift(a: Column, n: int) -> Column:
    """Zeros come in from the left."""
    return tobit(F.shiftright(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), n % 32))


def arshift(a: Column, n: int) -> Column:
    return F.shiftright(tobit(a), n % 32)


def pack(x: Column, kind: str) -> Column:
    """struct.pack of one integer: > or < (the first byte is the highest or the lowest), then I or i and 1, 2, 4 or 8 bytes."""
    width = int(kind[2:])
    digits = F.lpad(F.right(F.hex(x.cast("long")), F.lit(2 * width)), 2 * width, "0")
    if kind[0] == "<":
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.unhex(digits)


def unpack(data: Column, kind: str) -> Column:
    """struct.unpack of one integer from the first bytes."""
    width = int(kind[2:])
    places = range(width) if kind[0] == ">" else reversed(range(width))
    total = F.lit(0).cast("long")
    for i in places:
        total = F.shiftleft(total, 8).bitwiseOR(F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long"))
    return F.shiftright(F.shiftleft(total, 64 - 8 * width), 64 - 8 * width) if kind[1] == "i" and width < 8 else total


def encode(**fields: Column) -> Column:
    """cjson.encode of a table of named values."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def decode(text: Column, schema: str) -> Column:
    """cjson.decode into a type; text that is no JSON gives null."""
    return F.from_json(text, schema)
