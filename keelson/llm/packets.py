"""Rows that carry arrays: numbers move between tasks in packets, a row for each pair of tasks, not a row for each number.

A packet has a home (the partition it is dealt to), the id of what it belongs to, its kind, a part, a count and up to
three cells of numbers. Sorting, grouping and joining then happen within tasks, on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["home", "id", "kind", "part", "n", "a", "b", "c"]
PACKET = "home int, id long, kind int, part int, n long, a binary, b binary, c binary"
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: Bytes of a batch of packets.
BATCH = 4 << 20

Row = tuple[int, int, int, int, int, bytes | None, bytes | None, bytes | None]


def batches_of(rows: Iterable[tuple], names: list[str] = NAMES, types: list[pa.DataType] = TYPES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH or len(held) >= 20_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def rows_of(batches: Iterable[pa.RecordBatch], names: list[str] = NAMES) -> Iterator[tuple]:
    """The rows of batches; binary cells as buffers, null ones as None."""
    for batch in batches:
        columns = []
        for name in names:
            c = batch.column(name)
            columns.append([x.as_buffer() if x.is_valid else None for x in c] if pa.types.is_binary(c.type) else c.to_pylist())
        yield from zip(*columns, strict=True)


def numbers(cell, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(cell, kind) if cell is not None else np.empty(0, kind)


def put(*arrays: np.ndarray) -> bytes:
    """Several arrays of integers in one cell."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    return np.concatenate((head, *arrays)).astype(np.int64).tobytes()


def got(cell) -> list[np.ndarray]:
    """The arrays of a cell that put() made."""
    flat = np.frombuffer(cell, np.int64)
    sizes = flat[1 : 1 + flat[0]]
    return np.split(flat[1 + len(sizes) :], np.cumsum(sizes)[:-1])


def dealt(packets: DataFrame, n: int) -> DataFrame:
    """Packets at their homes."""
    return packets.repartitionById(n, F.col("home"))


def mapped(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Packets to packets, a task's worth at once."""
    return df.mapInArrow(lambda batches: batches_of(fn(rows_of(batches))), PACKET)


def at_home(tables: list[DataFrame], n: int, fn: Callable[[int, dict[int, list[tuple]]], Iterator[tuple]], schema: str = PACKET, types: list[pa.DataType] | None = None) -> DataFrame:
    """fn(id, packets by kind) of each id, with all that several tables hold of it. A home's packets fit a task.

    The packets of a kind are in order of their part.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, list[tuple]]] = {}
        for row in rows_of(batches):
            found.setdefault(row[1], {}).setdefault(row[2], []).append(row)

        def each() -> Iterator[tuple]:
            for key in sorted(found):
                kinds = found.pop(key)
                for rows in kinds.values():
                    rows.sort(key=lambda r: r[3])
                yield from fn(key, kinds)

        yield from batches_of(each(), names, types or TYPES)

    return dealt(reduce(DataFrame.union, tables), n).mapInArrow(run, schema)


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, group): rows sorted by columns, where each distinct row begins in that order, each row's number among the distinct."""
    code, size = None, 1
    for c in columns:
        u, inverse = np.unique(c, return_inverse=True)
        if code is None:
            code, size = inverse, len(u)
        else:
            if size * len(u) >= 1 << 62:  # more combinations than a number can tell apart: number those that occur
                code = np.unique(code, return_inverse=True)[1]
                size = int(code.max(initial=0)) + 1
            code, size = code * len(u) + inverse, size * max(1, len(u))
    order = np.argsort(code)
    ranked = code[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.nonzero(first)[0], group


def home_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The home of a number, as F.pmod(id, n) gives it."""
    return (ids % n).astype(np.int64)


def spread_by(letters: np.ndarray, n: int) -> np.ndarray:
    """One of n parts for 63-bit numbers whose bits are mixed, in their order."""
    return ((letters >> 31) * n) >> 32
