"""Custom objects: a type of its own is a class that says how a command's argument becomes an entry, and how entries of
one name combine. Its state is rows (key, member, value), so that one object may be larger than a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.keys import page


class CustomObject:
    """What a type defines; both are columns, so that Spark combines entries before rows move."""

    @staticmethod
    def entry(arg: Column) -> tuple[Column, Column]:
        """(member, value) that a command with this argument adds."""
        raise NotImplementedError

    @staticmethod
    def combine(value: Column) -> Column:
        """An aggregate over the values of one member."""
        raise NotImplementedError


class Tally(CustomObject):
    """How often each argument was given."""

    @staticmethod
    def entry(arg: Column) -> tuple[Column, Column]:
        return arg, F.lit(1).cast("long")

    @staticmethod
    def combine(value: Column) -> Column:
        return F.sum(value)


def custom(commands: DataFrame, kind: type[CustomObject]) -> DataFrame:
    """The state of objects after commands (key, arg)."""
    member, value = kind.entry(F.col("arg"))
    return commands.select("key", member.alias("member"), value.alias("value")).groupBy("key", "member").agg(kind.combine(F.col("value")).alias("value"))


def scan_object(entries: DataFrame, cursor: str | None, pattern: str = "*", count: int = 10) -> DataFrame:
    """CUSTOMOBJECTSCAN: the next entries of one object in order of their member."""
    return page(entries, "member", cursor, pattern, count)
