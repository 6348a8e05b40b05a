"""Numeric functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int, *keys: Column) -> Column:
    """A 32-bit draw from a seed and keys; the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def signed(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%+.{digits}f", c)


def cell(c: Column) -> Column:
    """Text that may stand in a cell of a table with ``|`` borders."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def to_float(c: Column) -> Column:
    """The number that a text says, else null."""
    return F.trim(c).try_cast("double")


def to_bool(c: Column) -> Column:
    return F.lower(F.trim(c)) == "true"


def edge_width(weight: Column, also_sequential: Column) -> Column:
    return 1 + 0.7 * F.log1p(weight) + F.when(also_sequential, 0.5).otherwise(0.0)
