"""Scalar expressions as Columns. All are built-in expressions: they stay in generated code and reach the scan as filters."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | bool


def attr(name: str) -> Column:
    """A column by name or by alias.name; unknown and ambiguous names are errors when the plan is analysed."""
    return F.col(name)


def const(value: object, kind: str | None = None) -> Column:
    """A literal; kind (int, double, string, date, ...) casts it. `1.5f` reads as 1.5 where the kind is a number."""
    if isinstance(value, str) and kind in ("int", "long", "float", "double"):
        value = float(value.rstrip("fF")) if kind in ("float", "double") else int(value)
    if kind == "date" and isinstance(value, str) and value.isdigit():
        value = f"{value[:4]}-{value[4:6]}-{value[6:]}"
    out = F.lit(value)
    return out.cast({"float": "double"}.get(kind, kind)) if kind else out


def equals(a: Column, b: Column) -> Column:
    return a == b


def smaller(a: Column, b: Column) -> Column:
    return a < b


def smaller_equal(a: Column, b: Column) -> Column:
    return a <= b


def larger(a: Column, b: Column) -> Column:
    return a > b


def larger_equal(a: Column, b: Column) -> Column:
    return a >= b


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions)


def negate(condition: Column) -> Column:
    return ~condition


def is_in(value: Column, members: Sequence[Value]) -> Column:
    return value.isin(*members)


def like(text: Column, pattern: str) -> Column:
    """SQL LIKE: `%` any run, `_` one character. A prefix and a suffix never share characters."""
    return text.like(pattern)


def substring(text: Column, start: int, length: int) -> Column:
    """Characters from a 1-based start; positions before the text count but hold nothing, as in the SQL standard."""
    stop = start + length
    start = max(start, 1)
    return F.substring(text, start, max(0, stop - start))


def case(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds; without one the last value, or null."""
    (condition, value), *rest = branches
    out = reduce(lambda c, b: c.when(b[0], b[1]), rest, F.when(condition, value))
    return out if otherwise is None else out.otherwise(otherwise)


def mul(a: Column, b: Column) -> Column:
    return a * b


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def div(a: Column, b: Column) -> Column:
    """Division as of real numbers; null where the divisor is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def absolute(a: Column) -> Column:
    return F.abs(a)


def product(*factors: Column) -> Column:
    return reduce(operator.mul, factors)


def touch(*columns: Column) -> Column:
    """The constant 1, whose columns are read all the same: each contributes nothing, but isn't pruned."""
    return reduce(operator.add, (F.when(c.isNull(), F.lit(0)).otherwise(F.lit(0)) for c in columns), F.lit(1))


def extract(part: str, date: Column) -> Column:
    """Day, month or (four-digit) year of a date."""
    return {"day": F.dayofmonth, "month": F.month, "year": F.year}[part.lower()](date).cast("long")


def power_loop(base: Column, n: int) -> Column:
    """base to the power n, n >= 0, by n multiplications: work of a chosen size for each row."""
    return reduce(operator.mul, [base] * n, F.lit(1.0))
