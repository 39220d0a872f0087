"""Joins. The right side is kept by semi-, anti- and outer joins, and probes; the left side is matched against.

No side is broadcast by hint: Spark does so by the size it knows or measures, under its own threshold, and splits hot
partitions of shuffled joins (AQE). salted joins for hot keys are in skew.py.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Relationship

Pairs = Sequence[tuple[str, str]]


def condition(equal: Pairs, other: Column | None = None) -> Column:
    """Equality of each pair of columns, and another condition if given."""
    parts = [F.col(a) == F.col(b) for a, b in equal]
    return reduce(operator.and_, parts if other is None else [*parts, other])


def inner(left: DataFrame, right: DataFrame, equal: Pairs, other: Column | None = None) -> DataFrame:
    """All matches of both sides."""
    return right.join(left, condition(equal, other), "inner")


def unique(left: DataFrame, right: DataFrame, equal: Pairs, order: Sequence[str] = ()) -> DataFrame:
    """At most one match for each right row: of left rows with the same key the first in order (then of all columns)."""
    keys = [a for a, _ in equal]
    if order:
        first = Window.partitionBy(*keys).orderBy(*order, *left.columns)
        one = left.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    else:  # a partial aggregate before the shuffle, however many rows a key has
        rest = [c for c in left.columns if c not in {k.split(".")[-1] for k in keys}]
        one = left.groupBy(*keys).agg(F.min(F.struct(*(F.col(c) for c in rest))).alias("_row")) if rest else left.select(*keys).distinct()
        one = one.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)) if rest else one
    return right.join(one, condition([(a.split(".")[-1], b) for a, b in equal]), "inner")


def semi(left: DataFrame, right: DataFrame, equal: Pairs, other: Column | None = None) -> DataFrame:
    """Right rows with a match on the left, once each."""
    return right.join(left, condition(equal, other), "left_semi")


def anti(left: DataFrame, right: DataFrame, equal: Pairs, other: Column | None = None) -> DataFrame:
    """Right rows without a match on the left; a null key matches nothing (NOT EXISTS)."""
    return right.join(left, condition(equal, other), "left_anti")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """SQL's NOT IN: with a null on the left no right row remains; a null on the right goes unless the left is empty."""
    key = F.col(left_key)
    state = left.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(key.isNull(), 1)).alias("_nulls"))
    out = with_scalar(right.join(left.filter(key.isNotNull()), key == F.col(right_key), "left_anti"), state)
    return out.filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(right_key).isNotNull())).drop("_n", "_nulls")


def outer(left: DataFrame, right: DataFrame, equal: Pairs, other: Column | None = None) -> DataFrame:
    """All right rows, with nulls for the left columns where nothing matches."""
    return right.join(left, condition(equal, other), "left")


def theta(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """All pairs that satisfy a condition. One with an equality in it is planned as an equi-join; any other one compares
    all pairs, which is for sides of a few rows or one row (a scalar)."""
    return left.join(right, where, "inner")


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a result of exactly one row (an aggregate without groups), which bounds what is sent."""
    return df.crossJoin(F.broadcast(one_row))


def along(child: DataFrame, target: DataFrame, relationship: Relationship, child_alias: str = "", alias: str = "") -> DataFrame:
    """Follows a declared relationship: one row for each match, by one or several key columns."""
    a, b = (f"{x}." if x else "" for x in (child_alias, alias))
    target = target.alias(alias) if alias else target
    return child.join(target, condition([(a + s, b + k) for s, k in zip(relationship.source, relationship.keys)]), "inner")
