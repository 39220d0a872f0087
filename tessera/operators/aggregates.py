"""Grouped and global aggregates: SUM, COUNT, AVG, MIN, MAX. Spark combines partially before each shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: COUNT without a column counts rows, with one its values that aren't null.
REDUCTIONS = {"sum": F.sum, "count": lambda c: F.count(c), "avg": F.avg, "min": F.min, "max": F.max}
Reduction = tuple[str, Column | str | None, str]


def reduction(kind: str, column: Column | str | None, name: str) -> Column:
    if kind not in REDUCTIONS:
        raise ValueError(f"unknown reduction {kind}")
    if column is None and kind != "count":
        raise ValueError(f"{kind} needs a column")
    return REDUCTIONS[kind](F.lit(1) if column is None else column).alias(name)


def aggregate(df: DataFrame, groups: Sequence[str | Column], reductions: Sequence[Reduction]) -> DataFrame:
    """One row per group, or one row without groups (nulls and a count of 0 over no rows, as in SQL)."""
    out = [reduction(*r) for r in reductions]
    return df.groupBy(*groups).agg(*out) if groups else df.agg(*out)


def count_distinct(df: DataFrame, groups: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group as two stacked groupings, which spreads a hot group's values over all tasks first."""
    return df.select(*groups, column).distinct().groupBy(*groups).agg(F.count(column).alias(name))
