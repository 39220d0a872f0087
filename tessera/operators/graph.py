"""Joins of one relation with itself along shared variables: extension, closing, and multiway joins.

Edges are rows of (src, dst). A worst-case-optimal engine would intersect adjacency lists row by row; here the smaller
adjacency extends, by an equi-join, and the others close by semi-joins, so intermediate rows never exceed the extension.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exists(child: DataFrame, edges: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """Rows of child for which an edge (other -> base) exists for each of the other vertex columns."""
    for other in others:
        e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        child = child.join(e, (F.col(other) == F.col("_s")) & (F.col(base) == F.col("_d")), "left_semi")
    return child


def extend(child: DataFrame, edges: DataFrame, sources: Sequence[str], name: str) -> DataFrame:
    """child with a column name: every vertex that has an edge from all the source columns.

    For each row the source of least out-degree extends and the others close. Rows are split by which source that is,
    so each row is extended once.
    """
    if len(sources) == 1:
        e = edges.select(F.col("src").alias("_s"), F.col("dst").alias(name)).distinct()
        return child.join(e, F.col(sources[0]) == F.col("_s")).drop("_s")
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    sized = child
    for k, s in enumerate(sources):
        sized = sized.join(degree.select(F.col("src").alias("_s"), F.col("_n").alias(f"_n{k}")), F.col(s) == F.col("_s"), "inner").drop("_s")
    least = F.least(*(F.col(f"_n{k}") for k in range(len(sources))))
    choice = reduce(lambda c, k: c.when(F.col(f"_n{k}") == least, F.lit(k)), range(1, len(sources)), F.when(F.col("_n0") == least, F.lit(0)))
    sized = sized.withColumn("_k", choice).drop(*(f"_n{k}" for k in range(len(sources))))
    first = reduce(lambda c, k: c.when(F.col("_k") == k, F.col(sources[k])), range(1, len(sources)), F.when(F.col("_k") == 0, F.col(sources[0])))
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias(name))
    grown = sized.withColumn("_from", first).join(e, F.col("_from") == F.col("_s")).drop("_s", "_from", "_k")
    return exists(grown, edges, name, sources)


def variable(name: str, *relations: tuple[DataFrame, str]) -> DataFrame:
    """The values of one variable that all the relations have in the named column, each value once."""
    sets = [df.select(F.col(c).alias(name)).distinct() for df, c in relations]
    return reduce(lambda a, b: a.join(b, name, "left_semi"), sets)


def intersection(child: DataFrame, name: str, relations: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """child with a column name: the values that every relation has under the child's values of its bound columns.

    Each relation is (rows, bound, column); bound columns have the same names in child and rows.
    """
    (rows, bound, column), *rest = sorted(relations, key=lambda r: not r[1])  # a bound one extends, so no row meets all values
    if not bound:
        raise ValueError("no relation is bound to the child's columns; variable() gives the values that relations share")
    out = child.join(rows.select(*bound, F.col(column).alias(name)).distinct(), list(bound), "inner")
    for rows, bound, column in rest:
        out = out.join(rows.select(*bound, F.col(column).alias(name)).distinct(), [*bound, name], "left_semi")
    return out


def multiway(relations: Sequence[DataFrame]) -> DataFrame:
    """The natural join of several relations, each joined on the columns it shares with those before; the order is that given."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns]
        if not shared:
            raise ValueError("a relation shares no column with those before it")
        return a.join(b, shared, "inner")

    return reduce(join, relations)


def triangles(edges: DataFrame) -> DataFrame:
    """All a -> b -> c with a -> c."""
    e = edges.select("src", "dst").distinct()
    return extend(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e, ["a", "b"], "c")
