"""A fluent relational builder over DataFrames: every step is lazy, and the plan is Catalyst's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import catalog
from . import aggregates, graph, joins


class Rel:
    """A relation. Join methods are called on the side that probes; the argument is the side matched against."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def scan(cls, spark: SparkSession, folder: str, name: str, alias: str | None = None) -> Rel:
        return cls(catalog.scan(spark, folder, name, alias))

    @classmethod
    def temp(cls, spark: SparkSession, name: str, alias: str | None = None) -> Rel:
        """Scans a temporary table."""
        return cls(spark.table(name).alias(alias or name))

    def alias(self, name: str) -> Rel:
        return Rel(self.df.alias(name))

    def project(self, *columns: str | Column) -> Rel:
        """Keeps some columns, and duplicates of rows."""
        return Rel(self.df.select(*columns))

    def map(self, name: str, value: Column) -> Rel:
        return Rel(self.df.withColumn(name, value))

    def multimap(self, values: dict[str, Column]) -> Rel:
        """Adds several columns; each sees the input alone."""
        return Rel(self.df.withColumns(values))

    def where(self, condition: Column) -> Rel:
        return Rel(self.df.filter(condition))

    def join(self, other: Rel, equal: joins.Pairs, residual: Column | None = None) -> Rel:
        return Rel(joins.inner(other.df, self.df, equal, residual))

    def unique_join(self, other: Rel, equal: joins.Pairs, order: Sequence[str] = ()) -> Rel:
        return Rel(joins.unique(other.df, self.df, equal, order))

    def semi(self, other: Rel, equal: joins.Pairs, residual: Column | None = None) -> Rel:
        return Rel(joins.semi(other.df, self.df, equal, residual))

    def anti(self, other: Rel, equal: joins.Pairs, residual: Column | None = None) -> Rel:
        return Rel(joins.anti(other.df, self.df, equal, residual))

    def outer(self, other: Rel, equal: joins.Pairs, residual: Column | None = None) -> Rel:
        return Rel(joins.outer(other.df, self.df, equal, residual))

    def theta(self, other: Rel, condition: Column) -> Rel:
        return Rel(joins.theta(other.df, self.df, condition))

    def with_scalar(self, one_row: Rel) -> Rel:
        return Rel(joins.with_scalar(self.df, one_row.df))

    def along(self, relationship: catalog.Relationship, target: Rel, child_alias: str = "", alias: str = "") -> Rel:
        return Rel(joins.along(self.df, target.df, relationship, child_alias, alias))

    def aggregate(self, groups: Sequence[str | Column], reductions: Sequence[aggregates.Reduction]) -> Rel:
        return Rel(aggregates.aggregate(self.df, groups, reductions))

    def exists(self, edges: Rel, base: str, others: Sequence[str]) -> Rel:
        return Rel(graph.exists(self.df, edges.df, base, others))

    def extend(self, edges: Rel, sources: Sequence[str], name: str) -> Rel:
        return Rel(graph.extend(self.df, edges.df, sources, name))

    def create_temp(self, name: str, keep: bool = False) -> Rel:
        """Names the relation for later scans; keep: its rows are computed once and cached."""
        df = self.df.cache() if keep else self.df
        df.createOrReplaceTempView(name)
        return Rel(df)

    def show(self, n: int = 5) -> None:
        """Prints the number of rows and the first few."""
        print(self.df.count())
        self.df.show(n, truncate=False)

    def result(self) -> DataFrame:
        return self.df
