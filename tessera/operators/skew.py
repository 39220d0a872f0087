"""Hot keys: finding them, and joins and aggregates that split them.

Salting here doesn't wait for AQE's thresholds. Only keys found hot are split: their rows on the large side get one of
`salts` numbers, and their rows on the other side one copy per number. Cold keys pass through once and unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """Keys with more than this share of all rows: fewer than 1 / share rows. One partial aggregate over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n") > F.col("total") * share).select(*keys, "n")


def _salt(salts: int) -> Column:
    """A number from what is at hand in the row's partition: the same row keeps it when a task runs again."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16, share: float = 0.01) -> DataFrame:
    """large.join(small, keys, how) with hot keys of large split; how: inner, left, left_semi, left_anti.

    The side that a left, semi- or anti-join keeps is `large`; it is never replicated, so no row is doubled.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"can't salt a {how} join")
    keys = list(keys)
    hot = F.broadcast(hot_keys(large, keys, share).select(*keys, F.lit(True).alias("_hot")))  # fewer than 1 / share rows
    numbered = large.withColumn("_any", _salt(salts)).join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_any")).otherwise(0)).drop("_any", "_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return numbered.join(spread, [*keys, "_salt"], how).drop("_salt")


def two_phase(df: DataFrame, groups: Sequence[str], reductions: Sequence[tuple[str, Column | str | None, str]], salts: int = 16) -> DataFrame:
    """A grouped aggregate in two shuffles: per group and salt, then per group. For sums, counts, averages, minima, maxima."""
    first, second = [], []
    for kind, column, name in reductions:
        value = F.lit(1) if column is None else F.col(column) if isinstance(column, str) else column
        if kind == "avg":
            first += [F.sum(value.cast("double")).alias(f"_{name}_s"), F.count(value).alias(f"_{name}_n")]
            second.append((F.sum(f"_{name}_s") / F.nullif(F.sum(f"_{name}_n"), F.lit(0))).alias(name))
        elif kind == "count":
            first.append(F.count(value).alias(f"_{name}"))
            second.append(F.sum(f"_{name}").alias(name))
        elif kind in ("sum", "min", "max"):
            first.append(getattr(F, kind)(value).alias(f"_{name}"))
            second.append(getattr(F, kind)(f"_{name}").alias(name))
        else:
            raise ValueError(f"{kind} can't be taken in two phases")
    return df.withColumn("_salt", _salt(salts)).groupBy(*groups, "_salt").agg(*first).groupBy(*groups).agg(*second)
