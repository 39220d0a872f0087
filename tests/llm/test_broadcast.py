"""Nothing that grows by an explode is sent whole through the driver, however small Spark takes it for."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash


@pytest.fixture
def by_size(spark):
    """Spark's own threshold; the fingerprints below have a thirtieth of it, their guests at anchors several times it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "10m")
    yield
    spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def test_guests_are_not_broadcast(spark, by_size):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").bitwiseXOR(F.when(F.col("id") % 10 == 0, F.lit(1 << 40 | 5)).otherwise(F.lit(0)).cast("long")).alias("near"))
    pairs = simhash.linked(rows.select("fp").union(rows.select("near")).distinct())
    assert len(pairs.collect()) == 2_000
    plan = pairs._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
