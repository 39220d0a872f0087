"""Buckets grow in number with the tables, not in size."""

from conftest import DATA

from tessera.plans import registry
from tessera.sources import catalog


def test_rows_of_a_bucket(spark, monkeypatch, against):
    monkeypatch.setattr(catalog, "BUCKET_ROWS", 500, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.QUERIES["bucketed_join"](spark, DATA)
        tasks, files = found.rdd.getNumPartitions(), found.inputFiles()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        against(spark, registry.QUERIES["bucketed_join"], registry.SQL["bucketed_join"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert tasks == -(-catalog.scan(spark, DATA, "lineitem").count() // 500) > 8
    assert len(files) <= 2 * tasks
