"""One session for all tests, and the comparison of a result with SQL over the same tables."""

from __future__ import annotations

import datetime
import os
import sys
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def cell(value) -> str:
    """A value as text, alike for both engines: numbers by value, points in time as such, missing values as null."""
    if isinstance(value, (str, bytes)):
        return str(value)
    if pd.isna(value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)):
        return str(int(value)) if float(value).is_integer() and abs(value) < 1e15 else f"{float(value):.9g}"
    return str(pd.Timestamp(value)) if isinstance(value, (datetime.date, pd.Timestamp)) else str(value)


def rows(frame):
    """A pandas frame as a sorted list of tuples of texts, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def sql(text: str, folder: str = DATA):
    """The result of SQL in DuckDB, as a pandas frame."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.execute(text).df()


@pytest.fixture
def against():
    """Checks a query's result against SQL: columns, number of rows, values."""

    def check(spark, query, text, folder=DATA):
        got, expected = query(spark, folder).toPandas(), sql(text, folder)
        assert sorted(got.columns) == sorted(expected.columns)
        assert len(got) == len(expected)
        assert rows(got) == rows(expected)

    return check
