"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# the pipeline lies at the top of the repository and goes with this folder
import corpus_pipeline

from . import bpe, chat, decontaminate, language_id, line_dedup, quality, sharding, simhash, substring_dedup, token_files

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once for each application: they may have neither its folder nor its path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = str(Path(__file__).resolve().parents[2])
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(os.path.join(root, "tessera")):
                for name in files:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.relpath(whole, root))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (bpe, sharding, decontaminate, chat, quality, line_dedup, token_files, substring_dedup, language_id, simhash):
    QUERIES |= {k: _shipping(f) for k, f in vars(_module).items() if k.startswith("op") and k[2:3].isdigit()}
    SQL |= getattr(_module, "SQL", {})
QUERIES["pipeline"] = _shipping(corpus_pipeline.run)
