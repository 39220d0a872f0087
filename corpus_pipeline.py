"""A corpus from raw documents to token ids in five stages, each an operator of tessera.llm.

Defined results: a null text, or one without a letter, is rejected for its language; where no row has a language to learn from, all rows with a letter
stay; rows that agree in doc_id and text are one document for the line stage, and one of them stays as near duplicates; null doc_ids come before all others;
texts of any length are taken whole; ties in doc_id go by the text's hash; an empty table gives no rows, an empty benchmark rejects none; other columns, whatever
their names, go along unchanged up to the last stage (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, language_id, line_dedup, simhash
from tessera.llm.common import shared_dir

#: Documents whose language's share is below this are rejected, like those of no language.
LEAST_SCORE = 0.6
#: Words of a shingle, and families of fingerprints, of the near-duplicate stage.
SHINGLE, FAMILIES = 2, 4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letter, or no language with a share of LEAST_SCORE)."""
    return language_id.keep_known(docs, language_id.train(docs), LEAST_SCORE)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates but the first."""
    return line_dedup.drop_recurring(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, by any of FAMILIES fingerprints."""
    return simhash.keep_one(docs, size=SHINGLE, count=FAMILIES)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, and decodes the ids: doc_id, lang, source, n_tokens, ids, decoded_crc32."""
    return bpe.encode_columns(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", without_recurring_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("benchmark", without_benchmark),
    ("tokens", token_ids),
]

#: A recurrent network's verdict can't be written in SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each but the last is written to the shared folder and read again. What a stage has
    read is deleted once its result is written; the last stage's input stays, as the result is read from it."""
    out, last = f"{shared_dir(spark)}/pipeline-{uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{out}/{k}-{name}")
            docs = spark.read.parquet(f"{out}/{k}-{name}")
            if last:
                _delete(spark, last)
            last = f"{out}/{k}-{name}"
    return docs
