"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N - 1 in order of doc_id: a range partitioning, a place within each partition, and the partitions'
running totals. A balanced-as-can-be Feistel network permutes the least power of two of at least N; a number that leaves
the range is permuted again until it is back, so the whole is a permutation of the rows. The permuted number p gives
shard p mod S and slot p div S; so counts differ by one at most, any row's place is computed from its number, and the row at
a place is found by the inverse permutation.

Defined results: a null text has no bytes and the checksum of none; ties in doc_id are ordered by the text's checksum, its
size, and the place in the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix

ROUNDS, SEED = 8, 20_240_229


class Feistel:
    """A permutation of 0 to n - 1, and its inverse."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS) -> None:
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.n, self.low, self.high = n, bits // 2, bits - bits // 2
        with np.errstate(over="ignore"):
            self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _round(self, half: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(half + key) & np.uint64((1 << bits) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        low = np.uint64(self.low)
        a, b = x >> low, x & np.uint64((1 << self.low) - 1)
        for k in reversed(range(len(self.keys))) if back else range(len(self.keys)):
            if k % 2:
                a = a ^ self._round(b, self.keys[k], self.high)
            else:
                b = b ^ self._round(a, self.keys[k], self.low)
        return a << low | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while len(outside := np.flatnonzero(out >= self.n)):
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with a global row number in the given order, as column number; and how many there are. Rows are cut once they are in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("input", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "input").sortWithinPartitions(*order, "input")
    # the id holds the partition in its upper 31 bits and the place in it in its lower 33
    ordered = cut(placed.drop("input").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + place).drop("at", "part", "start"), ordered.count()


def shard(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    placed, n = numbered(rows, "doc_id", "text_crc32", "size")
    permutation = Feistel(n, seed)

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(permutation(number.to_numpy()))

    p = placed.withColumn("p", permuted("number"))
    return p.select("doc_id", "size", "text_crc32", "number", (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {int(shards)}").alias("slot"))


def op2_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
