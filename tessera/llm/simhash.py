"""SimHash near-duplicates by anchor-point covering.

Two fingerprints at `threshold` 3 or fewer differing bits differ in at most one bit in one of the two 32-bit halves. In a
half, the anchors are the words of the Hamming code [31, 26], a perfect covering code of radius 1: every 31-bit string
has one anchor within distance 1, its home. If x and y differ in at most one bit there, y lies within radius plus
threshold, 1 + 1, of x's home. So each fingerprint goes to its 2 homes, and as a guest to the 1 or 16 anchors within
distance 2 in each half; homes and guests are compared per anchor. A pair counts once: the lesser is the home, and it counts
in the first half if it differs there in at most one bit, else in the second.

Equal fingerprints are one class before anything is compared, so copies cost nothing; links are kept between classes, and
no link between different texts is lost. Hot anchors, and the root of a large component, are split by AQE's skew join: both
sides of these joins are shuffled for them alone. Components come from alternating large-star and small-star contraction,
whose every round is cut by a checkpoint, or from one task where there are few links.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; with
fewer than 3 words the whole sequence is the one shingle; repeated rows are classes' members like all others; a null
doc_id is carried as null and never names a component that has another; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, apart, arrow_map, cut, keyed, mix, shuffled, signed

THRESHOLD, GOLDEN = 3, 0x9E3779B97F4A7C15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOW31 = (1 << 31) - 1
#: Edges up to which components are found by one task, in some 100 bytes an edge besides the edges.
ONE_TASK = 1_000_000
#: Row k: the positions 1 to 31 whose number has bit k; the syndrome's bit k is the parity over them.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def families(texts: list[bytes | None], size: int = 3, count: int = 1) -> list[np.ndarray]:
    """64-bit SimHash fingerprints over word shingles, repeats included, by count independent hashes of a shingle; the first is XXH64 itself."""
    hashes, counts = [], []
    for text in texts:
        words = text.lower().split() if text else []
        if len(words) >= size:
            shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]
        else:
            shingles = [b" ".join(words)] if words else []
        counts.append(len(shingles))
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)))
    n, flat = np.array(counts, np.int64), np.concatenate([*hashes, np.zeros(0, np.uint64)])
    row, all_out = np.repeat(np.arange(len(texts)) * 256, n), []
    for k in range(count):
        with np.errstate(over="ignore"):
            octets = (mix(flat + np.uint64(k * GOLDEN % (1 << 64))) if k else flat).view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(texts), np.uint64)
        for j in range(8):
            ones = np.bincount(row + octets[:, j], minlength=len(texts) * 256).reshape(len(texts), 256) @ _BITS
            more = 2 * ones > n[:, None]
            out |= (more.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * j)
        all_out.append(out)
    return all_out


def fingerprints(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """64-bit SimHash fingerprints over word shingles, repeats included."""
    return families(texts, size)[0]


def _syndrome(half: Column) -> Column:
    return sum((F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(m).cast("long"))) % 2, k) for k, m in enumerate(_CHECKS)), F.lit(0))


def _near(syndrome: int) -> list[int]:
    """Error patterns of weight at most 2 with this syndrome: what leads to each anchor within distance 2."""
    bit = lambda p: 1 << (p - 1)
    if not syndrome:
        return [0]
    return [bit(syndrome), *(bit(i) | bit(i ^ syndrome) for i in range(1, 32) if i < i ^ syndrome)]


def linked(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs x < y of the distinct 64-bit values in classes.fp that differ in 1 to threshold bits, threshold at most 3."""
    if threshold > 3:
        raise ValueError("two halves cover thresholds up to 3")
    low = F.col("fp").bitwiseAND(F.lit(_LOW31))
    high = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(_LOW31))
    half = F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("part")), F.struct(F.lit(1).alias("side"), high.alias("part")))).alias("h")
    parts = classes.select("fp", half).select("fp", "h.side", "h.part").withColumn("s", _syndrome(F.col("part")))
    home = F.when(F.col("s") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, CAST(s AS INT) - 1)"))
    patterns = F.array(*(F.array(*(F.lit(e).cast("long") for e in _near(s))) for s in range(32)))
    homes = parts.select(F.col("fp").alias("x"), "side", F.col("part").bitwiseXOR(home).alias("anchor"))
    guests = parts.select(F.col("fp").alias("y"), "side", "part", F.explode(patterns[F.col("s").cast("int")]).alias("e")).select("y", "side", F.col("part").bitwiseXOR(F.col("e")).alias("anchor"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    first = F.bit_count(apart.bitwiseAND(F.lit(_LOW31))) <= 1
    # Spark takes an exploded side for no larger than what it was made from, and would send the guests whole through the driver
    return shuffled(homes).join(guests, ["side", "anchor"]).filter((F.col("x") < F.col("y")) & (F.bit_count(apart) <= threshold) & ((F.col("side") == 0) == first)).select("x", "y")


def least_reached(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges x, y: the values that reach a lesser one, and the least that each reaches. Roots hook to lesser roots, and paths are halved to their ends."""
    values, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b, root = at[: len(x)], at[len(x) :], np.arange(len(values))
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        np.minimum.at(root, b, a)
        while (root != (up := root[root])).any():
            root = up
    lesser = root != np.arange(len(values))
    return values[lesser], values[root[lesser]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            x.append(batch.column("x").to_numpy())
            y.append(batch.column("y").to_numpy())
        fp, root = least_reached(np.concatenate(x), np.concatenate(y))
        for k in range(0, len(fp), 10_000):
            yield pa.record_batch([pa.array(fp[k : k + 10_000]), pa.array(root[k : k + 10_000])], ["fp", "root"])

    return cut(edges.coalesce(1).mapInArrow(run, "fp long, root long"))


def components(edges: DataFrame) -> DataFrame:
    """Of edges x, y: each value that reaches a lesser one with the least that it reaches, as fp, root. Alternating star contraction; ONE_TASK edges
    or fewer go to one task instead, as every stage of a round costs the driver some MB that stay until its garbage is collected."""
    edges, before = edges.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), None
    if edges.count() <= ONE_TASK:
        return _in_one_task(edges)
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").select(apart("x"), "y").join(least.select(apart("x"), "m"), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # every edge now leads from a larger value to a smaller one
        roots = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.select(apart("x"), "y").join(roots.select(apart("x"), "m"), "x").select(apart("x"), "y", "m").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").union(roots.select("x", F.col("m").alias("y")))
        edges = cut(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "fp")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, kid and th (the row key), fp, n_near, component_id."""

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), batch.column("kid"), batch.column("th"), pa.array(signed(fingerprints(batch.column("text").to_pylist())))], ["doc_id", "kid", "th", "fp"])

    rows = cut(arrow_map(keyed(docs), prints, "doc_id long, kid long, th long, fp long"))
    classes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    pairs = cut(linked(classes.select("fp"), threshold))
    both = pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    around = shuffled(both.select("x", apart("y"))).join(classes.select(F.col("fp").alias("y"), "n").select(apart("y"), "n"), "y").groupBy("x").agg(F.sum("n").alias("others")).withColumnRenamed("x", "fp")
    roots = components(pairs)
    named = classes.join(shuffled(around), "fp", "left").join(shuffled(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = shuffled(named.withColumn("root", apart("root"))).join(firsts.select(apart("root"), "component_id"), "root").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id")
    return shuffled(rows.select("doc_id", "kid", "th", apart("fp"))).join(found.select(apart("fp"), "n_near", "component_id"), "fp").select("doc_id", "kid", "th", apart("fp"), "n_near", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, size: int = 3, count: int = 1) -> DataFrame:
    """docs with one document of each component: the one of least doc_id, and of its repeated rows one; all columns stay.

    Documents are linked where the fingerprints of any one of count families are near; each family has its own chance to bring two near copies within
    the threshold, so more families catch more of them. A component's nodes are the first family's fingerprints.
    """
    names = [f"f{k}" for k in range(count)]

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = families(batch.column("text").to_pylist(), size, count)
        return pa.record_batch([batch.column("kid"), batch.column("th"), *(pa.array(signed(f)) for f in found)], ["kid", "th", *names])

    rows = cut(arrow_map(keyed(docs).select("kid", "th", "text"), prints, "kid long, th long, " + ", ".join(f"{f} long" for f in names)))
    edges = linked(rows.select(F.col("f0").alias("fp")).distinct(), threshold)
    for f in names[1:]:
        same = rows.select("f0", F.col(f).alias("fp")).distinct()
        least = cut(same.groupBy("fp").agg(F.min("f0").alias("node")))  # cut, so that each join's sides are shuffled for it alone
        stars = shuffled(same).join(least, "fp").filter("f0 != node").select(F.col("node").alias("x"), F.col("f0").alias("y"))
        pairs = linked(least.select("fp"), threshold).join(shuffled(least.select(F.col("fp").alias("x"), F.col("node").alias("a"))), "x").join(shuffled(least.select(F.col("fp").alias("y"), F.col("node").alias("b"))), "y").filter("a != b")
        edges = edges.union(stars).union(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")))
    roots = components(cut(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()))
    nodes = rows.groupBy(F.col("f0").alias("fp")).agg(F.min(F.struct("kid", "th")).alias("k"))
    best = nodes.join(shuffled(roots), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("k").alias("k")).select("k.kid", "k.th").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64("text").alias("th"))
    one = Window.partitionBy("kid", "th").orderBy(F.lit(1))  # first, as each task then sends one of its repeated rows
    return whole.withColumn("place", F.row_number().over(one)).filter("place = 1").join(shuffled(best), ["kid", "th"], "left_semi").select("doc.*")


def op10_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
