"""Benchmark decontamination by greedy string tiling.

The benchmark is a stated query set: it is read in blocks of at most BLOCK_BYTES of text (or one item), and every block is held against
all documents. The driver and the workers hold one block at a time: with more than one, what a block gives is written before the next is sent. A document and an item are compared where they share a seed, a run of MIN_MATCH tokens; seeds are found by
Karp-Rabin hashes in one pass over the document. Then tiles are marked as in greedy string tiling: again and again the
longest matches of unmarked tokens, found by running Karp-Rabin, each token once, until none of MIN_MATCH tokens is left. An item's coverage is the
share of its tokens under tiles, in whatever order the document has them; a document is contaminated from COVERAGE of an item
on. Items of fewer than MIN_MATCH tokens count as one seed of their own length.

Tokens are runs without ASCII white space or ASCII punctuation, in lower case. Candidate seeds that a long document repeats
are all kept, so matches are complete.

Defined results: a null or empty text, or one without tokens, is not contaminated (coverage 0, no item); items without
tokens match nothing; ties in coverage go to the least item_id; a null item_id sorts first; repeated rows are judged alike;
an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Rolling, apart, arrow_map, cut, word_hashes

MIN_MATCH, COVERAGE, BLOCK_BYTES = 5, 0.5, 8 << 20
_MARKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_BITS = 22


def tokens(text: str | bytes | None) -> list[bytes]:
    """Lower-case tokens; every ASCII character that is no letter or digit separates."""
    if not text:
        return []
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return text.lower().encode().translate(_MARKS).split()


def tile(pattern: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin, of tokens given by their hashes: (place in pattern, place in text, length)
    of each tile, longest first, and of one length in order of both places.

    The longest length that unmarked runs of both have in common is searched by halving, each time by the rolling hashes of
    all unmarked runs of one length; its matches are marked, and shorter ones follow.
    """
    rolls, tiles = (Rolling(pattern), Rolling(text)), []
    used = (np.zeros(len(pattern), bool), np.zeros(len(text), bool))

    def runs(side: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked runs of length k."""
        sums = np.concatenate(([0], np.cumsum(used[side])))
        at = np.flatnonzero(sums[k:] == sums[: len(sums) - k])
        return at, rolls[side].grams(k)[at]

    def shared(k: int) -> bool:
        return bool(np.isin(runs(0, k)[1], runs(1, k)[1]).any())

    most = min(len(pattern), len(text))
    while most >= least and shared(least):
        low = least
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if shared(middle) else (low, middle - 1)
        (p, hp), (t, ht) = runs(0, low), runs(1, low)
        places: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(t[np.isin(ht, hp)].tolist(), ht[np.isin(ht, hp)].tolist()):
            places[h].append(j)
        for i, h in zip(p.tolist(), hp.tolist()):
            for j in places.get(h, ()):
                if used[0][i : i + low].any():
                    break
                if not used[1][j : j + low].any() and (pattern[i : i + low] == text[j : j + low]).all():
                    used[0][i : i + low] = used[1][j : j + low] = True
                    tiles.append((i, j, low))
        most = low - 1
    return tiles


class Block:
    """Some benchmark items, indexed by the hashes of their seeds."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = MIN_MATCH) -> None:
        self.least, self.ids, self.items = least, [], []
        keys, owners = [], []
        for item, text in items:
            own = tokens(text)
            if own:
                size = min(least, len(own))
                values = word_hashes(own)
                grams = np.unique(Rolling(values).grams(size)) ^ np.uint64(size * 0x9E37)
                keys.append(grams)
                owners.append(np.full(len(grams), len(self.ids)))
                self.ids.append(item)
                self.items.append(values)
        key, owner = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (keys, owners))
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key.astype(np.uint64)[order], owner.astype(np.int64)[order]
        self.sizes = sorted({min(least, len(x)) for x in self.items})
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.key >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, texts: list[bytes | str | None]) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item, its tokens, tokens under tiles, longest tile) of every text and item that share a seed."""
        words = [tokens(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        values = word_hashes([w for ws in words for w in ws])
        roll = Rolling(values)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size in self.sizes:
            grams = roll.grams(size) ^ np.uint64(size * 0x9E37)
            at = np.flatnonzero(self.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[at + size <= stops[doc[at]]]
            low, high = np.searchsorted(self.key, grams[at], "left"), np.searchsorted(self.key, grams[at], "right")
            for place, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for owner in self.owner[a:b].tolist():
                    places[int(doc[place]), owner].add(place)
        out = []
        for (row, owner), found in sorted(places.items()):
            own, size = self.items[owner], min(self.least, len(self.items[owner]))
            # every match lies under seeds, so those runs of the text are enough; a value of no token keeps them apart
            under = np.unique(np.array(sorted(found))[:, None] + np.arange(size))
            gaps = np.flatnonzero(np.diff(under) > 1) + 1
            tiles = tile(own, np.insert(values[under], gaps, np.arange(1, len(gaps) + 1, dtype=np.uint64)), size)
            if tiles:
                out.append((row, self.ids[owner], len(own), sum(k for _, _, k in tiles), tiles[0][2]))
        return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES, least: int = MIN_MATCH) -> Iterator[Block]:
    """The benchmark in blocks of at most limit bytes (or one item)."""
    own, size = [], 0
    for row in benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        length = len(row["text"].encode())
        if own and size + length > limit:
            yield Block(own, least)
            own, size = [], 0
        own.append((row["item_id"], row["text"]))
        size += length
    if own:
        yield Block(own, least)


def _against_all(docs: DataFrame, benchmark: DataFrame, against: Callable[[Broadcast], DataFrame]) -> list[DataFrame]:
    """What against gives for each block in turn (for an empty one, if there is none); of several, each is cut before the next is sent."""
    rest, out = blocks(benchmark), []
    block = next(rest, None) or Block([])
    while block:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size
        found, block = against(shared), next(rest, None)
        if out or block:
            found = cut(found)
            shared.destroy()
        out.append(found)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of docs: doc_id, th (hash of the text), n_items (items that it shares a seed with), item_id, item_tokens, covered,
    longest (of the item with the largest coverage), coverage, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))

    def against(block: Broadcast) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            best: dict[int, tuple] = {}
            n = defaultdict(int)
            for row, item, size, covered, longest in block.value.find(batch.column("text").to_pylist()):
                n[row] += 1
                if row not in best or covered * best[row][1] > best[row][2] * size:
                    best[row] = (item, size, covered, longest)
            got = [best.get(i, (None, 0, 0, 0)) for i in range(batch.num_rows)]
            return pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array([n[i] for i in range(batch.num_rows)], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*got))], ["doc_id", "th", "n_items", "item_id", "item_tokens", "covered", "longest"])

        return arrow_map(rows, run, "doc_id long, th long, n_items long, item_id long, item_tokens long, covered long, longest long")

    found, *more = _against_all(docs, benchmark, against)
    share = F.when(F.col("item_tokens") > 0, F.col("covered") / F.col("item_tokens")).otherwise(F.lit(0.0))
    if more:  # every row comes once for each block; rows that agree in doc_id and text have one place each
        for one in more:
            found = found.union(one)
        best = F.max_by(F.struct("item_id", "item_tokens", "covered", "longest"), F.struct(share, -F.coalesce("item_id", F.lit(-(2**62)))))
        each = found.groupBy("doc_id", "th").agg((F.count(F.lit(1)) / (1 + len(more))).cast("int").alias("copies"), F.sum("n_items").alias("n"), best.alias("b"))
        found = each.select("doc_id", "th", (F.col("n") / F.col("copies")).cast("long").alias("n_items"), "b.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return found.withColumn("coverage", share).withColumn("contaminated", share >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without contaminated documents; all columns stay. One block: a filter in one scan. More: the keys of contaminated documents, one
    scan for each block, and an anti-join with them."""
    name = next(c for c in docs.columns if c.lower() == "text")
    rest = blocks(benchmark)
    first, second = next(rest, None), next(rest, None)
    if first is None:
        return docs
    if second is not None:
        bad = overlaps(docs, benchmark, coverage).filter("contaminated").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("kid"), "th").distinct()
        whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64(name).alias("th"), F.struct(*docs.columns).alias("doc"))
        return whole.withColumn("kid", apart("kid")).join(bad.select(apart("kid"), "th"), ["kid", "th"], "left_anti").select("doc.*")
    shared = docs.sparkSession.sparkContext.broadcast(first)  # of bounded size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bad = {row for row, _, size, covered, _ in shared.value.find(batch.column(name).to_pylist()) if covered >= coverage * size}
        return batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())) if bad else batch

    return arrow_map(docs, run, docs.schema, name)


def op3_greedy_tiling(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return overlaps(docs, benchmark).select("doc_id", "n_items", "item_id", "item_tokens", "covered", "longest", "contaminated")
