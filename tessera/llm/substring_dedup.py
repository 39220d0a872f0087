"""Substring dedup by relative Lempel-Ziv factors.

The reference is the whole corpus, indexed by anchors in blocks, the shuffle's partitions: each window of `window` words has one of its
`seed`-word runs as anchor, chosen by the window's words alone (a mod-minimiser), so every copy of a window finds the same
anchor in the same block. A block keeps of each anchor its number of places, the least of them as reference, and whether the
surroundings at all places are alike. Every document is held against every block that has one of its anchors elsewhere:

* where the surroundings are alike, all windows on that anchor repeat, at the reference too;
* where they differ, a factor begins or ends: each window there is checked by its own hash, which has a least place as reference.

A document is then parsed from left to right: from a window found elsewhere, a factor goes on for as long as the next window
is found and has its reference on the same diagonal, so a factor is a longest match with that reference. Factors have
`window` words at least; their words are the duplicate spans. A factor is (start, length, reference text, reference start); factors that
follow each other overlap where windows span two of them. Only one reference is kept of each anchor and window, so a
passage whose parts came first in different texts is parsed into several factors; which words are duplicate doesn't depend on it.

So every window of the corpus is decided, by its anchor and 96 bits of hash. Texts that are equal as a whole repeat in every
window; one row of each text is parsed, and the others meet its result in a join that AQE can split. All counts are partial
aggregates; no group of places is gathered, and a hot anchor is split by AQE's skew join.

Defined results: a null or empty text has no words and keeps the empty string; documents of fewer than `window` words
keep everything; repeated rows count as other places of each other, so both lose their windows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, apart, arrow_map, lists, mix, signed, word_hashes

#: Words of a window, of an anchor, and at least of the runs whose hashes choose the anchor.
WINDOW, SEED, LEAST = 35, 20, 4
#: A place is one integer: the upper bits of its text's hash, and the number of words before it in ROOM bits.
ROOM = 24


class Parsed:
    """The words of some documents on one axis, and the anchor of each window."""

    def __init__(self, texts: list[bytes | None], window: int, seed: int) -> None:
        self.window, self.words = window, [w.split() if w else [] for w in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.stops = np.cumsum(self.counts)
        self.starts = self.stops - self.counts
        flat = [w for ws in self.words for w in ws]
        self.n, self.values = len(flat), word_hashes(flat)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.roll = Rolling(self.values)
        self.grams = self.roll.grams(seed)
        # mod-minimiser: the place of the least short run in the window, modulo the number of places a seed can have
        choices = window - seed + 1
        short = LEAST + (seed - LEAST) % choices
        least, span = self.roll.grams(short), window - short + 1
        at, width = np.arange(len(least)), 1
        while width < span:  # least hash, then leftmost, of spans that double
            step = min(width, span - width)
            take = least[step:] < least[: len(least) - step]
            at, least = np.where(take, at[step:], at[: len(at) - step]), np.where(take, least[step:], least[: len(least) - step])
            width += step
        begin = np.arange(max(0, self.n - window + 1))
        self.begin = begin[begin + window <= self.stops[self.doc[: len(begin)]]] if len(begin) else begin
        self.anchor = self.begin + (at[self.begin] - self.begin) % choices


def _context(p: Parsed, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hashes of all the words that windows on an anchor can hold, and of where the document ends."""
    doc = p.doc[at]
    a, b = np.maximum(at - (window - seed), p.starts[doc]), np.minimum(at + window, p.stops[doc])
    with np.errstate(over="ignore"):
        return mix(p.roll.range(a, b) + ((at - a) * 4096 + (b - at)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _places(th: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (th >> ROOM << ROOM) | (at & (1 << ROOM) - 1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"), F.col("text").cast("binary").alias("text"))


def _parsed(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Of each different text, named by its 64-bit hash th and its size: n_words, n_removed, kept, kept_sha256, and its factors as lists start, length, place."""
    # one row of each text, the first that a task and then the shuffle has: a hot text is no hot key, and texts are shuffled once
    one = Window.partitionBy("th", "size").orderBy(F.lit(1))
    base = _rows(docs).select("th", "size", "text").withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n")

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Parsed(batch.column("text").to_pylist(), window, seed)
        at = np.unique(p.anchor)
        doc = p.doc[at]
        col = lambda c: batch.column(c).to_numpy()[doc]
        return pa.record_batch([pa.array(signed(p.grams[at] ^ np.uint64(1))), pa.array(col("th")), pa.array(col("size")), pa.array((at - p.starts[doc]).astype(np.int32))], ["anchor", "th", "size", "at"])

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Parsed(batch.column("text").to_pylist(), window, seed)
        at = np.unique(p.anchor)
        return pa.record_batch([pa.array(signed(p.grams[at])), pa.array(signed(_context(p, at, window, seed))), pa.array(_places(batch.column("th").to_numpy()[p.doc[at]], at - p.starts[p.doc[at]]))], ["anchor", "context", "place"])

    index = (
        arrow_map(base.select("th", "text"), contexts, "anchor long, context long, place long")
        .groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"), F.min("place").alias("place"))
        .filter("n > 1").select(apart("anchor"), (F.col("low") == F.col("high")).alias("inner"), "place")
    )
    hit = F.struct("at", "place")
    found = (
        arrow_map(base, places, "anchor long, th long, size int, at int")
        .join(index, "anchor").select("th", "size", "at", "inner", "place")
        .repartition("th", "size")  # lists of one place each would only make larger rows before the shuffle
        .groupBy("th", "size").agg(F.collect_list(F.when(F.col("inner"), hit)).alias("inner"), F.collect_list(F.when(~F.col("inner"), F.col("at"))).alias("edge"))
    )
    parsed = base.join(found, ["th", "size"], "left")

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Parsed(batch.column("text").to_pylist(), window, seed)
        mark = np.zeros(p.n + 1, bool)
        mark[_flat(batch.column("edge"), batch.column("edge").flatten(), p)] = True
        begin = p.begin[mark[p.anchor]]
        doc = p.doc[begin]
        col = lambda c: batch.column(c).to_numpy()[doc]
        other = Rolling(mix(p.values ^ np.uint64(0xA5A5F00DBEEF1234)), 0xC2B2AE3D27D4EB4F)
        names = ["th", "size", "at", "h1", "h2"]
        return pa.record_batch([pa.array(col("th")), pa.array(col("size")), pa.array((begin - p.starts[doc]).astype(np.int32)), pa.array(signed(p.roll.range(begin, begin + window))), pa.array((signed(other.range(begin, begin + window)) >> 32).astype(np.int32))], names)

    # inner goes along, so that what leads here is the same plan as in cut_out's input, and runs once
    checked = arrow_map(parsed.filter(F.size("edge") > 0).select("th", "size", "text", "inner", "edge"), edges, "th long, size int, at int, h1 long, h2 int")
    own = F.shiftleft(F.shiftright("th", ROOM), ROOM).bitwiseOR(F.col("at").cast("long").bitwiseAND(F.lit((1 << ROOM) - 1)))
    repeats = checked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("place")).filter("n > 1").select(apart("h1"), "h2", "place")
    hits = checked.withColumn("h1", apart("h1")).join(repeats, ["h1", "h2"]).select("th", "size", "at", "place").repartition("th", "size").groupBy("th", "size").agg(F.collect_list(hit).alias("hits"))

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = Parsed(batch.column("text").to_pylist(), window, seed)
        held, diagonal = np.zeros(p.n + 1, bool), np.zeros(p.n + 1, np.int64)

        def mark(name: str) -> np.ndarray:
            flat = batch.column(name).flatten()
            at = _flat(batch.column(name), flat.field("at"), p)
            diagonal[at] = flat.field("place").to_numpy(zero_copy_only=False) - flat.field("at").to_numpy(zero_copy_only=False)
            return at

        held[mark("inner")] = True
        inside = held[p.anchor]
        begin, d = p.begin[inside], diagonal[p.anchor[inside]]
        at = mark("hits")
        begin, d = np.concatenate((begin, at)), np.concatenate((d, diagonal[at]))
        order = np.argsort(begin, kind="stable")
        begin, d = begin[order], d[order]
        # a factor goes on while the next window is found on its diagonal
        first = np.flatnonzero(np.concatenate(([True], (np.diff(begin) != 1) | (np.diff(d) != 0)))[: len(begin)])
        length = begin[np.append(first[1:], len(begin)) - 1] - begin[first] + window if len(first) else first
        start = begin[first]
        steps = np.bincount(start, minlength=p.n + 1) - np.bincount(start + length, minlength=p.n + 1)
        gone = np.cumsum(steps[:-1]) > 0
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[p.stops] - sums[p.starts]
        kept = []
        for words, k, a, b in zip(p.words, removed.tolist(), p.starts.tolist(), p.stops.tolist()):
            kept.append(b" ".join([w for w, x in zip(words, gone[a:b].tolist()) if not x] if k else words))
        doc = p.doc[start]
        count, inset = np.bincount(doc, minlength=batch.num_rows), start - p.starts[doc]
        return pa.record_batch(
            [batch.column("th"), batch.column("size"), pa.array(p.counts), pa.array(removed), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), lists(inset, count, pa.int32()), lists(length, count, pa.int32()), lists(d[first] + inset, count, pa.int64())],
            ["th", "size", "n_words", "n_removed", "kept", "kept_sha256", "start", "length", "place"],
        )

    return arrow_map(parsed.join(hits, ["th", "size"], "left").select("th", "size", "text", "inner", "hits"), cut_out, "th long, size int, n_words long, n_removed long, kept binary, kept_sha256 string, start array<int>, length array<int>, place array<long>")


def _flat(lists: pa.ListArray, at: pa.Array, p: Parsed) -> np.ndarray:
    """Positions within documents, the lists' flat values, as positions on the axis of all words of the batch."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return at.to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(p.starts, counts)


def factors(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The factors of each different text: th, size (its hash and its bytes), start, length, ref and ref_start: `length` words from `start` on are those of the text whose
    hash has the upper bits ref (th >> ROOM) from its word ref_start on, modulo 2**ROOM. Of a text's own first places the reference is itself. A copy of a whole text is one
    factor, not listed: of each text only one row is parsed."""
    each = _parsed(docs, window, seed).select("th", "size", F.explode(F.arrays_zip("start", "length", "place")).alias("f"))
    return each.select("th", "size", "f.start", "f.length", F.shiftright("f.place", ROOM).alias("ref"), F.col("f.place").bitwiseAND(F.lit((1 << ROOM) - 1)).cast("int").alias("ref_start"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs without the words of repeated windows: doc_id, n_words, n_removed, kept (binary: kept words joined by spaces), kept_sha256."""
    rows = _rows(docs)
    copies = rows.groupBy("th", "size").agg((F.count(F.lit(1)) > 1).alias("copied"))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("copied") & (F.col("n_words") >= window)
    info = _parsed(docs, window, seed).join(copies, ["th", "size"]).select(
        apart("th"), "size", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(whole, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256")
    )
    # both sides are shuffled for this join alone: AQE splits a hot text's rows
    return rows.select("doc_id", apart("th"), "size").join(info, ["th", "size"]).select("doc_id", "n_words", "n_removed", "kept", "kept_sha256")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_spans(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = {
    "op8_substring_dedup": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
), y AS (
  SELECT r, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, i + j AS k FROM y, unnest(range(0, 35)) AS t(j)
), words AS (
  SELECT r, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(k)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS s, count(*) AS n FROM words ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
""",
}
