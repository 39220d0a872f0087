"""Quality rules: base rules, and a calibrated logistic regression over hashed word and character n-grams.

A document's features are the mean over its words of the hashed word and of its hashed runs of 3 and 4 characters (code
points, with marks at both ends of the word), and the mean over its pairs of neighbouring words of the hashed pair. So its
logit is a mean of one number for each word, which workers keep for recurring short words, and of one weight for each pair.

The model is trained on at most SAMPLE labelled rows: those of least hash of doc_id and text, among the documents of the
SAMPLE labelled doc_ids of least hash. Of a text of more than EXCERPT bytes, RUNS runs evenly spaced over the whole text are
read, EXCERPT bytes in all. So at most SAMPLE * EXCERPT bytes (32 MB) reach the driver. A fifth of the sample is held out to calibrate: a logistic curve from
logit to probability (Platt). Documents are scored whole, in Arrow batches, against a fixed threshold of the probability.

Defined results: a null or empty text has no words and fails; words are runs without ASCII white space; lines are cut at
newlines and count where they have a word; with no labelled rows of both kinds every probability is 1, so that the base
rules decide alone; repeated rows are judged alike, and train once; documents that share a doc_id share its label; of several labels of a doc_id the
largest counts; rows of labels without a document, or with a null quality or doc_id, are left out; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Sums, arrow_map, mix, once, word_hashes
from .language_id import windows

SAMPLE, EXCERPT, RUNS, BITS, THRESHOLD = 2000, 16 << 10, 16, 18, 0.5
DIMENSIONS = 1 << BITS
MIN_WORDS, MAX_REPEATED = 10, 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Which bytes start a code point of a word, and which are symbols.
_STARTS = ((np.arange(256) & 0xC0 != 0x80) & ~_SPACE).astype(np.int64)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of hashed features: each word itself, and the runs of 3 and 4 characters of `<word>`; a word's runs
    weigh 1 together."""
    written = [w.decode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, written), np.int64, len(words))
    raw = np.frombuffer(("<" + "><".join(written) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size + 2)
    stop = np.cumsum(size + 2)
    whose, index = [np.arange(len(words))], [_slot(word_hashes(words))]
    with np.errstate(over="ignore"):
        value = raw[:-2] | raw[1:-1] << np.uint64(21) | raw[2:] << np.uint64(42)
        for n in (3, 4):
            value = value if n == 3 else mix(value[:-1]) + raw[3:]
            at = np.flatnonzero(np.arange(len(owner)) + n <= stop[owner])
            whose.append(owner[at])
            index.append(_slot(mix(value[at] + np.uint64(n << 60))))
    whose = np.concatenate(whose)
    share = np.where(np.arange(len(whose)) < len(words), 1.0, 1 / np.maximum(1, 2 * size - 1)[whose])
    return whose, np.concatenate(index), share


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def pairs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each two neighbouring words, given by their hashes."""
    same = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        return doc[same], _slot(mix(hashes[same] * np.uint64(3) + hashes[same + 1]))


def base(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text, and of all words: words, hashes, doc."""
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    per = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[raw])))[edges])
    lines = [[x for x in t.split(b"\n") if x.strip()] if b"\n" in t else () for t in texts]
    doc = np.repeat(np.arange(len(texts)), n)
    with np.errstate(over="ignore"):
        hashes = word_hashes(flat)
        grams = Rolling(hashes).grams(5)
        same = doc[: len(grams)] == doc[4:] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(same)
        key = mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    twin = key[order][1:] == key[order][:-1]
    hit = at[order[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]] if len(at) else at
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    repeated = np.bincount(doc, np.cumsum(cover[:-1]) > 0, len(texts)).astype(np.int64)
    return {"n_words": n, "word_chars": per(_STARTS), "n_symbols": per(_SYMBOLS), "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeated, "words": flat, "hashes": hashes, "doc": doc}


class Model:
    """Weights of the hashed features, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def words(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the mean."""
        whose, index, share = features(words)
        return np.bincount(whose, self.weights[index] * share, len(words))[:, None]

    def probability(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (means + self.bias) + self.shift, -40, 40)))


def _fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows at once; both labels weigh the same, and rows of any other label nothing."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    share = (label == 1) * 0.5 / max(1, (label == 1).sum()) + (label == 0) * 0.5 / max(1, (label == 0).sum())
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights[index] * value, len(label)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g = np.append(np.bincount(index, error[rows] * value, DIMENSIONS) + decay * weights, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, bias


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The training rows: key, quality, excerpt (binary); at most so many."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("text").cast("binary").alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        few = [t if len(t) <= EXCERPT else windows(t, RUNS, EXCERPT // RUNS) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("key"), batch.column("quality"), pa.array(few, pa.binary())], ["key", "quality", "excerpt"])

    few = arrow_map(texts.join(F.broadcast(chosen), "doc_id").select("key", "quality", "text"), cut, "key long, quality int, excerpt binary")  # at most `rows` ids
    return few.groupBy("key", "quality").agg(F.min("excerpt").alias("excerpt")).orderBy("key", "quality").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled rows."""
    got = sample(docs, labels, rows).toArrow()
    order = np.lexsort((got["key"].to_numpy(),))
    label = got["quality"].to_numpy()[order]
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(DIMENSIONS), 0.0, 0.0, 40.0)
    excerpts, out = got["excerpt"].to_pylist(), []
    for start in range(0, len(order), 64):  # some documents at a time: features take far more room than texts
        b = base([excerpts[i] for i in order[start : start + 64]])
        whose, index, share = features(b["words"])
        whose, (owner, pair), n = b["doc"][whose], pairs(b["hashes"], b["doc"]), b["n_words"]
        # one entry for each document and feature
        key, where = np.unique(np.concatenate((whose, owner)) * DIMENSIONS + np.concatenate((index, pair)), return_inverse=True)
        value = np.bincount(where, np.concatenate((share / n[whose], 1 / np.maximum(1, n - 1)[owner])), len(key))
        out.append(((key // DIMENSIONS + start).astype(np.int32), (key % DIMENSIONS).astype(np.int32), value.astype(np.float32)))
    row, index, value = (np.concatenate(x) for x in zip(*out))
    row, index = row.astype(np.int64), index.astype(np.int64)  # as bincount wants them
    del out, excerpts, got
    held = np.arange(len(label)) % 5 == 0
    if len(set(label[held])) < 2 or len(set(label[~held])) < 2:
        held = np.zeros(len(label), bool)
    use = ~held[row]
    weights, bias = _fit(row[use], index[use], value[use], np.where(held, 0.5, label) if held.any() else label)
    z = np.bincount(row, weights[index] * value, len(label)) + bias
    test = held if held.any() else ~held
    slope, shift = _platt(z[test], label[test])
    return Model(weights, bias, slope, shift)


def _platt(z: np.ndarray, label: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """The logistic curve from logit to probability, fitted to smoothed labels as Platt has it."""
    positive, negative = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = max(1e-9, float(np.abs(z).max()))
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [((p - target) * x).sum(), (p - target).sum()])
        step *= min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, base_failed, quality (the probability) and kept, of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    name = f"quality {uuid.uuid4().hex}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        sums = once(name, lambda: Sums(m.words, 1))
        b = base(batch.column("text").to_pylist())
        n = b["n_words"]
        owner, pair = pairs(b["hashes"], b["doc"])
        means = np.bincount(b["doc"], sums.of(b["words"])[:, 0], len(n)) / np.maximum(1, n) + np.bincount(owner, m.weights[pair], len(n)) / np.maximum(1, n - 1)
        p = m.probability(means)
        failed = (n < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEATED * n)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(b[k]) for k in names), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *names, "base_failed", "kept", "quality"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, train(docs, labels))
