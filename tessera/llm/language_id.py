"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a whole text, forward and backward, and gives every byte a distribution over the languages. A document's
distribution is the normalised geometric mean of its positions' distributions; the prediction is its mode and the score
that language's share. Its state passes words and spaces. So that texts of any length are read at one pace, each is read
in chunks of CHUNK bytes, and either direction has its state from MARGIN bytes of the text before it comes to a chunk;
only texts of more than CHUNK bytes are cut at all. A row of bytes is filled with an outside symbol to a multiple of PAD, and rows of one
length are read together, ROWS at once. No result is remembered, so open vocabulary costs what recurring text costs.

Training is in numpy by backpropagation through time (Adam on the mean cross-entropy of all positions). It reads at most
TRAIN_DOCS different rows in all and PER_LANGUAGE of each language: those of least hash of doc_id, lang and text among the
rows whose crc32(doc_id as text) mod 4 is not 2. Each gives WINDOWS runs of LENGTH bytes, evenly spaced over the whole
text. That is all that reaches the driver: with four languages 1200 rows, 1.2 MB. A prediction sees the text alone.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts first;
rows with a null lang, doc_id or text, or an empty text, don't train; rows that agree in doc_id, lang and text train as one; rows that share a
doc_id only train each with its own lang; without any training row everything is `und`; repeated rows are predicted alike;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

UNKNOWN, OUTSIDE = "und", 256
HIDDEN, EMBED = 12, 12
CHUNK, MARGIN, PAD, ROWS = 384, 64, 32, 1024
PER_LANGUAGE, TRAIN_DOCS, WINDOWS, LENGTH, STEPS, BATCH = 300, 20_000, 16, 64, 400, 192
#: A letter of any script.
_LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Two gated recurrent layers side by side, one for each direction, and a softmax at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 5) -> None:
        self.languages, self.hidden = languages, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": (rng.standard_normal((OUTSIDE + 1, embed)) * 0.5).astype(np.float32), "out": draw(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": draw(embed, 3 * hidden), f"{d}h": draw(hidden, 3 * hidden), f"{d}c": np.zeros(3 * hidden, np.float32)}

    def freeze(self) -> Network:
        """Makes each gate's table from symbol to input and its weights; gates get half of both, as their logistic is a tanh of half."""
        h = self.hidden
        self.gates = {}
        for d in "fb":
            table = self.p["embed"] @ self.p[f"{d}x"] + self.p[f"{d}c"]
            self.gates[d] = [(np.ascontiguousarray(table[:, k * h : (k + 1) * h] * s), np.ascontiguousarray(self.p[f"{d}h"][:, k * h : (k + 1) * h] * s)) for k, s in enumerate((0.5, 0.5, 1))]
        return self

    def _direction(self, d: str, columns: np.ndarray) -> np.ndarray:
        """States (column, row, unit) after each of the columns, read in order."""
        length, rows = columns.shape
        out, state = np.empty((length, rows, self.hidden), np.float32), np.zeros((rows, self.hidden), np.float32)
        (tz, wz), (tr, wr), (tn, wn) = self.gates[d]
        z, r, n, g = (np.empty_like(state) for _ in range(4))
        for t in range(length):
            at = columns[t]
            np.take(tz, at, axis=0, out=z, mode="clip")
            np.take(tr, at, axis=0, out=r, mode="clip")
            np.take(tn, at, axis=0, out=n, mode="clip")
            z += np.matmul(state, wz, out=g)
            r += np.matmul(state, wr, out=g)
            for gate in (z, r):
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            r *= np.matmul(state, wn, out=g)
            n += r
            np.tanh(n, out=n)
            np.subtract(state, n, out=g)
            g *= z
            state = np.add(g, n, out=out[t])
        return out

    def positions(self, columns: np.ndarray) -> np.ndarray:
        """Log-probabilities (language, column, row) at each symbol of rows of one length, given by columns."""
        length, rows = columns.shape
        both = (self._direction("f", columns), self._direction("b", columns[::-1])[::-1])
        h = self.hidden
        logits = sum(self.p["out"][k * h : (k + 1) * h].T @ np.ascontiguousarray(s).reshape(-1, h).T for k, s in enumerate(both)) + self.p["bias"][:, None]
        logits -= logits.max(axis=0)
        logits -= np.log(np.exp(logits).sum(axis=0))
        return logits.reshape(-1, length, rows)

    def sums(self, texts: list[bytes | None]) -> np.ndarray:
        """The sum of each text's log-probabilities over its bytes."""
        size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
        count = -(-size // CHUNK)
        text = np.repeat(np.arange(len(texts)), count)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * CHUNK
        start, stop = np.maximum(own - MARGIN, 0), np.minimum(own + CHUNK + MARGIN, size[text])
        base, padded = (np.cumsum(size) - size)[text] + start, -(-(stop - start) // PAD) * PAD
        own, end = own - start, np.minimum(own + CHUNK, size[text]) - start
        each = np.zeros((len(text), len(self.languages)))
        for length in np.unique(padded):
            alike = np.flatnonzero(padded == length)
            place = np.arange(length)[:, None]
            for some in np.array_split(alike, -(-len(alike) // ROWS)):
                columns = raw[np.minimum(place + base[some], len(raw) - 1)].astype(np.int64)
                columns[place >= (stop - start)[some]] = OUTSIDE
                inside = ((place >= own[some]) & (place < end[some])).astype(np.float32)
                each[some] = np.einsum("klr,lr->rk", self.positions(columns), inside)
        return np.stack([np.bincount(text, each[:, k], len(texts)) for k in range(len(self.languages))], axis=1)

    def step(self, rows: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions inside rows of one length, and its gradients through time."""
        h, (count, length), g = self.hidden, rows.shape, {k: np.zeros_like(v) for k, v in self.p.items()}
        embedded, inside = self.p["embed"][rows], rows != OUTSIDE
        kept, states = {}, {}
        for d in "fb":
            wx, wh, c = (self.p[f"{d}{k}"] for k in "xhc")
            inputs = embedded @ wx + c
            order = range(length) if d == "f" else range(length - 1, -1, -1)
            state, kept[d], states[d] = np.zeros((count, h), np.float32), [], np.empty((count, length, h), np.float32)
            for t in order:
                x, gates = inputs[:, t], state @ wh
                z, r = _sigmoid(x[:, :h] + gates[:, :h]), _sigmoid(x[:, h : 2 * h] + gates[:, h : 2 * h])
                new = np.tanh(x[:, 2 * h :] + r * gates[:, 2 * h :])
                kept[d].append((t, state, z, r, new, gates[:, 2 * h :]))
                state = new + z * (state - new)
                states[d][:, t] = state
        both = np.concatenate((states["f"], states["b"]), axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        positions = max(1, int(inside.sum()))
        loss = float(-(np.log(np.maximum(p[np.arange(count), :, lang], 1e-9)) * inside).sum() / positions)
        p[np.arange(count), :, lang] -= 1
        p *= inside[:, :, None] / positions
        g["out"], g["bias"] = np.tensordot(both, p, ((0, 1), (0, 1))), p.sum(axis=(0, 1))
        back = p @ self.p["out"].T
        at_embed = np.zeros_like(embedded)
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            wx, wh = self.p[f"{d}x"], self.p[f"{d}h"]
            carry, at_input = np.zeros((count, h), np.float32), np.empty((count, length, 3 * h), np.float32)
            for t, before, z, r, new, candidate in reversed(kept[d]):
                dh = part[:, t] + carry
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * candidate * r * (1 - r)
                at_input[:, t] = np.concatenate((dz, dr, dn), axis=1)
                dg = np.concatenate((dz, dr, dn * r), axis=1)
                g[f"{d}h"] += before.T @ dg
                carry = dh * z + dg @ wh.T
            g[f"{d}x"] += np.tensordot(embedded, at_input, ((0, 1), (0, 1)))
            g[f"{d}c"] += at_input.sum(axis=(0, 1))
            at_embed += at_input @ wx.T
        np.add.at(g["embed"], rows, at_embed)
        return loss, g


def windows(text: bytes, count: int = WINDOWS, length: int = LENGTH) -> bytes:
    """At most count runs of length bytes, evenly spaced over the text; they don't overlap unless the text is that short."""
    some = max(1, min(count, len(text) // length + (len(text) % length > 0)))
    starts = np.linspace(0, max(0, len(text) - length), some).astype(int).tolist()
    return b"".join(text[a : a + length] for a in starts)


def fit(rows: np.ndarray, lang: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 11) -> Network:
    """A network trained on rows of symbols (OUTSIDE after a text's end) and the number of each one's language; each language is drawn alike."""
    net, rng = Network(languages), np.random.default_rng(seed)
    groups = [np.flatnonzero(lang == k) for k in range(len(languages))]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for t in range(1, steps + 1):
        some = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(groups), batch)])
        _, g = net.step(rows[some], lang[some])
        now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            net.p[k] = (net.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net.freeze()


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The training rows: key, language, windows (binary). At most per_language rows of each language, and train_docs (or one a language) in all."""
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").filter(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 != 2)
    keyed = rows.select(F.col("lang").cast("string").alias("language"), F.xxhash64(F.col("doc_id").cast("long"), "lang", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    different = keyed.groupBy("language", "key").agg(F.count(F.lit(1)).alias("n")).drop("n")  # repeated rows meet in partial counts
    first = Window.partitionBy("language").orderBy("key")  # only the first few of each task are sent
    ranked = different.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    chosen = ranked.orderBy("n", "key", "language").limit(train_docs).select("language", "key")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("key"), batch.column("language"), pa.array([windows(t) for t in batch.column("text").to_pylist()], pa.binary())], ["key", "language", "windows"])

    found = keyed.join(F.broadcast(chosen), ["language", "key"])  # train_docs keys at most
    return arrow_map(found.select("key", "language", "text"), cut, "key long, language string, windows binary").groupBy("key", "language").agg(F.min("windows").alias("windows"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network from a bounded sample of docs; None where no row can train."""
    rows = sorted((r["language"], r["key"], bytes(r["windows"])) for r in sample(docs, per_language, train_docs).collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    pieces = [(languages.index(name), found[i : i + LENGTH]) for name, _, found in rows for i in range(0, len(found), LENGTH)]
    symbols = np.full((len(pieces), LENGTH), OUTSIDE, np.int64)
    for row, (_, piece) in zip(symbols, pieces):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    return fit(symbols, np.array([k for k, _ in pieces]), languages)


def _labeller(net: Network, docs: DataFrame) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The function by which workers predict: the number of each text's language, its share, and whether the text has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def label(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = texts.cast(pa.binary()).to_pylist()
        mean = shared.value.sums(data) / np.array([max(1, len(t or b"")) for t in data])[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(data)), best], _lettered(texts)

    return label


def _lettered(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), _LETTER), False).to_numpy(zero_copy_only=False)


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """docs without those of no language or of a score below least; all columns stay. Without a network all stay that have a letter."""
    label = _labeller(net, docs) if net else None
    name = next(c for c in docs.columns if c.lower() == "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(name)
        if label:
            _, share, known = label(texts)
            return batch.filter(pa.array(known & (share >= least)))
        return batch.filter(pa.array(_lettered(texts)))

    return arrow_map(docs, run, docs.schema, name)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    label = _labeller(net, docs)
    names = net.languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, share, known = label(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string()), pa.array(np.where(known, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return predict(docs, train(docs)).select("doc_id", held_out, "lang_pred", "score")
