"""Token-id files by Re-Pair grammar compression.

Documents are range-partitioned by doc_id; each task encodes its documents, appends the end id, and writes shards of a
bounded number of ids. A shard's ids are compressed by Re-Pair: frequent pairs of neighbouring symbols of a document get
nonterminals, in rounds, each of which replaces many pairs that don't overlap, until no pair has LEAST places in the shard. Equal texts
of a shard are compressed once, with the weight of their number. A shard stores its rules and the length of each rule's expansion, and for each document where its symbols start; so one document, or any range of
its ids, is decoded without the others.

A file, little-endian: magic TSRA, version, width of a symbol in bits (16 at least), end id, first nonterminal, and the counts of rules,
documents and symbols (8 unsigned 32-bit integers); rules (pairs of unsigned 32-bit integers), their expansion lengths
(unsigned 32-bit), doc_ids (64-bit; a null is the least integer), documents' ids with the end id (unsigned 32-bit),
documents' first symbols (unsigned 32-bit), symbols (their low 16 bits, then a plane of one bit a symbol for each further bit).

A file is written under a name of its task's attempt and then renamed, so a task that runs again leaves the same file.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; an empty table
writes no file; strings of special tokens in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Memory, cut, once, shared_dir, steps

END, FIRST, SHARD_BYTES = 2, 50257, 12 << 20
LEAST = 8
#: Rules of longer expansions aren't held expanded.
SHORT = 64
_SAFE, _GAP = re.compile(r"(?= \S)"), re.compile(r"\s\s")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


#: Bytes as the library's byte-level vocabulary writes them: printable ones stay, the others follow from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


_SPACED, _MARKS = _WRITTEN[32], string.punctuation


class _Letters(dict):
    """A translation of code points to what their bytes are written as."""

    def __missing__(self, point: int) -> str:
        self[point] = "".join(map(_WRITTEN.__getitem__, chr(point).encode()))
        return self[point]


_LETTERS = _Letters()


class Encoder:
    """The tokenizers library behind a bounded memory of parts, which are cut where no match of its split can span.

    A part that is one match of the split, or one and marks, goes to the library's model directly; others go through
    the whole library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model.tokenize
        self.parts, self.after, self.marks = Memory(self.part), Memory(self.after_space, 1_200_000), Memory(self.mark, 20_000, 16)

    def part(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def after_space(self, text: str) -> bytes:
        """The ids of the text with a space before it, or as it is if it begins a line."""
        lead, text = ("\n", text[1:]) if text[0] == "\n" else (" ", text)
        word = text.rstrip(_MARKS)
        if not word.isalpha():
            return self.part(lead + text)
        mark = text[len(word) :]  # one match, as it holds no letter, digit or space
        written = word if word.isascii() else word.translate(_LETTERS)
        ids = [t.id for t in self.model(_SPACED + written)] if lead == " " else self.marks["\n"] + [t.id for t in self.model(written)]
        return array("I", ids + self.marks[mark] if mark else ids).tobytes()

    def mark(self, text: str) -> list[int]:
        return [t.id for t in self.model("".join(map(_WRITTEN.__getitem__, text.encode())))]

    def cut(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The texts in parts: each different part's ids, the parts' numbers in order, and how many parts each text has."""
        plain = np.array([_plain(t) for t in texts], bool)
        split = pc.split_pattern(pc.replace_substring(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), "\n", " \n"), " ")
        encoded = split.values.dictionary_encode()
        words, at = self.after.all(encoded.dictionary.to_numpy(zero_copy_only=False).tolist()), encoded.indices.to_numpy().astype(np.int64)
        begin = split.offsets.to_numpy()
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(begin)
        heads = [t.split(" ", 1)[0].split("\n", 1)[0] for t, p in zip(texts, plain) if p]  # a text's first part has no space before it
        at[begin[:-1]] = len(words) + np.arange(len(heads))
        words += self.parts.all(heads)
        if not plain.all():
            pieces, at = np.split(at, np.cumsum(counts)[:-1]), []
            for k, text in enumerate(texts):
                if plain[k] or not text:
                    at.append(pieces[k])
                    continue
                own = [p for p in _SAFE.split(text) if p]
                counts[k] = len(own)
                at.append(len(words) + np.arange(len(own)))
                words += self.parts.all(own)
            at = np.concatenate(at)
        return words, at, counts


def _plain(text: str | None) -> bool:
    """Whether a text has no two spaces of any kind together, none at its ends, and something at all."""
    if not text or text[0].isspace() or text[-1].isspace():
        return False
    if text.isascii() and not any(map(text.__contains__, _RARE)):  # spaces and newlines are its only white space
        return not any(map(text.__contains__, ("  ", "\n\n", " \n", "\n ")))
    return not _GAP.search(text)


@dataclass
class Grammar:
    """Symbols below first are ids; the others name rules, and expand to lengths[symbol - first] ids."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray

    def pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All short expansions, one after the other: where each symbol's begins, how long it is, the ids."""
        size = np.concatenate((np.ones(self.first, np.int64), self.lengths.astype(np.int64)))
        held = np.where(size > SHORT, 0, size)
        return np.cumsum(held) - held, size, self.opened(np.flatnonzero(held), size, 1).astype(np.uint32)

    def opened(self, symbols: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
        """symbols, with rules in place of those that expand to more than longest ids."""
        large = size[symbols] > longest
        if not large.any():
            return symbols
        sym, pos = symbols[large].astype(np.int64), (np.cumsum(size[symbols]) - size[symbols])[large]
        top, leaves = np.arange(len(sym)), []
        while len(sym):
            left, right = self.rules[sym - self.first].astype(np.int64).T
            sym, pos, top = np.concatenate((left, right)), np.concatenate((pos, pos + size[left])), np.concatenate((top, top))
            leaf = size[sym] <= longest
            leaves.append((sym[leaf], pos[leaf], top[leaf]))
            sym, pos, top = sym[~leaf], pos[~leaf], top[~leaf]
        sym, pos, top = (np.concatenate(x) for x in zip(*leaves))
        n = np.ones(len(symbols), np.int64)
        n[large] = np.bincount(top)
        out = np.repeat(symbols, n)
        out[np.repeat(large, n)] = sym[np.argsort(pos)]
        return out

    def expand(self, symbols: np.ndarray, pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The ids that symbols stand for."""
        begin, size, ids = pool or self.pool()
        return _gather(ids, begin, size, self.opened(symbols, size, SHORT))


def repair(ids: np.ndarray, starts: np.ndarray, first: int = FIRST, rounds: int | None = None, per_round: int | None = None, least: int = LEAST, weights: np.ndarray | None = None, before: Grammar | None = None) -> Grammar:
    """Re-Pair over documents that begin at starts (ascending, the first 0); pairs never cross documents. weights: how often
    each document counts. rounds, per_round: at most so many rounds, and rules a round. before: the rules that ids has already.

    A round counts all pairs, and replaces each place whose pair is more frequent than the pairs it overlaps if `least` of the
    pair's places are such; the most frequent pair's always are, so rounds end when no pair has `least` places.
    """
    seq, starts = ids.astype(np.int32), starts.astype(np.int64)
    weight = None if weights is None or (weights == 1).all() else np.repeat(weights.astype(np.int32), np.diff(np.append(starts, len(seq))))
    rules, lengths, done, none = ([before.rules], before.lengths.astype(np.int64), 0, np.iinfo(np.int32).max) if before else ([], np.zeros(0, np.int64), 0, np.iinfo(np.int32).max)
    ranks = np.full(len(seq) + 2, none, np.int32)
    live = np.ones(len(seq), bool)  # where pairs begin that may have `least` places; without a new symbol a pair doesn't gain any
    while len(seq) > 1 and (rounds is None or done < rounds):
        done += 1
        live[-1] = False
        live[starts[starts > 0] - 1] = False
        place, twin = _pairs(seq, live)
        pair, place = _ordered(seq, place, first + len(lengths))
        if not len(pair):
            break
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        many = np.diff(np.append(edge, len(pair)))
        count, pair = many if weight is None else np.add.reduceat(weight[place], edge, dtype=np.int64), pair[edge]
        live[place] = np.repeat(count >= least, many)
        live[twin] = live[twin - 1]
        best = np.flatnonzero(count >= least)
        best = best[np.argsort(-count[best], kind="stable")][:per_round]
        if not len(best):
            break
        rank = np.full(len(pair), none, np.int32)
        rank[best] = np.arange(len(best), dtype=np.int32)
        mine = np.repeat(rank, many)
        ranks[place + 1] = mine
        if len(place) * 4 > len(seq):
            at = np.flatnonzero((ranks[1 : len(seq) + 1] < ranks[: len(seq)]) & (ranks[1 : len(seq) + 1] < ranks[2 : len(seq) + 2]))
        else:  # few pairs: only their own places are looked at
            at = np.sort(place[(mine < ranks[place]) & (mine < ranks[place + 2])])
        rank = ranks[at + 1]
        ranks[place + 1] = none
        used = np.bincount(rank, None if weight is None else weight[at], len(best)) >= least
        at, rank = at[used[rank]], rank[used[rank]]
        new = np.stack((pair[best[used]] >> 32, pair[best[used]] & 0xFFFFFFFF), 1)
        seq[at] = first + len(lengths) + (np.cumsum(used) - 1)[rank]
        rules.append(new)
        lengths = np.append(lengths, np.where(new < first, 1, np.append(lengths, 1)[np.maximum(new - first, -1)]).sum(1))
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)
        seq, live = seq[keep], live[keep]
        weight = None if weight is None else weight[keep]
        at = at - np.arange(len(at))
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
    rules = np.concatenate(rules) if rules else np.zeros((0, 2))
    return Grammar(first, rules.astype(np.uint32), lengths.astype(np.uint32), seq.astype(np.uint32), starts)


def _pairs(seq: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of live pairs; and those left out, because in a run of one symbol every second pair overlaps the one before."""
    place = np.flatnonzero(live).astype(np.int32)
    left, right = seq[place], seq[place + 1]
    twin = np.flatnonzero((left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (left[1:] == right[1:]) & (np.diff(place) == 1)) + 1
    edge = np.flatnonzero(np.diff(twin, prepend=-9) != 1)
    twin = twin[(np.arange(len(twin)) - np.repeat(edge, np.diff(np.append(edge, len(twin))))) % 2 == 0]
    return np.delete(place, twin), place[twin]


def _ordered(seq: np.ndarray, place: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at places (left << 32 | right) in ascending order, and their places, ascending within a pair."""
    bits, room = symbols.bit_length(), len(seq).bit_length()
    if 2 * bits + room > 63:
        pair = seq[place].astype(np.int64) << 32 | seq[place + 1]
        order = np.argsort(pair, kind="stable")
        return pair[order], place[order]
    packed = seq[place].astype(np.int64)  # pair and place in one number: sorted much faster than by an index
    packed <<= bits
    packed |= seq[place + 1]
    packed <<= room
    packed |= place
    packed.sort()
    place = (packed & (1 << room) - 1).astype(np.int32)
    packed >>= room
    right = packed & (1 << bits) - 1
    packed >>= bits
    packed <<= 32
    packed |= right
    return packed, place


def repair_texts(texts: list[str | None], encoder: Encoder, first: int) -> tuple[Grammar, np.ndarray]:
    """Re-Pair over the texts' ids, and the number of ids of each text. Equal texts are encoded and compressed once, with
    the weight of their number. Pairs inside parts come first, over the different parts with the weight of each one's number, then all
    pairs over the texts."""
    number: dict[str | None, int] = {}
    at = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    parts, place, counts = encoder.cut(list(number))
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    edge = np.concatenate(([0], np.cumsum(counts)))
    sizes = np.diff(np.concatenate(([0], np.cumsum(size[place])))[edge])
    copies = np.bincount(at)
    inner = repair(np.frombuffer(b"".join(parts), np.uint32), np.cumsum(size) - size, first, weights=np.bincount(place, np.repeat(copies, counts), len(parts)).astype(np.int64))
    del parts
    width = np.diff(np.append(inner.starts, len(inner.symbols)))
    symbols = _gather(inner.symbols, inner.starts, width, place)
    sizes_now = np.diff(np.concatenate(([0], np.cumsum(width[place])))[edge])
    del place
    g = repair(symbols, np.cumsum(sizes_now) - sizes_now, first, weights=copies, before=inner)
    width = np.diff(np.append(g.starts, len(g.symbols)))
    return Grammar(first, g.rules, g.lengths, _gather(g.symbols, g.starts, width, at), np.cumsum(width[at]) - width[at]), sizes[at]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of pool named by at, one after the other."""
    n = size[at]
    stop = np.cumsum(n)
    step = np.ones(int(stop[-1]) if len(stop) else 0, np.int64)
    some = n > 0  # each run begins where its start is, and goes on by one
    begin, n, stop = start[at[some]], n[some], stop[some]
    if len(begin):
        step[0] = begin[0]
        step[stop[:-1]] = begin[1:] - (begin[:-1] + n[:-1] - 1)
    return pool[np.cumsum(step)]


def to_bytes(g: Grammar, doc_ids: np.ndarray, sizes: np.ndarray, end: int = END) -> bytes:
    """The content of a file."""
    width = max(16, (g.first + len(g.rules) - 1).bit_length())
    planes = [np.packbits(g.symbols >> k & 1, bitorder="little") for k in range(16, width)]
    head = np.array([int.from_bytes(b"TSRA", "little"), 2, width, end, g.first, len(g.rules), len(doc_ids), len(g.symbols)], "<u4")
    return b"".join(x.tobytes() for x in (head, g.rules.astype("<u4"), g.lengths.astype("<u4"), doc_ids.astype("<i8"), sizes.astype("<u4"), g.starts.astype("<u4"), g.symbols.astype("<u2"), *planes))


class Reader:
    """A file's content, opened for random access by document."""

    def __init__(self, data: bytes) -> None:
        magic, version, width, self.end, first, rules, docs, symbols = np.frombuffer(data, "<u4", 8).tolist()
        if magic != int.from_bytes(b"TSRA", "little") or version != 2:
            raise ValueError("not a token file")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        pairs, lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.doc_ids, self.sizes, starts = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        wide = take("<u2", symbols).astype(np.uint32)
        for k in range(16, width):
            wide |= np.unpackbits(take("u1", (symbols + 7) // 8), count=symbols, bitorder="little").astype(np.uint32) << np.uint32(k)
        self.grammar = Grammar(first, pairs, lengths, wide, starts)
        self.pool = self.grammar.pool()
        self.bounds = np.append(starts, symbols).astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        """All ids of the document at place k, with the end id."""
        return np.append(self.grammar.expand(self.grammar.symbols[self.bounds[k] : self.bounds[k + 1]], self.pool), np.uint32(self.end)).astype("<u4")

    def range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the document at place k; only the symbols that hold them are expanded."""
        symbols = self.grammar.symbols[self.bounds[k] : self.bounds[k + 1]]
        stops = np.cumsum(self.pool[1][symbols])
        a, b = np.searchsorted(stops, start, "right"), np.searchsorted(stops, min(stop, int(self.sizes[k]) - 1), "left") + 1
        part = self.grammar.expand(symbols[a:b], self.pool)
        before = int(stops[a - 1]) if a else 0
        whole = np.append(part, np.uint32(self.end)) if stop >= self.sizes[k] else part
        return whole[start - before : stop - before].astype("<u4")

    def everything(self) -> Iterator[tuple[int, bytes]]:
        """Each document's id and its ids as little-endian unsigned 32-bit integers."""
        ids, at = self.grammar.expand(self.grammar.symbols, self.pool), 0
        tail = np.array([self.end], "<u4").tobytes()
        for doc, n in zip(self.doc_ids.tolist(), self.sizes.tolist()):
            yield doc, ids[at : at + n - 1].astype("<u4").tobytes() + tail
            at += n - 1


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_shards(docs: DataFrame, out: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes docs' ids to files under the URI out, in ascending doc_id order (nulls first); returns one row per file:
    part, piece (their order is the files'), path, n_docs, n_ids. The result is cut, so files are written once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, (store, folder) = once(f"encoder {tokenizer}", lambda: Encoder(tokenizer)), TaskContext.get(), _store(out)
        store.create_dir(folder, recursive=True)
        size = encoder.library.get_vocab_size()
        texts, keys, total, piece = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal texts, keys, total, piece
            g, sizes = repair_texts(texts, encoder, size)
            name = f"{folder}/ids-{task.partitionId():07d}-{piece:05d}.tsra"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as f:
                f.write(to_bytes(g, np.array(keys, np.int64), sizes + 1, end))
            if store.get_file_info(name).type == pa.fs.FileType.NotFound:
                store.move(f"{name}.{task.taskAttemptId()}", name)
            else:  # left by an earlier run of this task, with the same content
                store.delete_file(f"{name}.{task.taskAttemptId()}")
            row = pa.record_batch([pa.array([x]) for x in (task.partitionId(), piece, name, len(keys), int(sizes.sum()) + len(keys))], ["part", "piece", "path", "n_docs", "n_ids"])
            texts, keys, total, piece = [], [], 0, piece + 1
            return row

        for batch in batches:
            for rows in steps(batch, "text", SHARD_BYTES // 8):
                texts += rows.column("text").to_pylist()
                keys += rows.column("key").to_pylist()
                total += rows.column("text").nbytes
                if total >= SHARD_BYTES:
                    yield flush()
        if keys:
            yield flush()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    place = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = place.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    return cut(ordered.select("key", "text").mapInArrow(write, "part long, piece long, path string, n_docs long, n_ids long"))


def read_shards(files: DataFrame, out: str) -> DataFrame:
    """The files of write_shards read back: doc_id, start, n_tokens, ids_crc32, one row per document."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    placed = files.join(starts, "part").withColumn("base", F.col("start") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("piece")) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(out)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_stream(path) as f:
                    reader = Reader(f.read())
                crc = [zlib.crc32(x) for _, x in reader.everything()]
                n = reader.sizes.astype(np.int64)
                null = reader.doc_ids == NULL_ID
                yield pa.record_batch([pa.array(reader.doc_ids, mask=null), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "base").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, out, public_tokenizers.path("byte_bpe_50k.json")), out)
