"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encoding of a concatenation is a product of encodings. A text falls into parts where no match of the split pattern can
span; products there are concatenations, made up a tree. Inside one match, halves are encoded recursively, down to LEAF bytes, and
neighbours are joined by encoding a window around their seam anew. A token sequence is the encoding of its bytes exactly
when each two adjacent tokens, encoded alone, stay as they are. So the window grows to the left until its left seam holds,
and moves to the right, one token at a time, until its right seam holds; then nothing outside it can change. A window holds a few tokens, however
long the match; windows of more than SMALL bytes are merged with a heap. Decoding
concatenates the tokens' bytes up the same kind of tree.

Parts that recur are encoded once: a worker keeps a memory from short parts to ids, of bounded number and length, which never
changes a result.

Defined results: a null or empty text has no ids; strings of special tokens in a text are ordinary text; a match of any
length is encoded whole (a megabyte of one character in seconds); repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, arrow_map, once

#: Bytes of a match that are encoded without halving; bytes of a window that are merged without a heap; parts that one node of the tree joins.
LEAF, SMALL, FAN = 6, 48, 64
#: The rank of a pair that is no token.
NEVER = 1 << 62
#: A text cut before every space that a non-space follows: no match of the pattern spans such a place.
_SAFE, _GAP = re.compile(r"(?= \S)"), re.compile(r"\s\s")


def up(parts: list[bytes]) -> bytes:
    """The concatenation of all parts, up a tree."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return parts[0] if parts else b""


class Codec:
    """Encodes with one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.parts, self.after = Memory(self.part, 200_000), Memory(self.after_space)
        self.leaf, self.held = Memory(self.merge, 100_000, 256), lru_cache(1 << 16)(self._held)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a short piece: the adjacent pair of least rank is merged, leftmost first, until none is in the ranks."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > SMALL:
            return self.merge_long(piece)
        get, at = self.ranks.get, list(range(len(piece) + 1))  # at: where units begin
        pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != NEVER:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[at[i] : at[i + 2]], NEVER)
            if i:
                pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], NEVER)
        return [self.ranks[piece[a:b]] for a, b in zip(at, at[1:])]

    def _held(self, a: int, b: int) -> bool:
        return self.leaf[self.bytes_of[a] + self.bytes_of[b]] == [a, b]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n steps: candidates in a heap, units as a list of starts linked both ways."""
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (middle := after[i]) >= n or after[middle] != stop:
                continue  # one of its units has been merged since
            gone[middle] = 1
            after[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : after[stop]])) is not None:
                    heapq.heappush(heap, (r, i, after[stop]))
            if i and (r := get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two encodings, the ids of the bytes of left followed by those of right; left's list becomes it."""
        done = 0
        while left and done < len(right) and not self.held(left[-1], right[done]):
            size = 1
            while True:
                middle = self.reencode(left[-size:], right[done : done + 1])
                if size >= len(left) or self.held(left[-size - 1], middle[0]):
                    break
                size = min(len(left), 2 * size)
            left[-size:] = middle
            done += 1
        left += right[done:]
        return left

    def reencode(self, left: list[int], right: list[int]) -> list[int]:
        return self.leaf[b"".join(map(self.bytes_of.__getitem__, left + right))]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern: halves are encoded and joined."""
        if len(data) <= LEAF:
            return [*self.leaf[data]]
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def part(self, text: str) -> bytes:
        """The ids of a part, as little-endian unsigned 32-bit integers."""
        if text[:1] == " " and text[1:].isalpha():  # one match
            return array("I", self.piece(text.encode())).tobytes()
        ids: list[int] = []
        for match in self.pattern.findall(text):
            ids += self.piece(match.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or _GAP.search(text):
            return up(self.parts.all(_SAFE.split(text)))
        first, *rest = text.replace("\n", " \n").split(" ")  # with no two spaces of any kind together, each alone is a safe cut
        return up([self.part(first), *self.after.all(rest)])

    def after_space(self, text: str) -> bytes:
        return self.part(text if text[0] == "\n" else " " + text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as by encode."""
        return up([*map(self.bytes_of.__getitem__, array("I", ids))])


def codec(path: str) -> Codec:
    """The worker's codec for a rank file."""
    return once(f"codec {path}", lambda: Codec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids binary, decoded binary")


def encode_columns(docs: DataFrame, path: str, names: list[str]) -> DataFrame:
    """The named columns of docs, and of every text n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded_crc32,
    the checksum of the bytes that the ids decode to, which is the text's."""
    rows = docs.select(F.struct(*names).alias("kept"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("kept"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(c.decode(x)) for x in ids], pa.int64())], ["kept", "n_tokens", "ids", "decoded_crc32"])

    return arrow_map(rows, run, f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens long, ids binary, decoded_crc32 long").select("kept.*", "n_tokens", "ids", "decoded_crc32")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column("text").to_pylist()]
        hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        return pa.record_batch([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), hexed(ids), hexed(map(c.decode, ids))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
