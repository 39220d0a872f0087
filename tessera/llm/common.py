"""What the operators of this folder share: row keys, Arrow batches cut by bytes, checkpoints, word hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside keys; results carry the null itself.
NULL_ID = -(2**63)
#: Bytes of text that one step of a Python worker holds as Python objects.
STEP_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the test data or of a corpus laid out like it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The temporary folders of applications that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set and all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        where = _OWN[app]
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage ends there, and executors may be lost."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def keyed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id and text with a never-null row key: kid (doc_id) and th (a hash of the text).

    Rows that agree in both have the same text, so whatever holds for one of them holds for all.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("kid"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"), *more)


def steps(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text, one row at least."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """fn applied to every slice of df's Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def apart(key: str) -> Column:
    """The key (a long) under another value, so that a join on it shuffles both its sides for itself: a side that a grouping had
    partitioned already would be taken as it is, and then AQE couldn't split a hot key."""
    return F.col(key).bitwiseXOR(F.lit(1).cast("long")).alias(key)


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join of two that grow with the corpus: both are shuffled and sorted, so that neither goes through the driver, whatever size Spark takes it for."""
    return side.hint("merge")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HELD: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """make(), once in a worker process for each key; of many keys the last two stay. What tasks close over is copied to
    each task, so whatever is to outlive a task is kept here."""
    if key not in _HELD:
        while len(_HELD) >= 2:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = make()
    return _HELD[key]


class Memory(dict):
    """What a worker has worked out for recurring keys, bounded: when the newer half is full, the older is dropped, and keys of
    more than `longest` characters aren't kept."""

    def __init__(self, work: Callable[[str], bytes], size: int = 900_000, longest: int = 64) -> None:
        super().__init__()
        self.work, self.half, self.longest, self.old = work, size // 2, longest, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.old.get(key)) is None:
            found = self.work(key)
        if len(key) > self.longest:
            return found
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: list[str]) -> list[bytes]:
        """work(key) for every key."""
        return list(map(self.__getitem__, keys))


class Sums:
    """Rows of numbers worked out for recurring keys, many keys at once; of keys of `longest` bytes at most, the last `size` are kept."""

    def __init__(self, work: Callable[[list[bytes]], np.ndarray], width: int, size: int = 300_000, longest: int = 64) -> None:
        self.work, self.longest, self.place, self.table = work, longest, {}, np.zeros((size, width), np.float32)
        self.keys, self.next = [None] * size, 0

    def of(self, keys: list[bytes]) -> np.ndarray:
        """work(keys), whose rows depend on one key each."""
        different = list(set(keys))
        at = list(map(self.place.get, different))
        new = [k for k, p in zip(different, at) if p is None]
        known = np.array([p is not None for p in at], bool)
        rows = np.empty((len(different), self.table.shape[1]), np.float32)
        rows[known] = self.table[[p for p in at if p is not None]]
        rows[~known] = found = self.work(new)
        for key, row in zip(new, found):
            if len(key) <= self.longest:
                if (old := self.keys[self.next]) is not None:
                    del self.place[old]
                self.keys[self.next], self.place[key], self.table[self.next] = key, self.next, row
                self.next = (self.next + 1) % len(self.keys)
        place = dict(zip(different, range(len(different))))
        return rows[np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._cumulate(x, size) for x in (self.base, self.inverse))

    @staticmethod
    def _cumulate(x: int, size: int) -> np.ndarray:
        each = np.full(size, x, np.uint64)
        each[0] = 1
        return np.cumprod(each, dtype=np.uint64)


class Rolling:
    """Polynomial hashes of any ranges of one sequence of 64-bit values; equal ranges have equal hashes wherever they lie."""

    _powers: dict[int, Powers] = {}

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> None:
        self.p = self._powers.setdefault(base, Powers(base))
        self.p.grow(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.p.up[: len(values)], dtype=np.uint64)))

    def range(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.p.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k values."""
        n = max(0, len(self.sums) - k)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.p.down[:n]) if n else np.zeros(0, np.uint64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
