"""Shared pieces: table access, word streams and hashes.

Words are maximal runs of bytes other than space and \\t..\\r, so ``bytes.split`` is exact, and
``bytes.lower`` lower-cases A-Z only.  A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes that one vectorised step handles at once; a longer text is a step of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what a worker's allocators hold to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes, however long the texts are, and workers left small.

    The bound is the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` if that is below BATCH_BYTES.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = conf.get(name).rstrip("bB")
    if not (bound.isdigit() and int(bound) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text without decoding them; null gives b''."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def spans(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [from, to) of items of at most ``limit`` together, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


class WordHash(dict):
    """word (bytes) -> 64-bit hash; emptied when large, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: Odd bases of polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.size = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + 4096)
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate((one, np.cumprod(np.full(self.size, self.base, np.uint64))))
                self.down = np.concatenate((one, np.cumprod(np.full(self.size, pow(self.base, -1, 2**64), np.uint64))))
        return self.up, self.down


#: Words up to so many bytes are hashed eight bytes at a time, all together; longer ones one by one.
SHORT = 64


def word_mix(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places; eight bytes must follow the last of them.

    Each eight bytes are added and mixed by a bijection, so words of up to eight bytes and equal length
    never clash, and no structure of longer ones makes them clash.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mix(size.astype(np.uint64))
    at, left, which = start, size, slice(None)
    while len(at):
        mask = np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        out[which] = mix(out[which] + (eights[at] & mask))
        more = np.flatnonzero((left > 8) & (left <= SHORT if isinstance(which, slice) else True))
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return out


class ShingleSets:
    """Sets of k-word shingles of many texts at once."""

    def __init__(self, k: int):
        self.k = k
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def word_hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, lower-cased, and the number of words before each text."""
        joined = b" ".join([*texts, b" " * 8]).lower()
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = np.concatenate(([False], ~self.space[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edges[::2], edges[1::2] - edges[::2]
        hashes = word_mix(joined, start, size)
        return hashes, np.concatenate(([0], np.searchsorted(start, ends)))

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the sorted distinct shingle hashes; of the whole sequence if it has fewer words."""
        out: list[np.ndarray] = []
        for a, b in spans([len(t) for t in texts]):
            words, first = self.word_hashes(texts[a:b])
            all_ = shingle_hashes(words, self.k) if len(words) >= self.k else words[:0]
            for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                if j - i >= self.k:
                    s = np.sort(all_[i : j - self.k + 1])
                    out.append(s[np.append(True, s[1:] != s[:-1])])
                else:
                    out.append(shingle_hashes(words[i:j], self.k))
        return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` word hashes, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out + words[j : len(words) - k + 1 + j])
    return out


def row_groups(batches: Batches, limit: int = CHUNK_BYTES, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes, with those texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for a, b in spans(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
            yield batch.slice(a, b - a), byte_texts(column.slice(a, b - a))
