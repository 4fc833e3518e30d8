"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the fixed positions of a mask; the words between are ignored, so a
substituted word there does not break it.  The masks below hit every stretch of ``WINDOW`` words (and
every item of 8 words or more) in which at least ``SHARE`` percent of the words agree; items of 5 to 7 words,
which may have one other word, have masks of three words, and shorter ones, which may have none, their
own length.  Seeds of the test
items are joined with those of all documents; each hit names a diagonal (document word minus item word),
and along it the words are compared one by one: a leak is a stretch of WINDOW words, or a whole shorter
item, with the share of equal words.

Only seeds whose words all belong to the items' vocabulary can hit, and the others are not hashed.  The
items are taken in blocks of at most ``BLOCK_WORDS`` words (one item at least), so what a task and the driver
hold is bounded however large the benchmark is; each block is one pass over the documents, and nothing is
shuffled before the hits.

Words are runs of digits, ASCII letters and non-ASCII characters, lower-cased.

Edge cases: null and empty texts and items have no words; items of fewer than ``LEAST`` words are not
searched; items that repeat an item_id are searched each; a pair found on several diagonals gives one row,
with the best of them (then the first); very long texts are searched whole; an empty documents or benchmark table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mapped, mix, row_groups
from linkloom.storage import written

WINDOW, SHARE, LEAST = 13, 80, 2
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
BLOCK_WORDS = 200_000
#: Seed hits that are looked at together.
HITS = 1 << 18
#: Every ASCII byte that is no digit or letter separates words.
WORDS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, item_id long, first_word long, after_word long, n_equal long, n_places long"


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(WORDS).split()


def needed(window: int, share: int = SHARE) -> int:
    return -(-share * window // 100)


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    return MASKS if length >= 8 else SHORT_MASKS if length >= 5 else (tuple(range(length)),)


def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the mask wherever all its words are known (not negative)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    at = known[:n].copy()
    for o in mask[1:]:
        at &= known[o : o + n]
    at = np.flatnonzero(at)
    value = np.full(len(at), sum(1 << o for o in mask), np.uint64)
    for o in mask:
        value = mix(value + ids[at + o].astype(np.uint64))
    return at, value


class Block:
    """The seeds of some test items, sorted by hash."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int32)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w) >= LEAST]
        #: Masks of these items; documents are searched with no others.
        self.masks = sorted({m for _, w in self.items for m in masks_of(len(w))})
        value, item, place = [], [], []
        for k, (_, words) in enumerate(self.items):
            for mask in masks_of(len(words)):
                at, v = seeds(words, mask)
                value.append(v), item.append(np.full(len(at), k)), place.append(at)
        self.value = np.concatenate(value) if value else np.zeros(0, np.uint64)
        order = np.argsort(self.value, kind="stable")
        self.value = self.value[order]
        self.item, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (item, place))

    def diagonals(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, document place of the item's first word) that some seed hits."""
        out = []
        for mask in self.masks:
            at, value = seeds(ids, mask)
            low, high = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
            times = high - low
            hits = np.flatnonzero(times)
            # so many hits at a time that a word repeated in a text and an item cannot fill the memory
            for hit in np.split(hits, np.flatnonzero(np.diff(np.cumsum(times[hits]) // HITS)) + 1):
                n = times[hit]
                entry = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(entry):
                    out.append(np.unique(np.stack((self.item[entry], np.repeat(at[hit], n) - self.place[entry]), axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def verify(self, ids: np.ndarray, item: int, start: int) -> tuple[int, int, int] | None:
        """(equal words, first, after) of the stretches along a diagonal that agree enough."""
        words = self.items[item][1]
        a, b = max(0, -start), min(len(words), len(ids) - start)
        if a >= b:
            return None
        equal = np.zeros(len(words), np.int32)
        equal[a:b] = words[a:b] == ids[start + a : start + b]
        window = min(WINDOW, len(words))
        sums = np.concatenate(([0], np.cumsum(equal)))
        good = np.flatnonzero(sums[window:] - sums[:-window] >= needed(window))
        if not len(good):
            return None
        inside = np.zeros(len(words) + 1, np.int32)
        np.add.at(inside, good, 1), np.add.at(inside, good + window, -1)
        agreed = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & (equal > 0))
        return len(agreed), int(start + agreed[0]), int(start + agreed[-1] + 1)


def leaks_of_block(documents: DataFrame, block: Block) -> DataFrame:
    gap = max(m[-1] for m in MASKS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_groups(batches):
            words = [words_of(t) for t in texts]
            # all texts in one row of ids, with unknown words between them
            parts = [x for w in words for x in (np.fromiter(map(block.vocabulary.get, w, repeat(-1)), np.int32, len(w)), np.full(gap, -1, np.int32))]
            ids = np.concatenate(parts)
            begin = np.concatenate(([0], np.cumsum([len(w) + gap for w in words])))
            found = block.diagonals(ids)
            first = begin[:-1]
            doc_ids, best = batch.column(0).to_pylist(), {}
            if len(found):
                # a diagonal may start before its document; the hit that gave it lies inside
                for item, place in found.tolist():
                    lengths = len(block.items[item][1])
                    for d in range(max(0, int(np.searchsorted(first, place, "right")) - 1), len(texts)):
                        if first[d] >= place + lengths:
                            break
                        own = ids[begin[d] : begin[d + 1] - gap]
                        leak = block.verify(own, item, place - int(begin[d]))
                        if leak:
                            key = (d, item)
                            old = best.get(key)
                            best[key] = (max(leak, old[0], key=lambda x: (x[0], -x[1])), old[1] + 1) if old else (leak, 1)
            rows = [(doc_ids[d], block.items[item][0], x[1], x[2], x[0], n) for (d, item), (x, n) in sorted(best.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "first_word", "after_word", "n_equal", "n_places"])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    held, size = [], 0
    for i, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        body = text.encode()
        n = len(words_of(body))
        if held and size + n > limit:
            yield Block(held)
            held, size = [], 0
        held.append((i, body))
        size += n
    yield Block(held)


def leaks(documents: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and test item that it holds: where, how many equal words, how many places."""
    done, out = [], None
    for block in blocks(benchmark, limit):
        if out is not None:  # written, so that the driver holds one block at a time
            done.append(written(out, "leaks"))
        out = leaks_of_block(documents, block)
    for found in done:
        out = out.unionByName(found)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item; rows that share the doc_id of one that does go with it."""
    found = leaks(documents, benchmark).select(F.col("doc_id").alias("leaked")).distinct()
    # whole rows ride in one column, so no name of theirs can clash
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("leaked")), "left_anti").select("row.*")
