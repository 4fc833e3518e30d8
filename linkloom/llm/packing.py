"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become token ids, an end id is added, and documents longer than a sequence are cut into whole
sequences and a rest.  The pieces that are left are bin-packed.

The genes of a packing are its bins.  A crossover injects the well-filled bins of one parent into
another, drops the bins of that parent that hold any of their documents, and puts the documents so
displaced back by best fit, longest first.  Pieces are dealt by hash to groups of about ``GROUP``
pieces; each group evolves on ``ISLANDS`` islands (rows of a table, so tasks of Spark), and between
epochs each island's elite migrates to the next one.  An island starts from best-fit packings of its
pieces in different orders and crosses in every generation; fewer bins win, then bins that are fuller
and leave their room in one place.  The best packing of the islands wins.  A group leaves a bin or two
poorly filled; the pieces of such bins are pooled and packed once more.

Tokenising is exact: pieces of text between ASCII white space are looked up, and unknown ones encoded
by the tokenizer itself (it never joins text across white space).

Edge cases: null and empty texts have the end id only; texts of any length are encoded whole and cut into
pieces of a sequence; pieces of equal length are ties, which any packing may order; an empty table gives no
rows; rows that repeat a doc_id are packed each; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import os
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mapped, row_groups
from linkloom.storage import written

LENGTH, END = 4096, 1
GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4_000, 2, 2, 4, 4
#: A bin below this share of the length is packed once more.
POOR = 0.97
MOST_WORDS = 1_000_000
#: Texts that are tokenised at once, about.
TEXT_BYTES = 4 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent(dict):
    """word -> ids, of the words asked for last: at half of ``MOST_WORDS`` all grow old, and those not asked for again go."""

    def __init__(self):
        self.old: dict = {}

    def age(self) -> None:
        if len(self) > MOST_WORDS // 2:
            self.old = dict(self)
            self.clear()

    def missing(self, words: Iterable) -> list:
        """Words without ids; those that have some stay until ``age`` is called."""
        new = list(filterfalse(self.__contains__, words))
        again = list(filter(self.old.__contains__, new))
        self.update(zip(again, map(self.old.__getitem__, again)))
        return list(filterfalse(self.old.__contains__, new)) if again else new


class Ids:
    """text (bytes) -> little-endian 32-bit ids (bytes), by words between ASCII white space.

    Unknown words are encoded many at a time.  Words of plain Latin text are cut into the letter runs,
    digits and symbol runs that the tokenizer itself cuts them into, since fewer of those are unknown;
    the token that ends each is marked in the vocabulary.  A part has the ids that it has as a word, so
    both are known by one name.  Between other words stands a private character, whose ids show where
    one word's ids end.  Texts are cut, and their words' ids laid side by side, by Arrow; each word is looked up once in a call, however often it stands in the texts.
    """

    MARK = "\ue000"
    # ASCII and the Latin letters and signs that lower-casing and composition leave one character each
    PLAIN = re.compile("[\x21-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u012f\u0131-\u017e]*")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Recent()
        self.mark = np.array(self.encode(self.MARK), "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: list[bytes]) -> None:
        ids = np.array(self.encode(f" {self.MARK} ".join([w.decode() for w in words] + [""])), "<u4")
        k = len(self.mark)
        hit = np.ones(max(len(ids) - k + 1, 0), bool)
        for j, m in enumerate(self.mark):
            hit &= ids[j : j + len(hit)] == m
        end = np.flatnonzero(hit)
        raw = ids.tobytes()
        self.known.update(zip(words, [raw[4 * a : 4 * b] for a, b in zip([0, *(end[:-1] + k).tolist()], end.tolist())], strict=True))

    def learn_plain(self, words: list[bytes], texts: list[str]) -> None:
        cut: list[bytes | list[bytes]] = []  # a word of letters is one part
        new, others = set(), set()
        for w, t in zip(words, texts):
            low = t.lower()
            if not low.isalpha():
                cut.append(parts := [p.encode() for p in self.PARTS.findall(low)])
                others.update(parts)
            elif low == t:
                cut.append(w)
                new.add(w)
            else:
                cut.append(part := low.encode())
                others.add(part)
        new = [*new, *self.known.missing(others - new)]
        for a in range(0, len(new), 5_000):
            part = new[a : a + 5_000]
            ids = np.array(self.encode(b" ".join(part).decode()), "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())], strict=True))
        of = self.known.__getitem__
        self.known.update(zip(words, [of(parts) if type(parts) is bytes else b"".join(map(of, parts)) for parts in cut]))

    def of(self, texts: list[bytes]) -> list[bytes]:
        gc.disable()  # nothing made here is cyclic, and the words are many
        try:
            return self.joined(texts)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()  # else Arrow keeps what a call took, beside the words

    def joined(self, texts: list[bytes]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        codes = pc.dictionary_encode(lists.flatten())
        # white space stands in no word; an empty one is looked up as what it is
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(codes.dictionary)], codes.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().encode().split(b" ")
        self.known.age()
        new = self.known.missing(words)
        seen = b" ".join(new).decode().split(" ") if new else []
        plain = [self.PLAIN.fullmatch(t) is not None and "<|" not in t for t in seen]
        self.learn_plain([w for w, p in zip(new, plain) if p], [t for t, p in zip(seen, plain) if p])
        mark = self.MARK.encode()
        rest = []
        for w in (w for w, p in zip(new, plain) if not p):
            if mark in w:
                self.known[w] = np.array(self.encode(w.decode()), "<u4").tobytes()
            else:
                rest.append(w)
        for a in range(0, len(rest), 5_000):
            self.learn(rest[a : a + 5_000])
        own = list(map(self.known.__getitem__, words))
        ends = np.cumsum([0, *map(len, own)])
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(own))])
        ids = own.take(codes.indices)
        _, ends, raw = ids.buffers()
        at = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


@cache
def ids_of(path: str) -> Ids:
    """One for each worker, so that words stay known from task to task."""
    return Ids(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end = END.to_bytes(4, "little")
        for batch, texts in row_groups(batches, TEXT_BYTES):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids.of(texts)):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[a : a + 4 * length]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


class Packing:
    """Bins (lists of items) with their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        return -len(self.bins), sum((x / capacity) ** 2 for x in self.loads)


def best_fit(sizes: list[int], items: list[int], capacity: int, start: Packing | None = None) -> Packing:
    """Puts each item, in the given order, where it leaves the least room."""
    bins = [list(b) for b in start.bins] if start else []
    loads = list(start.loads) if start else []
    room = sorted((capacity - x, i) for i, x in enumerate(loads) if x < capacity)
    for item in items:
        n = sizes[item]
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(item)
            loads[b] += n
            if left > n:
                bisect.insort(room, (left - n, b))
        else:
            bins.append([item])
            loads.append(n)
            if n < capacity:
                bisect.insort(room, (capacity - n, len(bins) - 1))
    return Packing(bins, loads)


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects well-filled bins of b into a, drops duplicates, best-fits what was displaced."""
    good = [i for i, x in enumerate(b.loads) if x >= capacity * 0.995] or [max(range(len(b.loads)), key=b.loads.__getitem__)]
    take = rng.sample(good, max(1, int(len(good) * rng.uniform(0.2, 0.6))))
    moved = {i for t in take for i in b.bins[t]}
    bins, loads = [b.bins[t] for t in take], [b.loads[t] for t in take]
    displaced: list[int] = []
    for items, load in zip(a.bins, a.loads):
        if moved.isdisjoint(items):
            bins.append(items)
            loads.append(load)
        else:
            displaced += [i for i in items if i not in moved]
    return best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), capacity, Packing(bins, loads))


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the worst bins and a few others, and best-fits their items."""
    order = sorted(range(len(p.bins)), key=p.loads.__getitem__)
    out = set(order[: 1 + len(order) // 50]) | set(rng.sample(order, min(len(order), 3)))
    items = [i for b in out for i in p.bins[b]]
    rest = [b for b in range(len(p.bins)) if b not in out]
    return best_fit(sizes, sorted(items, key=lambda i: -sizes[i]), capacity, Packing([p.bins[b] for b in rest], [p.loads[b] for b in rest]))


def evolve(sizes: list[int], start: list[list[int]], seed: int, capacity: int = LENGTH, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """Elites first: for each item its bin.  ``start``: packings to begin with (migrants and own elites)."""
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    group = [grouped(p, sizes) for p in start] or [best_fit(sizes, falling, capacity)]
    while len(group) < population:
        noisy = sorted(falling, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2))
        group.append(best_fit(sizes, noisy, capacity))
    group.sort(key=lambda p: p.fitness(capacity), reverse=True)
    for _ in range(generations):
        a, b = group[0], rng.choice(group[1:] or group)
        children = [cross(a, b, sizes, capacity, rng), cross(b, a, sizes, capacity, rng), mutate(a, sizes, capacity, rng)]
        group = sorted(group + children, key=lambda p: p.fitness(capacity), reverse=True)[:population]
    return [numbered(p, len(sizes)) for p in group[:2]]


def grouped(numbers: list[int], sizes: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for item, b in enumerate(numbers):
        bins[b].append(item)
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


def numbered(p: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


STATE = "grp long, island int, rows array<long>, sizes array<int>, elites array<array<int>>"


def epoch(state: DataFrame, number: int, capacity: int) -> DataFrame:
    """Evolves every island of every group, apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                grp, island, _, sizes, start = (batch.column(i)[r].as_py() for i in range(5))
                elites = evolve(sizes, start, hash((grp, island, number)), capacity)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(r, 1) for i in range(4)], pa.array([elites], pa.list_(pa.list_(pa.int32())))], names=batch.schema.names)

    return mapped(state.repartition("grp", "island"), run, STATE)


def migrate(state: DataFrame) -> DataFrame:
    """Each island begins the next epoch with its own elite and that of the island before it."""
    from_ = state.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("elites", 1, 1).alias("guest"))
    return state.join(from_, ["grp", "island"]).withColumn("elites", F.concat(F.slice("elites", 1, 1), "guest")).drop("guest")


def packed(items: DataFrame, first_id: int, capacity: int = LENGTH) -> DataFrame:
    """(row, sequence_id, offset, load) of the items (row, length); ids from first_id on are distinct."""
    n = items.count()
    groups = max(1, -(-n // GROUP))
    state = items.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("x"))
    state = state.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.row").alias("rows"), F.transform("x.length", lambda v: v.cast("int")).alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("elites"))
    for e in range(EPOCHS):
        state = written(epoch(state, e, capacity), "islands")
        if e < EPOCHS - 1:
            state = migrate(state)
    size = F.size(F.array_distinct(F.col("elites")[0]))
    best = state.groupBy("grp").agg(F.min(F.struct(size.alias("bins"), "island")).alias("b")).select("grp", "b.island")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                grp, rows, sizes, elites = (batch.column(i)[r].as_py() for i in range(4))
                p = grouped(elites[0], sizes)
                out = []
                for b, members in enumerate(p.bins):
                    offset = 0
                    for i in members:
                        out.append((rows[i], first_id + grp * (GROUP * 8) + b, offset, p.loads[b]))
                        offset += sizes[i]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "sequence_id", "offset", "load"])

    return mapped(state.join(best, ["grp", "island"]).select("grp", "rows", "sizes", "elites"), lay, "row long, sequence_id long, offset long, load long")


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(documents, path, length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter(F.col("length") == length)
    items = cut.filter(F.col("length") < length).select("row", "length")
    first = written(packed(items, 0, length), "packed")
    poor = first.filter(F.col("load") < POOR * length)
    again = packed(items.join(poor.select("row"), "row", "left_semi"), 1 << 61, length)
    placed = first.filter(F.col("load") >= POOR * length).unionByName(again).drop("load")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # a whole piece is a sequence of its own; its number is negative, so it meets no other
    alone = whole.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    return alone.select(*columns).unionByName(cut.join(placed, "row").select(*columns))
