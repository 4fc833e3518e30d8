"""Exact Jaccard join of shingle sets with skipping by set relations.

Documents link when 100 |x & y| >= ``percent`` |x | y|.  Sets that are equal form a class and are joined once.

Index level.  Shingles have a global order: those that are frequent in prefixes last (by count), the
others by hash.  Linked sets share a shingle of their prefixes, so lists of the sets that have a shingle
in their prefix hold every link.  A list is cut into blocks by set size and position, each with a leader
(its smallest set), and two blocks are skipped together when the sizes, or the words left behind the
shingle's positions, cannot give the overlap.

Answer level.  A set is answered with the sets most like it: each set is given to the leader that it
meets in most lists, and a leader's sets are cut into bounded tiles.  In a tile only the leader is compared
in full; a member is held as its difference from the leader (what it lacks, what it adds), and the overlap
of two members follows from the leader's answers, corrected by the differences (``overlaps``).  A component
that arises answers for all its members: further tiles of two blocks are made only where the blocks hold
different components, so a large group of near copies costs its size, not its square.

Every set also has a signature, the parity of its shingles in each of 2 to 4 bits per shingle: two
signatures differ in at most as many bits as the sets in shingles, so pairs whose signatures differ too
much are skipped before any text is moved.  No pair that links is lost by it.

Shingles are compared by 64-bit hashes that no structure of the words makes clash (``common.word_mix``);
a link that joins two components is verified on the words themselves before it counts.

Frequent shingles (a prefix count above ``P / MOST_FREQUENT`` of P prefix shingles, so fewer than
MOST_FREQUENT of them) are the only thing that is broadcast.

Edge cases: null and empty texts have empty sets, link with nothing and are their own component; texts
with fewer words than a shingle have one shingle; very long texts are whole sets like others (a tile holds
two sets at least, however long); rows that share a doc_id share its component; rows without doc_id are
nodes of their own (component null where no row of it has a doc_id); ties between leaders go to the smaller
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import ShingleSets, byte_texts, mapped, row_groups
from linkloom.operators.components import connected_components
from linkloom.storage import discard, written

WORDS, PERCENT = 4, 85
FREQUENT, MOST_FREQUENT = 32, 1 << 18
#: Bounds of a tile's side: sets, and shingles in all.
TILE_SETS, TILE_SHINGLES = 64, 1 << 16
#: Least bits of a signature.
SIGNATURE = 256


def prefix_size(n: int, percent: int) -> int:
    """A set of n and any set that links with it share one of so many first shingles."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def links(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of the shingles, 2 to 4 for each, as 64-bit words."""
    bits = max(SIGNATURE, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else SIGNATURE
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sign: np.ndarray, words: int) -> np.ndarray:
    """The same set's signature of fewer bits."""
    return sign if len(sign) == words else np.bitwise_xor.reduce(sign.reshape(-1, words), axis=0)


def may_link(bits: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of ``total`` shingles together link if their signatures differ in so many bits?"""
    return bits * (100 + percent) <= total * (100 - percent)


def led_sets(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n, leader, meets) from (id, n, leader, m, sign, lead_sign): may a set link with its leader?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(4), batch.column(5)
            bits = np.zeros(batch.num_rows, np.int64)
            for r in range(batch.num_rows):
                x, y = one[r].values.to_numpy(False), two[r].values.to_numpy(False)
                w = min(len(x), len(y))
                bits[r] = np.bitwise_count((folded(x, w) ^ folded(y, w)).view(np.uint64)).sum(dtype=np.int64)
            i, n, leader, m = (batch.column(c).to_numpy(False).astype(np.int64) for c in range(4))
            meets = (i != leader) & may_link(bits, n + m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(meets)], names=["id", "n", "leader", "meets"])

    return mapped(rows.select("id", "n", "leader", "m", "sign", "lead_sign"), run, "id long, n int, leader long, meets boolean")


class Order:
    """The global order: rank of frequent shingles behind all others."""

    def __init__(self, frequent: dict[int, int]):
        keys = np.fromiter(frequent, np.uint64, len(frequent))
        counts = np.fromiter(frequent.values(), np.int64, len(frequent))
        by_value = np.argsort(keys)
        self.keys = keys[by_value]
        self.rank = np.empty(len(keys), np.int64)
        self.rank[np.lexsort((keys, counts))] = np.arange(1, len(keys) + 1)
        self.rank = self.rank[by_value]

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        if not len(self.keys):
            return shingles[:size]
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        rank = np.where(self.keys[at] == shingles, self.rank[at], 0)
        return shingles[np.argsort(rank, kind="stable")[:size]]


def source(documents: DataFrame) -> DataFrame:
    """(id, text); a row without doc_id is labelled by a hash of its text, so only equal texts share a label."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no doc_id"), F.col("text"))).alias("id"), F.col("text"))


def frequent_shingles(documents: DataFrame, k: int, percent: int) -> dict[int, int]:
    """Shingles frequent in prefixes by hash, over all documents, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(k)
        for _, texts in row_groups(batches):
            parts = [s[: prefix_size(len(s), percent)] for s in sets.of(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).astype(np.uint64).view(np.int64))], names=["v"])

    counts = written(mapped(documents.select("text"), run, "v long").groupBy("v").count().filter(F.col("count") > 1), "counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    least = max(FREQUENT, total // MOST_FREQUENT)
    found = counts.filter(F.col("count") > least).collect()
    discard(counts)
    return {v % 2**64: n for v, n in found}


def prefixes(documents: DataFrame, frequent: dict[int, int], k: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, prefix, sign) of every document; d1, d2: digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, order = ShingleSets(k), Order(frequent)
        for batch, texts in row_groups(batches):
            n, digests, parts, signs = [], [], [], []
            for s in sets.of(texts):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                parts.append(order.prefix(s, prefix_size(len(s), percent)))
                signs.append(signature(s))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.uint64).view(np.int64)))
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signs)]), pa.int32()), pa.array(np.concatenate(signs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, words], names=["id", "n", "d1", "d2", "prefix", "sign"])

    return mapped(source(documents), run, "id long, n int, d1 long, d2 long, prefix array<long>, sign array<long>")


def lists(classes: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, pos, leader) of the lists with two sets or more; streams, so a long list is no burden."""
    entries = classes.select(F.posexplode("prefix").alias("pos", "v"), "id", "n").repartition("v").sortWithinPartitions("v", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the last list's only entry so far
        current, leader, size = None, 0, 0  # the list that goes on, and its block's leader

        def emit(rows: np.ndarray, led: np.ndarray) -> pa.RecordBatch:
            v, n, i, pos = rows
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(i), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(led)], names=["v", "id", "n", "pos", "leader"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(False).astype(np.int64) for i in range(4)])
            if not rows.shape[1]:
                continue
            rows = np.concatenate((held, rows), axis=1)
            v, n, ids = rows[0], rows[1], rows[2]
            begin = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            end = np.append(begin[1:], len(v))
            keep, led = np.zeros(len(v), bool), np.zeros(len(v), np.int64)
            goes_on = current is not None and v[0] == current
            for a, b in zip(begin[many := (end - begin >= 2) | ((begin == 0) & goes_on)].tolist(), end[many].tolist()):
                keep[a:b] = True
                if not (a == 0 and goes_on):
                    leader, size = ids[a], n[a]
                while a < b:
                    stop = a + int(np.searchsorted(n[a:b], size * 100 // percent, side="right"))
                    led[a:stop] = leader
                    if stop < b:
                        leader, size = ids[stop], n[stop]
                    a = stop
            last = begin[-1]
            alone = end[-1] - last == 1 and not (last == 0 and goes_on)
            held = rows[:, last:] if alone else np.zeros((4, 0), np.int64)
            current = None if alone else v[-1]
            if keep.any():
                yield emit(rows[:, keep], led[keep])

    return mapped(entries.select("v", "n", "id", "pos"), run, "v long, id long, n int, pos int, leader long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """|x & y| of all pairs, derived from the first set's answers.

    With R the first set, each other one is what it lacks of R and what it adds, and two of them share
    |R| less what either lacks, plus what both lack and what both add.
    """
    lead, lacks, adds = sets[0], [], []
    for s in sets:
        at = np.minimum(np.searchsorted(lead, s), max(len(lead) - 1, 0))
        same = lead[at] == s if len(lead) else np.zeros(len(s), bool)
        missing = np.ones(len(lead), bool)
        missing[at[same]] = False
        lacks.append(np.flatnonzero(missing))
        adds.append(s[~same])
    n_lacks = np.array([len(x) for x in lacks])
    out = len(lead) - n_lacks[:, None] - n_lacks[None, :]
    for parts in (lacks, adds):
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1  # what one set alone lacks or adds is in no overlap
        row = np.repeat(np.arange(len(sets)), [len(x) for x in parts])[shared]
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        width = int(column.max()) + 1 if len(column) else 0
        for a in range(0, width, 1 << 14):  # a strip of shingles at a time
            inside = (column >= a) & (column < a + (1 << 14))
            matrix = np.zeros((len(sets), min(width - a, 1 << 14)), np.float32)
            matrix[row[inside], column[inside] - a] = 1
            out += (matrix @ matrix.T).astype(np.int64)
    return out


def word_sets(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()
    return set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def join_tile(sets: list[np.ndarray], texts: list[bytes], side: np.ndarray, comp: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """(component, least component) of those that the tile's links connect; side: 1 and 2 are joined with each other, 0 with all, 3 among themselves."""
    parent = {int(c): int(c) for c in comp}
    exact: dict[int, set[tuple[bytes, ...]]] = {}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    n = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets)
    apart = (side[:, None] == side[None, :]) & np.isin(side, (1, 2))[:, None]
    fit = links(both, n[:, None], n[None, :], percent) & ~apart & (comp[:, None] != comp[None, :]) & (n > 0)[:, None] & (n > 0)[None, :]
    for i, j in np.argwhere(np.triu(fit, 1)).tolist():
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a == b:
            continue
        x, y = (exact[t] if t in exact else exact.setdefault(t, word_sets(texts[t], k)) for t in (i, j))
        if links(len(x & y), len(x), len(y), percent):
            parent[max(a, b)] = min(a, b)
    return [(c, root(c)) for c in parent if root(c) != c]


MEMBER = "struct<id:long,comp:long,text:string>"


def tile_links(tiles: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst) from rows of lists of members: two lists, a head and what is joined with it and among itself; three, the last two with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ShingleSets(k)
        for batch in batches:
            for r in range(batch.num_rows):
                comps, texts, side = [], [], []
                for which in range(batch.num_columns):
                    members = batch.column(which)[r].values
                    if members is None:
                        continue
                    comps += members.field("comp").to_pylist()
                    texts += byte_texts(members.field("text"))
                    side += [which] * len(members)
                if batch.num_columns == 2:
                    side = [3 if s else 0 for s in side]
                found = join_tile(make.of(texts), texts, np.array(side), np.array(comps), k, percent)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    return mapped(tiles, run, "src long, dst long")


def chunked(members: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``chunk``: a group's members are dealt out to as many chunks as keep each within a tile's side."""
    sizes = members.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("_chunks"))
    return members.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks"))).drop("_chunks")


def pairs_of_blocks(entries: DataFrame, percent: int) -> DataFrame:
    """(b1, b2): blocks that meet in a list, hold different components, and pass the bounds there."""
    blocks = entries.groupBy("v", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("n_behind").alias("behind"), F.max("pos").alias("last"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    several = blocks.groupBy("v").agg(F.count(F.lit(1)).alias("_m"), F.min("c1").alias("_a"), F.max("c2").alias("_b")).filter("_m > 1 and _a <> _b").select("v")
    blocks = blocks.join(several, "v").repartition("v").sortWithinPartitions("v", "least", "block")

    def solve(rows: list[np.ndarray], old: int) -> pa.RecordBatch:
        """Pairs in all lists at once, by growing distance in the list; those of two of the first ``old`` rows are known."""
        v, block, least, most, behind, last, c1, c2 = rows
        out1, out2 = [], []
        i, step = np.arange(len(v)), 0
        while len(i):
            step += 1
            i = i[i + step < len(v)]
            j = i + step
            near = (v[i] == v[j]) & (percent * least[j] <= 100 * most[i])  # the list is sorted by ``least``
            i, j = i[near], j[near]
            # overlap at most: words before the shingle on both sides, itself, and those behind it
            bound = np.minimum(last[i], last[j]) + 1 + np.minimum(behind[i], behind[j])
            one = (c1[i] == c2[i]) & (c1[j] == c2[j]) & (c1[i] == c1[j])
            fit = (bound * (100 + percent) >= percent * (least[i] + least[j])) & ~one & (j >= old)
            out1.append(np.minimum(block[i[fit]], block[j[fit]]))
            out2.append(np.maximum(block[i[fit]], block[j[fit]]))
        one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out1, out2))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 8  # rows of the last list that later rows may still meet
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(False).astype(np.int64) for i in range(8)]
            rows = [np.concatenate(x) for x in zip(held, new)]
            yield solve(rows, len(held[0]))
            keep = (rows[0] == rows[0][-1]) & (percent * rows[2][-1] <= 100 * rows[3])
            held = [x[keep] for x in rows]

    return mapped(blocks.select("v", "block", "least", "most", "behind", "last", "c1", "c2"), run, "b1 long, b2 long").distinct()


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Those (b1, b2) with members of different components that may link, and these members, by lists of (id, n, comp, sign)."""

    def side(column: pa.Array, r: int) -> tuple[np.ndarray, ...]:
        members = column[r].values
        signs = members.field("sign")
        edges = signs.offsets.to_numpy(False)
        flat = signs.values.to_numpy(False).view(np.uint64)
        return members.field("id").to_numpy(False), members.field("n").to_numpy(False).astype(np.int64), members.field("comp").to_numpy(False), [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                (i, n, c, x), (j, m, d, y) = side(batch.column(2), r), side(batch.column(3), r)
                w = min(map(len, x + y))
                x, y = (np.stack([folded(s, w) for s in z]) for z in (x, y))
                bits = np.stack([np.bitwise_count(s ^ y).sum(axis=1, dtype=np.int64) for s in x])
                sums = n[:, None] + m[None, :]
                fit = percent * np.maximum(n[:, None], m[None, :]) <= 100 * np.minimum(n[:, None], m[None, :])
                fit &= may_link(bits, sums, percent) & (c[:, None] != d[None, :])
                if fit.any():
                    rows.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), i[fit.any(axis=1)].tolist(), j[fit.any(axis=0)].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["b1", "b2", "i1", "i2"])

    return mapped(pairs.select("b1", "b2", "s1", "s2"), run, "b1 long, b2 long, i1 array<long>, i2 array<long>")


def linked(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, n, rep) of every document, and (node, comp) of the classes that link with others."""
    described = written(prefixes(documents, frequent_shingles(documents, k, percent), k, percent), "prefixes")
    one = F.min_by(F.struct("prefix", "sign"), "id").alias("x")
    classes = written(described.filter("n > 0").groupBy("n", "d1", "d2").agg(one, F.min("id").alias("id")).select("n", "d1", "d2", "id", "x.*"), "classes")
    members = described.select("id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", F.col("id").alias("rep")), ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = written(members, "members")
    discard(described)
    entries = written(lists(classes, percent), "lists")
    # the leader met in most lists; a set that leads its own lists may stay its own
    best = entries.groupBy("id", "leader", "n").count().groupBy("id", "n").agg(F.max(F.struct("count", -F.col("leader"))).alias("best")).select("id", "n", (-F.col("best").getField("col2")).alias("leader"))
    signs = written(classes.select("id", "n", "sign").join(best.select("id").distinct(), "id", "left_semi"), "signs")
    discard(classes)
    led = best.join(signs.select("id", "sign"), "id").join(signs.select(F.col("id").alias("leader"), F.col("n").alias("m"), F.col("sign").alias("lead_sign")), "leader")
    led = written(led_sets(led, percent), "led")
    meeting = written(chunked(led.filter("meets"), ["leader"]).select("id", "leader", "chunk"), "meeting")
    heads = meeting.select(F.col("leader").alias("id")).distinct()
    texts = written(source(documents).join(meeting.select("id").union(heads).distinct(), "id"), "texts")
    own = F.struct("id", F.col("id").alias("comp"), "text")
    first = texts.join(meeting, "id").groupBy("leader", "chunk").agg(F.collect_list(own).alias("own"))
    heads = texts.join(heads, "id").select(F.col("id").alias("leader"), F.array(own).alias("head"))
    near = written(tile_links(first.join(heads, "leader").select("head", "own"), k, percent), "near")
    discard(texts)
    discard(meeting)
    comp = connected_components(near)
    # what is left: blocks with different components that meet in a list
    placed = led.select("id", "n", "leader").join(comp, F.col("id") == F.col("node"), "left").select("id", "n", "leader", F.coalesce("comp", "id").alias("comp"))
    heading = placed.select(F.col("id").alias("leader"), F.col("comp").alias("lead_comp"))
    placed = placed.join(heading, "leader", "left").withColumn("apart", ~F.col("comp").eqNullSafe(F.col("lead_comp"))).drop("lead_comp")
    placed = written(placed, "by_leader")
    placed = written(chunked(placed, ["leader", "apart"]).withColumn("block", F.xxhash64("leader", "apart", "chunk")), "placed")
    meeting = entries.select("v", "id", "pos").join(placed.select("id", "block", "comp", "n"), "id").withColumn("n_behind", F.col("n") - F.col("pos") - 1)
    within = placed.groupBy("block").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select(F.col("block").alias("b1"), F.col("block").alias("b2"))
    pairs = written(pairs_of_blocks(meeting, percent).unionByName(within), "meeting")
    discard(entries)
    seen = written(placed.join(signs.select("id", "sign"), "id").groupBy("block").agg(F.collect_list(F.struct("id", "n", "comp", "sign")).alias("s")), "signed")
    either = lambda of, name, i: of.select(F.col("block").alias(f"b{i}"), F.col(name).alias(f"{name}{i}"))
    pairs = written(possible(pairs.join(either(seen, "s", 1), "b1").join(either(seen, "s", 2), "b2"), percent), "pairs")
    discard(seen)
    needed = pairs.select(F.col("b1").alias("block"), F.explode("i1").alias("id")).union(pairs.select("b2", F.explode("i2"))).distinct()
    member = F.struct("id", "comp", "text")
    wanted = written(placed.join(needed, ["block", "id"], "left_semi").select("id", "block", "comp"), "wanted")
    texts = written(source(documents).join(wanted.select("id").distinct(), "id"), "texts")
    blocks = written(wanted.join(texts, "id").groupBy("block").agg(F.collect_list(member).alias("m")), "blocks")
    discard(texts)
    nobody = F.expr(f"cast(array() as array<{MEMBER}>)")
    crossed = pairs.filter("b1 <> b2").join(either(blocks, "m", 1), "b1").join(either(blocks, "m", 2), "b2")
    inner = pairs.filter("b1 = b2").join(either(blocks, "m", 1), "b1").select(nobody.alias("head"), F.col("m1").alias("own"))
    further = tile_links(crossed.select(nobody.alias("none"), "m1", "m2"), k, percent).unionByName(tile_links(inner, k, percent))
    far = written(further, "far")
    discard(blocks)
    # the tiles compared members by component, so these links are few and between components
    joined = connected_components(far).withColumnsRenamed({"node": "c", "comp": "least"})
    final = placed.select(F.col("id").alias("node"), "comp").join(joined, F.col("comp") == F.col("c"), "left").select("node", F.coalesce("least", "comp").alias("comp"))
    # a table of its own, so that its join can split a class that many documents share
    return members, written(final.groupBy("node").agg(F.min("comp").alias("comp")), "final")


def components(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    members, comp = linked(documents, k, percent)
    found = members.join(comp, F.col("rep") == F.col("node"), "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "rep").alias("c"))
    nameless = source(documents.filter(F.col("doc_id").cast("long").isNull())).select("id", F.lit(True).alias("nameless")).distinct()
    if nameless.isEmpty():
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("c").alias("component_id"))
    named = written(found.join(nameless, "id", "left").select(F.when(F.col("nameless").isNull(), F.col("id")).alias("doc_id"), "n_shingles", "c"), "named")
    return named.join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays.

    Of rows that repeat doc_id and text one stays; documents without words or without an id stay.
    """
    found = components(documents, k, percent).filter("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("keeper"))
    gone = found.filter("keeper <> doc_id").select(F.col("doc_id").alias("gone"))
    # whole rows ride in one column, so no name of theirs can clash
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    kept = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    once = Window.partitionBy("id", "h").orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("row.*")
