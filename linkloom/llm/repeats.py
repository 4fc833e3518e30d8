"""Removal of repeated byte strings: every byte that a DEPTH-byte string covers which starts elsewhere too.

Comparing every suffix of a corpus would move DEPTH bytes for each byte of it.  Instead each string of
DEPTH bytes is filed under its anchor: of the K-byte strings in it, the one with the least hash, the
leftmost of equals.  Equal strings have equal anchors at equal distances, so only strings filed under
the same anchor hash have to be compared, and strings that follow each other mostly share an anchor:
they form one *segment*, about (DEPTH - K) / 2 strings, K to 2 DEPTH bytes.

1. Anchors of all texts are found (vectorised); a row is an anchor hash, a segment's 128-bit BLAKE2 digest
   and a place.
2. Anchor hashes that occur once are done.  Segments of one anchor with equal digests repeat as a whole.
3. Each different segment of an anchor is fetched once, and the segments of an anchor are sorted together
   by the two-stage suffix sort (``suffixes``), which marks the strings that they share.  The segments of an
   anchor with more than ``MOST`` of them do not go into one sort: their strings are counted by their bytes,
   with partial aggregation, so no task sees the whole group.  Results are equal.
4. Places are joined back to texts; covered bytes are removed.

Steps 2 and 3 aggregate before they shuffle, and joins read written tables whose small side has each key
once, so Spark can split hot keys.  Anchor hashes only file strings; what repeats is decided by digest for
whole segments and by bytes within them.

Edge cases: null text is empty; texts under DEPTH bytes are kept whole; rows that repeat doc_id and text
repeat each other's strings, and rows that share a doc_id only are told apart by a hash of their text; a
null doc_id is a value like others; an empty table gives no rows; extra columns are ignored.  Very long texts are searched in overlapping pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import BASES, CHUNK_BYTES, Powers, mapped, mix, row_groups, spans
from linkloom.llm.suffixes import DEPTH, repeated_starts
from linkloom.storage import discard, written

K = 32
WIDTH = DEPTH - K + 1
#: Different segments of one anchor that are sorted in one block; bytes of a block of several anchors.
MOST, BLOCK_BYTES = 20_000, 1 << 20
#: Bits of a packed anchor that hold its place, and so the most places in one step.
PLACE_BITS = 24
PIECE = CHUNK_BYTES

KEYS = ["k_id", "k_text"]
#: An anchor and the digest of a segment of it.
SEGMENT = ["h", "g1", "g2"]


class Anchors:
    """Finds (anchor hash, segment digest, piece, first string, last string) of the segments of some pieces."""

    def __init__(self) -> None:
        self.powers = Powers(BASES[0])

    def prefix(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers.upto(len(data) + 1)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64))), down

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        joined = b"".join(pieces)
        data = np.frombuffer(joined, np.uint8).astype(np.uint64)
        n = len(data)
        ends = np.cumsum(sizes)
        string = np.zeros(n + 1, np.int8)  # from where DEPTH bytes lie in one piece
        np.add.at(string, (ends - sizes)[sizes >= DEPTH], 1)
        np.add.at(string, (ends - DEPTH + 1)[sizes >= DEPTH], -1)
        at = np.flatnonzero(np.cumsum(string[:-1]))
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), *[np.zeros(0, np.int64)] * 3
        sums, down = self.prefix(data)
        hashes = mix((sums[K:] - sums[:-K]) * down[: n - K + 1])
        mask = np.uint64((1 << PLACE_BITS) - 1)
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        # sliding minimum: of the rest of one block of WIDTH and the beginning of the next
        rows = -(-len(packed) // WIDTH) + 1
        grid = np.full(rows * WIDTH, np.uint64(2**64 - 1))
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, WIDTH)
        rest = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        begun = np.minimum.accumulate(grid, axis=1).ravel()
        anchor = (np.minimum(rest[at], begun[at + WIDTH - 1]) & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
        digests = [hashlib.blake2b(joined[a : b + DEPTH], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())]
        segment = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        piece = np.searchsorted(ends, lo, side="right")
        begin = (ends - sizes)[piece]
        return hashes[anchor[first]], segment, piece, lo - begin, hi - begin


def keyed(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text with the two columns that tell rows apart."""
    return documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64("text").alias("k_text"), *more)


def anchors(documents: DataFrame) -> DataFrame:
    names = [*SEGMENT, *KEYS, "lo", "hi"]
    types = [pa.int64()] * 5 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors()
        for batch, texts in row_groups(batches):
            pieces = [(i, s, t[s : s + PIECE + DEPTH - 1]) for i, t in enumerate(texts) for s in range(0, max(len(t) - DEPTH + 1, 0), PIECE)]
            ids, rk = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
            for a, b in spans([len(p[2]) for p in pieces]):
                h, g, piece, lo, hi = finder.find([p[2] for p in pieces[a:b]])
                row = np.array([p[0] for p in pieces[a:b]])[piece]
                shift = np.array([p[1] for p in pieces[a:b]])[piece]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h.view(np.int64), g[:, 0], g[:, 1], ids[row], rk[row], lo + shift, hi + shift), types)], names=names)

    source = keyed(documents).filter(F.octet_length("text") >= DEPTH).select(*KEYS, "text")
    return mapped(source, run, "h long, g1 long, g2 long, k_id long, k_text long, lo int, hi int")


def cut(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(h, g1, g2, n, segment bytes) of one place of each different segment."""
    lists = places.groupBy(*KEYS).agg(F.collect_list(F.struct(*SEGMENT, "n", "lo", "hi")).alias("at"))
    types = [pa.int64()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_groups(batches):
            rows = [(x["h"], x["g1"], x["g2"], x["n"], t[x["lo"] : x["hi"] + DEPTH]) for t, at in zip(texts, part.column(0).to_pylist()) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=[*SEGMENT, "n", "segment"])

    return mapped(lists.join(keyed(documents), KEYS).select("at", "text"), run, "h long, g1 long, g2 long, n long, segment binary")


def runs(places: np.ndarray) -> list[dict[str, int]]:
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1)
    return [{"a": a, "b": b} for a, b in zip(places[np.append(0, breaks + 1)].tolist(), places[np.append(breaks, len(places) - 1)].tolist())]


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def sorted_blocks(segments: DataFrame) -> DataFrame:
    """(h, g1, g2, ranges of repeated strings): suffix sorts of blocks of whole anchors."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_starts([r[3] for r in rows])
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([runs(f) for f in found], RANGES)], names=[*SEGMENT, "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*[batch.column(i).to_pylist() for i in range(4)]))
        block, size = [], 0
        for _, group in groupby(stream, key=lambda r: r[0]):
            rows = list(group)
            n = sum(len(r[3]) for r in rows)
            if block and size + n > BLOCK_BYTES:
                yield solve(block)
                block, size = [], 0
            block, size = block + rows, size + n
        if block:
            yield solve(block)

    ordered = segments.select(*SEGMENT, "segment").repartition("h").sortWithinPartitions("h")
    return mapped(ordered, run, "h long, g1 long, g2 long, ranges array<struct<a:int,b:int>>")


def counted_strings(segments: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: strings counted by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, s in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                at = range(len(s) - DEPTH + 1)
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(at), pa.int64()) for k in key], pa.array(at, pa.int32()), pa.array([s[i : i + DEPTH] for i in at], pa.binary())], names=[*SEGMENT, "i", "s"])

    strings = written(mapped(segments.select(*SEGMENT, "segment"), run, "h long, g1 long, g2 long, i int, s binary"), "strings")
    twice = written(strings.groupBy("s").count().filter("count > 1").select("s"), "twice")
    return strings.join(twice, "s").groupBy(*SEGMENT).agg(F.collect_list(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("ranges"))


def repeated_places(documents: DataFrame, most: int = MOST) -> DataFrame:
    """(k_id, k_text, ranges): from where to where repeated strings start in each text that has some."""
    found = written(anchors(documents), "anchors")
    g = F.struct("g1", "g2")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min(g) == F.max(g)).alias("uniform")).filter("n > 1").select("h", "uniform")
    again = written(again, "again")  # a table of its own, so that the join can split a hot anchor
    shared = written(found.join(again, "h"), "shared")
    discard(found)
    discard(again)
    mixed = shared.filter(~F.col("uniform"))
    kinds = mixed.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS, "lo", "hi")).alias("place")).select(*SEGMENT, "n", "place.*")
    segments = written(cut(documents, kinds), "segments")
    hot = written(segments.groupBy("h").count().filter(F.col("count") > most).select("h"), "hot")
    parts = sorted_blocks(segments.join(hot, "h", "left_anti"))
    if not hot.isEmpty():
        parts = parts.unionByName(counted_strings(segments.join(hot, "h", "left_semi")))
    whole = segments.filter("n > 1").select(*SEGMENT)
    inner = written(parts.filter(F.size("ranges") > 0).join(whole, SEGMENT, "left_anti"), "inner")
    everywhere = F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("lo")).cast("int").alias("a"), (r["b"] + F.col("lo")).cast("int").alias("b")))
    places = (
        shared.filter("uniform").select(*KEYS, everywhere.alias("r"))
        .unionByName(mixed.join(whole, SEGMENT).select(*KEYS, everywhere.alias("r")))
        .unionByName(mixed.join(inner, SEGMENT).select(*KEYS, shifted.alias("r")))
    )
    return places.groupBy(*KEYS).agg(F.flatten(F.collect_list("r")).alias("ranges"))


def covered(ranges: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that the strings starting in ``ranges`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + DEPTH) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for span in gone for x in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_groups(batches):
            rows = []
            for text, ranges in zip(texts, batch.column(2).to_pylist()):
                gone = covered(ranges)
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(text, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, [pa.int64()] * 3 + [pa.string()])]], names=names)

    joined = keyed(documents).join(repeated_places(documents, most), KEYS, "left")
    return mapped(joined.select("doc_id", "text", "ranges"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(documents: DataFrame, most: int = MOST) -> DataFrame:
    """The documents without the repeated bytes, and n_chars anew; halves of a character that was cut go too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in row_groups(batches):
            texts = [kept_bytes(t, covered(r)).decode("utf-8", "ignore") for t, r in zip(raw, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string())], names=["rest", "left"])

    # the other columns ride in one, so no name of theirs can clash
    rest = documents.schema.__class__([f for f in documents.schema if f.name != "text"])
    rows = keyed(documents, F.struct(*[F.col(f"`{f.name}`") for f in rest]).alias("rest"))
    joined = rows.join(repeated_places(documents, most), KEYS, "left").select("text", "ranges", "rest")
    left = mapped(joined, run, f"rest {rest.simpleString()}, left string")
    made = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return left.select(*[made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in documents.columns])
