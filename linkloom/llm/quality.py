"""Quality rules as a short-circuit cascade.

A document is kept if it passes the base rule and every rule of ``RULES``.  The rules are a
conjunction, so their order cannot change a verdict, only its cost: each rule's cost and its share
of rejections are measured on a bounded sample (``SAMPLE`` documents with the smallest hashes), and
the rules then run by falling rejections per cost, stopping at the first that rejects.

The digest's counts (words, code points in words, symbols, repeated lines and words) are asked for
of every document, so they are found for all; what the cascade saves are the further measures.
Windows of three words are compared by 64-bit hashes within one document.

Edge cases: null and empty texts have no words and fail the base rule; very long texts are measured whole;
rules that reject equally much per cost keep their written order; repeated rows give repeated rows; an empty table gives no rows (the rules then keep their written order); extra columns are
ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WordHash, mapped, row_groups, shingle_hashes

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Documents on which the rules are timed; a bound on what reaches the driver.
SAMPLE = 200

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Doc:
    """A text and its base measures."""

    __slots__ = ("n_dup_lines", "n_repeat_words", "n_symbols", "n_lines", "n_words", "text", "word_chars", "words")

    def __init__(self, text: bytes, hashes: WordHash):
        self.text, self.words = text, text.split()
        self.n_words = len(self.words)
        # code points: every byte but the UTF-8 continuation bytes
        joined = np.frombuffer(b"".join(self.words), np.int8)
        self.word_chars = int(np.count_nonzero(joined > -65))
        self.n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeated(hashes.of(self.words)) if self.n_words > 3 else 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words


def repeated(words: np.ndarray, k: int = 3) -> int:
    """Words in windows of k words that occur twice or more."""
    windows = shingle_hashes(words, k)
    order = np.argsort(windows)
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(k):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


#: name -> does it reject?  Thresholds in whole percent.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 100 * d.n_symbols > 30 * d.n_words,
    "repeated_lines": lambda d: 100 * d.n_dup_lines > 50 * d.n_lines,
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words,
    "shouting": lambda d: 100 * sum(map(bytes.isupper, d.words)) > 50 * d.n_words,
    "exclamations": lambda d: 100 * d.text.count(b"!") > 50 * d.n_words,
    "one_word": lambda d: 100 * max(Counter(d.words).values()) > 30 * d.n_words,
}


def ordered(docs: list[Doc]) -> list[str]:
    """Names of the rules by falling rejections per second on ``docs``; ties keep the written order."""
    docs, gain = [d for d in docs if not d.base_failed], {}
    for name, rejects in RULES.items():
        start = time.perf_counter()
        hits = sum(map(rejects, docs))
        gain[name] = hits / max(time.perf_counter() - start, 1e-9)
    return sorted(RULES, key=lambda name: -gain[name])


def rule_order(documents: DataFrame, sample: int = SAMPLE) -> list[str]:
    # first only hashes: a task that ranked whole rows would send its own sample of texts to the driver
    top = documents.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = [] if top is None else documents.filter(F.xxhash64("doc_id") <= top).select("text").limit(sample).collect()
    hashes = WordHash()
    return ordered([Doc((r[0] or "").encode(), hashes) for r in rows])


def measure(documents: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rule that rejected, of every document."""
    order = rule_order(documents) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rules = WordHash(), [(name, RULES[name]) for name in order]
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])
        for batch, texts in row_groups(batches):
            rows = []
            for text in texts:
                d = Doc(text, hashes)
                by = "base" if d.base_failed else next((name for name, rejects in rules if rejects(d)), None)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, by == "base", by is None, by))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def keep(documents: DataFrame) -> DataFrame:
    """The documents that pass, whole rows; the verdict is taken where the row is, without a join."""
    order = rule_order(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rules = WordHash(), [RULES[name] for name in order]
        for batch, texts in row_groups(batches):
            docs = (Doc(t, hashes) for t in texts)
            yield batch.filter(pa.array([not d.base_failed and not any(r(d) for r in rules) for d in docs], pa.bool_()))

    return mapped(documents, run, documents.schema)
