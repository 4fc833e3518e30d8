"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows whose crc32(doc_id) mod 5 is 0 are held out.  Of the others at most ``SAMPLE`` (a hash of
the text decides, so copies stay together) are used: one half gives the lexicon, the words and word
beginnings that mark toxic texts, counted by Spark; the other half trains the trees.  Isotonic
regression on their cross-fitted margins maps margins to probabilities.  Everything learned is small
(``TERMS`` terms, ``TREES`` trees of ``DEPTH``) and goes to the tasks, which score whole texts.

A score depends on the text only.

Edge cases: null and empty texts have all features 0 and a score like any other; documents without a
label are scored; labels without a document, and null labels, are left out; with fewer than ``LEAST``
labelled rows of either kind the score is the share of toxic rows; a null doc_id is not held out;
very long texts are scored whole; texts with equal features have equal scores; repeated rows give repeated
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mapped, row_groups

SAMPLE, LEAST, TERMS, LEAST_SUPPORT = 20_000, 8, 400, 3
TREES, DEPTH, RATE, BINS, LEAF, L2 = 80, 3, 0.15, 32, 5, 1.0
BEGINNING = 5

# Common insults and second-person pronouns of four languages.
INSULTS = "idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown ugly fool jerk filth vermin imbecile crétin abruti connard minable ordure nul débile dummkopf trottel abschaum dreck widerlich versager blöd idiota estúpido imbécil basura asqueroso patético payaso escoria".split()
SECOND = "you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted tus vosotros".split()

LETTERS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789\n\t\r«»¿¡“”’‘…–—"})
DISGUISED = re.compile(r"\b(?=[\w@$*!]*[A-Za-z])[A-Za-z]+[0-9@$*!]+[A-Za-z][\w@$*!]*")
DISGUISE = str.maketrans("013457@$!", "oleastasi")
REPEATED = re.compile(r"([A-Za-z])\1\1")
PUNCTUATION = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>@^~="
NAMES = ("insults", "terms", "heaviest_term", "weight_of_terms", "hits", "second_person", "near_second_person", "capitals", "exclamations", "questions", "punctuation", "symbols", "disguised", "repeated_letters", "words", "beginnings")


class Features:
    """Dense features of a text, given the learned terms (word, or beginning with a dash, -> weight)."""

    def __init__(self, terms: dict[str, float]):
        self.words = {t: w for t, w in terms.items() if not t.endswith("-")}
        self.beginnings = {t[:-1]: w for t, w in terms.items() if t.endswith("-")}
        self.insults = frozenset(INSULTS)
        self.second = frozenset(SECOND)

    def of(self, raw: bytes) -> list[float]:
        if not raw:
            return [0.0] * len(NAMES)
        text = raw.decode("utf-8", "replace")
        words = text.lower().translate(LETTERS).split()
        disguised = DISGUISED.findall(text)
        words += [w.lower().translate(DISGUISE).replace("*", "") for w in disguised]
        n = max(1, len(words))
        insult = [w in self.insults for w in words]
        insults = sum(insult)
        weights = [self.words[w] for w in words if w in self.words] if self.words else []
        begun = [self.beginnings[b] for b in [w[:BEGINNING] for w in words] if b in self.beginnings] if self.beginnings else []
        second = sum(map(self.second.__contains__, words))
        near = 0
        if second and (insults or weights):
            marked = [i for i, w in enumerate(words) if insult[i] or w in self.words]
            near = sum(any(x in self.second for x in words[max(0, i - 3) : i + 4]) for i in marked)
        size = max(1, len(raw))
        capitals = sum(map(str.isupper, text.split()))
        count = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
        return [insults / n, len(weights) / n, max(weights, default=0.0), sum(weights) / n, math.log1p(insults + len(weights)), second / n, near / n, capitals / n,
                count(b"!"), count(b"?"), count(PUNCTUATION), count(SYMBOLS), len(disguised) / n, len(REPEATED.findall(text)) / n, math.log1p(len(words)), len(begun) / n]


class Trees:
    """Gradient-boosted trees of logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = self.binned(x)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(rate / (1 - rate))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, value, leaf = self.grow(bins, p - y, p * (1 - p))
            self.trees.append((feature, cut, value))
            margin += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Level by level; node k has the children 2k + 1 and 2k + 2; feature -1 passes all rows left."""
        inner = 2**DEPTH - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                if len(rows) >= 2 * LEAF:
                    gs, hs = g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + L2)
                    for f in range(bins.shape[1]):
                        b = bins[rows, f]
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, BINS + 1))[:-1] for w in (gs, hs, None))
                        gain = gl**2 / (hl + L2) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + L2) - whole
                        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                        c = int(np.argmax(gain))
                        if gain[c] > best:
                            best, feature[k], cut[k] = gain[c], f, c
                right = (bins[rows, feature[k]] > cut[k]) if feature[k] >= 0 else np.zeros(len(rows), bool)
                node[rows] = 2 * k + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        return feature, cut, value, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (bins[rows, f] > cut[node]))
            out += value[node - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: points (margin, probability) of the rising fit."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([1.0, t, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, z = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + z]
    w, s, z = np.array(pools).T
    return z / w, s / w


class Model:
    def __init__(self, terms: dict[str, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.features, self.trees, self.points, self.share = Features(terms), trees, points, share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([self.features.of(t) for t in texts]))
        # a little of the margin itself keeps the order within a flat stretch of the fit
        return 0.998 * np.interp(margin, *self.points) + 0.002 / (1 + np.exp(-margin))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned_terms(rows: DataFrame) -> dict[str, float]:
    """The TERMS words and beginnings that speak most for a toxic text, by documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_groups(batches):
            for t, y in zip(texts, batch.column(0).to_pylist()):
                words = set(t.decode("utf-8", "replace").lower().translate(LETTERS).split())
                terms = list(words | {w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING})
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([y] * len(terms), pa.int32())], names=["term", "y"])

    counts = mapped(rows.select("y", "text"), run, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    toxic, clean = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    weight = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (clean + 1))
    least = max(LEAST_SUPPORT, toxic // 200)
    found = counts.filter(F.col("a") >= least).withColumn("w", weight).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.log1p("a")), "term").limit(TERMS)
    return {r["term"]: float(r["w"]) for r in found.select("term", "w").collect()}


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).dropna()
    n = known.count()
    rows = documents.select("doc_id", "text").join(known, "doc_id")
    draw = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1_000_000))
    rows = rows.withColumn("_draw", draw).filter(F.col("_draw") < int(1_000_000 * min(1.0, 0.95 * sample / max(n, 1))))
    terms = learned_terms(rows.filter(F.col("_draw") % 2 == 0))
    words = Features(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_groups(batches):
            x = pa.array([words.of(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["y", "_draw", "x"])

    half = mapped(rows.filter(F.col("_draw") % 2 == 1).select("y", "_draw", "text"), run, "y int, _draw long, x array<double>").orderBy("_draw", "y").limit(sample).collect()
    y = np.array([r[0] for r in half], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if min(y.sum(), len(y) - y.sum()) < LEAST:
        return Model(terms, None, None, min(share, 0.49))
    x, fold = np.array([r[2] for r in half]), np.array([r[1] // 2 % 3 for r in half])
    margin = np.zeros(len(y))
    for k in range(3):
        if (fold == k).any() and (fold != k).any():
            margin[fold == k] = Trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(terms, Trees(x, y), isotonic(margin, y), share)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_groups(batches):
            s = np.clip(model.scores(texts), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return mapped(kept, run, "doc_id long, held_out boolean, score double, predicted int")
