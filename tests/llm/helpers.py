"""Documents and brute-force versions."""

import random
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def lower_words(text):
    return WORD.findall((text or "").encode().lower())


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + rng.randrange(vocabulary) % 6)) for _ in range(n))


def edge_documents(spark):
    """Nulls, empty and odd texts, repeated rows, a long text, and columns with names that operators use themselves."""
    long = "word " * 30_000 + "é" * 5_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "Two words"), (None, None), (None, "a text without an id"), (6, long), (7, "ÀÉ \x1c ok\x00 <|endoftext|> İ ſ "), (8, "a\r\nb c d")]
    rows = [(i, t, None if i == 5 else "en", None if i == 4 else "s", 0, "x", 1, 2, "y", 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n int, rep long, row string, comp long, k_id long, gone long")


def empty(df):
    return df.limit(0)


def jaccard_components(docs, k=4, percent=85):
    sets = {}
    for i, t in docs:
        w = lower_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(ids[a]), root(ids[b])
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(texts, depth=200):
    """(removed flags) of each text by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raw for i in range(len(r) - depth + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        out.append((r, gone))
    return out


def mutated(rng, text, share):
    return " ".join(w + "q" if rng.random() < share else w for w in text.split())


def corpus(seed=5, base=25, copies=4):
    """Texts with near copies of different strength, exact copies and shared passages."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 150)) for _ in range(base)]
    passage = prose(rng, 70)
    out = list(texts)
    for t in texts[: base // 2]:
        out += [mutated(rng, t, rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(rng.randrange(copies))]
    for _ in range(6):
        out.append(prose(rng, 40) + " " + passage + " " + prose(rng, 40))
    rng.shuffle(out)
    return list(enumerate(out))


def crc(raw):
    return zlib.crc32(raw)
