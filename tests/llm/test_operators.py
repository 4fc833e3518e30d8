"""Each operator against brute force, and on edge cases."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, htmltree, jaccard, licenses, packing, quality, queries, repeats, sharding, suffixes, toxicity, warc
from tests.llm import helpers as H
from tests.oracle import same


@pytest.fixture(scope="module")
def odd(spark):
    return H.edge_documents(spark)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


# --- 1 ------------------------------------------------------------------------------------------------


def test_html_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_html(spark, sf).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split())
        assert got[r.page_id] == (text, len(text))


def test_html_held_out():
    rng, model = random.Random(99), htmltree.default_model()
    right = found = wanted = 0
    for _ in range(150):
        nodes, states = htmltree.labelled(htmltree.labelled_page(rng))
        for n, s, m in zip(nodes, states, model.marginals(nodes)):
            assert abs(sum(m) - 1) < 1e-6
            if n.text:
                keep = m[1] >= m[2] and (m[1] >= m[0] or n.tag == "#text")
                right += n.letters * (keep and s == 1)
                found += n.letters * keep
                wanted += n.letters * (s == 1)
    assert right / found > 0.93 and right / wanted > 0.95


@pytest.mark.parametrize("tag", "button select object math svg noscript template head".split())
def test_html_unclosed_hides_nothing(tag):
    text = lambda page: " ".join(n.text for n in htmltree.parse(page) if n.text)
    assert "One two." in text(f"<html><{tag} class=x><div><article><p>One two.</p></article></div>")
    if tag not in ("template", "head"):
        assert "One two." in text(f"<div><{tag}></div><article><p>One two.</p></article><{tag}>x</{tag}>")
    shown = text(f"<article><p>One <{tag}>x</{tag}> two.</p></article>")
    assert shown == ("One x two." if tag in ("object", "math", "head", "noscript") else "One two.")
    assert text(f"<{tag}><title>t</title><script>s</script></{tag}><p>One</p>") == "One"


def test_html_marginals_are_exact():
    """Sum-product against the sum over all states of a small tree."""
    from itertools import product

    model = htmltree.default_model()
    nodes = htmltree.parse("<body><div class='post'><p>Some text here. And more.</p><p>More.</p></div><footer>x</footer></body>")
    node = [model.potentials(f) for f in htmltree.features(nodes)]
    node[0] = [1.0, 1e-9, 1e-9]
    total = np.zeros((len(nodes), 3))
    for states in product(range(3), repeat=len(nodes)):
        p = 1.0
        for i, s in enumerate(states):
            p *= node[i][s]
            if i:
                p *= (model.edge.get(htmltree.kind(nodes[i])) or model.edge["*"])[states[nodes[i].parent]][s]
        for i, s in enumerate(states):
            total[i, s] += p
    assert np.allclose(total / total.sum(axis=1, keepdims=True), np.array(model.marginals(nodes)), atol=1e-6)


def test_html_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>a&nbsp;b<br>c &lt;d&gt;</p><script>no</script><style>no"), (4, "u", "<div>" * 3000 + "deep text." + "</div>" * 3000), (5, "u", "<b>unclosed <i>text. Here it is"), (5, "u", "<b>unclosed <i>text. Here it is"), (6, "u", "<!-- x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in htmltree.extract(df).collect()}
    assert got[1] == got[2] == got[6] == "" and got[3] == "a b c <d>" and "unclosed text. Here it is" == got[5] and htmltree.extract(df).count() == 7
    assert htmltree.extract(H.empty(df)).count() == 0


def test_html_long_and_deep(spark):
    """A page of a megabyte is read whole; stray end tags cost a step each."""
    body = "".join(f"<p>Sentence number {i} of the story. It goes on.</p>" for i in range(20_000))
    page = f"<html><body><article>{body}</article></body></html>"
    row = htmltree.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row.n_chars == len(row.text) == sum(len(f"Sentence number {i} of the story. It goes on.") + 1 for i in range(20_000)) - 1
    start = time.perf_counter()
    htmltree.parse("<div>" * 20_000 + "</section>" * 20_000 + "x")
    assert time.perf_counter() - start < 3


# --- 2 ------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out))
    out = got[got.held_out]
    rank, pos = out.score.rank(), out.toxic == 1
    n, m = pos.sum(), (~pos).sum()
    assert (rank[pos].sum() - n * (n + 1) / 2) / (n * m) > 0.97
    assert (out.predicted == out.toxic).mean() > 0.97 and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (99, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(H.empty(odd), toxicity.train(H.empty(odd), H.empty(labels))).count() == 0
    x = np.repeat(np.arange(40.0)[:, None], 16, axis=1)
    y = (np.arange(40) > 20).astype(float)
    trees = toxicity.Trees(x, y)
    assert ((trees.margin(x) > 0) == (y == 1)).all()
    at, p = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert p.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.5, 4.0]


# --- 3 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_brute_force(spark, k, percent):
    docs = H.corpus(seed=k) + [(1000, None), (1001, ""), (1002, "just two"), (1003, "JUST two"), (1004, "just three words")]
    want = H.jaccard_components(docs, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, docs), k, percent).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_jaccard_large_group(spark):
    """More near copies than a tile holds, with some that only meet through others."""
    rng = random.Random(3)
    base = H.prose(rng, 60)
    docs = [(i, H.mutated(rng, base, 0.012)) for i in range(150)] + [(200 + i, H.prose(rng, 50)) for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, docs)).collect()}
    assert got == H.jaccard_components(docs)


def test_jaccard_order_keeps_answers(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    docs = H.corpus(seed=8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, docs)).collect()}
    assert got == H.jaccard_components(docs)


def test_jaccard_edges(spark, odd):
    got = jaccard.components(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id == 1} == {1}
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 1
    assert jaccard.components(H.empty(odd)).count() == 0 and jaccard.one_of_each(H.empty(odd)).count() == 0


def test_jaccard_without_ids(spark):
    """Rows without doc_id neither keep the copies of their group nor tie groups together."""
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = documents(spark, [(3, one), (5, one), (None, one), (7, two), (9, two), (None, two), (None, "u v w x y")])
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.components(docs).filter("component_id is not null").collect()) == [(0, 3), (0, 7), (3, 3), (5, 3), (7, 7), (9, 7)]
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(docs).collect()) == [0, 0, 0, 3, 7]


def test_jaccard_words_made_to_clash(spark):
    """Words of 1,024 letters whose polynomial hashes modulo 2^64 are equal for every odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, [(1, one), (2, other)])).collect()}
    assert got == {1: (1, 1), 2: (1, 2)}


def test_tile_verifies_words():
    """A link that only the hashes show joins nothing."""
    s = np.arange(10, dtype=np.uint64)
    comp, side = np.array([1, 2]), np.array([3, 3])
    assert jaccard.join_tile([s, s], [b"a b c d e", b"a b c d e"], side, comp, 4, 85) == [(2, 1)]
    assert jaccard.join_tile([s, s], [b"a b c d e", b"v w x y z"], side, comp, 4, 85) == []


def test_derived_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 80, rng.integers(0, 60)).astype(np.uint64)) for _ in range(30)]
    for order in (sets, [sets[0][:0], *sets], [*sets, *sets]):
        assert (jaccard.overlaps(order) == [[len(np.intersect1d(a, b)) for b in order] for a in order]).all()


def test_signatures_lose_no_link():
    rng = np.random.default_rng(2)
    for n in (1, 30, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in (0, n // 20, n // 7, n // 2):
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64))))
            x, y = jaccard.signature(a), jaccard.signature(b)
            w = min(len(x), len(y))
            bits = int(np.bitwise_count((jaccard.folded(x, w) ^ jaccard.folded(y, w)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b))
            if jaccard.links(len(np.intersect1d(a, b)), len(a), len(b), 85):
                assert jaccard.may_link(bits, len(a) + len(b), 85)


# --- 4 ------------------------------------------------------------------------------------------------


def test_quality_edges(spark, odd):
    got = {r.doc_id: r for r in quality.measure(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[7].n_words == len(H.words("ÀÉ \x1c ok\x00 <|endoftext|> İ ſ "))
    assert quality.measure(H.empty(odd)).count() == 0 and quality.keep(H.empty(odd)).count() == 0 and quality.keep(odd).columns == odd.columns


def test_quality_order_is_free(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = list(quality.RULES)
    a, b = (quality.measure(docs, o).select("doc_id", "kept").collect() for o in (order, order[::-1]))
    assert sorted(a) == sorted(b) and sorted(quality.rule_order(docs)) == sorted(order)


# --- 5 ------------------------------------------------------------------------------------------------


def check_shards(rows, shards=16):
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_sharding(spark, odd):
    rng = random.Random(1)
    rows = [(i, H.prose(rng, 3), f"s{min(rng.randrange(9), 3)}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df).collect()
    check_shards(got)
    for s in {r[2] for r in rows}:
        per = [sum(r.source == s for r in got if r.shard == k) for k in range(16)]
        assert max(per) - min(per) <= 2
    assert got[0].size == len(next(t for i, t, _ in rows if i == got[0].doc_id).encode()) + 1
    assert sorted(got) == sorted(sharding.interleave(df.repartition(7)).collect())
    mixed = sharding.interleave(odd).collect()
    check_shards(mixed)
    assert len(mixed) == odd.count() and {r.text_crc32 for r in mixed if r.doc_id in (1, 2)} == {0}
    assert sharding.interleave(H.empty(odd)).count() == 0


def test_sharding_brute_force(spark):
    """The whole order in one list: ranks within sources by the seeded hash, fractions, equal cuts."""
    rng = random.Random(5)
    rows = [(i, H.prose(rng, 2), rng.choice(["a", "a", "a", "b", None])) for i in range(701)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("string")).alias("k")).collect()}
    stratum = {i: "=" + s if s else "" for i, _, s in rows}
    placed = []
    for s in set(stratum.values()):
        own = sorted((i for i in stratum if stratum[i] == s), key=lambda i: ((keys[i] >> 20) % 2**44 % max(1, len(rows) // sharding.BUCKET_ROWS), keys[i]))
        placed += [((2 * r + 1) / (2 * len(own)), s, keys[i], i) for r, i in enumerate(own)]
    order = [x[3] for x in sorted(placed)]
    want, taken = {}, {}
    for place, i in enumerate(order):
        shard = place * 16 // len(rows)
        want[i] = (shard, taken.get(shard, 0))
        taken[shard] = taken.get(shard, 0) + 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df).collect()} == want


# --- 6 ------------------------------------------------------------------------------------------------


def test_packing(spark, sf, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 1_000_000, "text").toDF("doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    got = packing.pack(docs).collect()
    for r in got:
        assert any(len(part := ids[r.start : r.start + r.length]) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 for ids in texts[r.doc_id])
    assert sum(r.length for r in got) == sum(len(ids) for x in texts.values() for ids in x)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(H.empty(docs)).count() == 0



def test_words_asked_for_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 100)
    ids, learned = packing.Ids(packing.tokenizer_path()), []
    encode = ids.encode
    monkeypatch.setattr(ids, "encode", lambda text: (learned.extend(text.split(" ")), encode(text))[1])
    for k in range(8):
        new = " ".join("ab" + "".join(chr(97 + int(c)) for c in f"{60 * k + i:03d}") for i in range(60))
        texts = [f"\tthe {new}\u00a0x \x0b the", "", " \n", "the\x1cthe l'été\r\n1a\x0c_b \ue000 <|x|>  the", new]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of([t.encode() for t in texts])] == [encode(t) for t in texts]
    assert learned.count("the") == 1
    assert ids.of([]) == []


def test_words_and_their_parts_are_known_once():
    ids = packing.Ids(packing.tokenizer_path())
    text = "letters letters, Letters beta beta-letters 12"
    assert np.frombuffer(ids.of([text.encode()])[0], "<u4").tolist() == ids.encode(text)
    names = [k if isinstance(k, bytes) else k.encode() for held in vars(ids).values() if isinstance(held, packing.Recent) for k in held]
    assert len(names) == len(set(names)) and {b"letters", b"letters,", b"beta"} <= set(names)


def test_crossover_keeps_items():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 60) for _ in range(300)]
    a, b = (packing.best_fit(sizes, rng.sample(range(300), 300), 100) for _ in range(2))
    child = packing.mutate(packing.cross(a, b, sizes, 100, rng), sizes, 100, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and max(child.loads) <= 100
    best = packing.evolve(sizes, [], 5, 100)[0]
    assert max(best) + 1 <= len(packing.best_fit(sizes, list(range(300)), 100).bins)


def test_genetic_packing_improves():
    """Bins that can be filled to the last token: best fit leaves more of them than crossing does."""
    better = 0
    for seed in range(6):
        rng = random.Random(seed)
        sizes = []
        for _ in range(60):
            a, b = sorted(rng.sample(range(1, 100), 2))
            sizes += [a, b - a, 100 - b]
        rng.shuffle(sizes)
        first = packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 100)
        best = packing.grouped(packing.evolve(sizes, [], seed, 100, generations=20)[0], sizes)
        assert best.fitness(100) >= first.fitness(100) and sorted(i for b in best.bins for i in b) == list(range(len(sizes)))
        better += best.fitness(100) > first.fitness(100)
    assert better >= 3


def test_packing_against_all_packings():
    """The fewest bins of every way to pack a few pieces."""

    def fewest(sizes, capacity):
        best = len(sizes)

        def place(k, loads):
            nonlocal best
            if len(loads) >= best and k < len(sizes):
                return
            if k == len(sizes):
                best = min(best, len(loads))
                return
            for i in {x: i for i, x in enumerate(loads) if x + sizes[k] <= capacity}.values():
                place(k + 1, [*loads[:i], loads[i] + sizes[k], *loads[i + 1 :]])
            place(k + 1, [*loads, sizes[k]])

        place(0, [])
        return best

    rng = random.Random(3)
    for _ in range(25):
        sizes = sorted((rng.randrange(15, 70) for _ in range(11)), reverse=True)
        assert max(packing.evolve(sizes, [], 1, 100)[0]) + 1 == fewest(sizes, 100)


# --- 7 ------------------------------------------------------------------------------------------------


def leak_brute(doc, item):
    d, i = decontaminate.words_of((doc or "").encode()), decontaminate.words_of((item or "").encode())
    w = min(13, len(i))
    if len(i) < 8:
        return None
    for start in range(1 - len(i), len(d)):
        equal = [0 <= start + j < len(d) and d[start + j] == i[j] for j in range(len(i))]
        if any(sum(equal[j : j + w]) >= decontaminate.needed(w) for j in range(len(i) - w + 1)):
            return True
    return False


def test_decontamination_brute_force(spark):
    rng = random.Random(4)
    items = [(i, H.prose(rng, rng.choice([9, 15, 30, 40]))) for i in range(12)]
    docs = [(100 + i, H.prose(rng, 80)) for i in range(20)]
    for i, t in items:
        w = t.split()
        for share in (0, 0.1, 0.2, 0.3):
            hit = [x if rng.random() >= share else "zz" for x in w]
            docs.append((len(docs) + 500, " ".join([H.prose(rng, 10), *hit, H.prose(rng, rng.randrange(9))]).upper()))
        docs.append((len(docs) + 500, " ".join(w[: len(w) // 2])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), limit=60).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if leak_brute(t, x)}


def test_masks_hit_every_allowed_stretch():
    from itertools import combinations

    for window in range(8, 14):
        for n in range(window - decontaminate.needed(window) + 1):
            for gone in combinations(range(window), n):
                assert any(not {p + o for o in m} & set(gone) for m in decontaminate.MASKS for p in range(window - m[-1]))


def test_decontamination_of_short_items(spark):
    rng = random.Random(12)
    items = [(n, [f"w{n}x{j}" for j in range(n)]) for n in range(2, 8)]
    docs, want = [], set()
    for n, w in items:
        for gone in [(), *((j,) for j in range(n)), (0, n - 1)]:
            docs.append((len(docs), " ".join([H.prose(rng, 5), *("zz" if j in gone else x for j, x in enumerate(w)), H.prose(rng, 5)])))
            if sum(j not in gone for j in range(n)) >= decontaminate.needed(n):
                want.add((len(docs) - 1, n))
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "word word word word word word"), (4, "word word word word word word")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()} == {(6, 4)}
    assert decontaminate.leaks(odd, H.empty(items)).count() == 0 and decontaminate.leaks(H.empty(odd), items).count() == 0
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_decontamination_of_one_repeated_word(spark):
    """Every place of the text meets every place of the item; blocks are taken one after the other."""
    docs = documents(spark, [(1, "ha " * 3000), (2, "ha " * 6 + "no"), (3, "no " * 20)])
    items = spark.createDataFrame([(1, "ha " * 400), (2, "ho " * 30), (3, "no " * 15)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, limit=20).collect()}
    assert got == {(1, 1), (3, 3)} == {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if leak_brute(d.text, i.text)}


# --- 8 ------------------------------------------------------------------------------------------------


def test_licenses_brute_force(spark, odd):
    rng = random.Random(6)
    bits = [*licenses.BASE, "cc", "by", "general public", "license", "all rights", "reserved", "x1", "CC-BY", "General Public License.", "all all rights reserved reserved"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [(900, licenses.TEMPLATES["mit"][2]), (901, licenses.TEMPLATES["apache-2.0"][1].replace("software", "thing")), (902, "permission is hereby granted free")]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, docs)).collect()}
    for i, t in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(label, j) for p, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((j for _, j in at), default=None), max((j for _, j in at), default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in got[900].labels and "apache-2.0" in got[901].labels and got[902].labels == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(H.empty(odd)).count() == 0


def test_matching_statistics():
    rng = random.Random(7)
    templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(12)] for _ in range(3)]
    a = licenses.Automaton(templates)
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    grams = {tuple(t[i:j]) for t in templates for i in range(12) for j in range(i + 1, 13)}
    for i, (_, length) in enumerate(a.stream([a.vocabulary[w] for w in text])):
        assert length == max([n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in grams], default=0)


# --- 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [repeats.MOST, 1])
def test_repeats_brute_force(spark, most):
    docs = H.corpus(seed=9) + [(2000, "é" * 300), (2001, "x" * 700), (2002, None), (2003, ""), (2004, "y" * 199), (2005, "y" * 199), (2006, "z" * 200), (2007, "z" * 200)]
    got = {r.doc_id: r for r in repeats.remove_repeats(documents(spark, docs), most).collect()}
    for (i, _), (raw, gone) in zip(docs, H.without_repeats([t for _, t in docs])):
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert got[2007].n_removed == 200 and got[2005].n_removed == 0


def test_suffix_sort():
    rng = random.Random(11)
    for alphabet in (b"ab", b"abc", b"abcdefgh"):
        for _ in range(15):
            text = np.array([rng.choice(alphabet) for _ in range(rng.randrange(1, 900))], np.uint8)
            raw = text.tobytes()
            order = suffixes.suffix_array(text).tolist()
            assert sorted(order) == list(range(len(raw)))
            keys = [raw[i : i + suffixes.DEPTH] for i in order]
            assert keys == sorted(keys)


def test_repeats_edges(spark, odd):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    two = documents(spark, [(1, "ab" * 150), (1, "ab" * 150), (None, "cd" * 150), (1, "".join(chr(97 + i % 26) + str(i) for i in range(99)))])
    assert sorted(r.n_removed for r in repeats.remove_repeats(two).collect()) == [0, 300, 300, 300]
    left = repeats.strip_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count() and left.filter("n_chars <> length(text)").count() == 0
    assert repeats.remove_repeats(H.empty(odd)).count() == 0 and repeats.strip_repeats(H.empty(odd)).count() == 0


def test_repeats_in_long_texts(spark):
    """Texts longer than a piece, with repeats across the pieces' borders."""
    rng = random.Random(12)
    a = "".join(rng.choice("abcdefgh ") for _ in range(repeats.PIECE + 5_000))
    passage = a[repeats.PIECE - 300 : repeats.PIECE + 300]
    docs = [(1, a), (2, "start " + passage + " end"), (3, "x" * 150 + a[:220])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(documents(spark, docs)).collect()}
    assert got == {1: (820, 2), 2: (600, 1), 3: (220, 1)}


# --- 10 -----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 700, "\r\n\r\nWARC/1.1\r\n" + "b" * 1000
    rows = [(1, "u", big), (5, None, big), (5, "u", big), (3, "x\r\ny", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (None, "u", other), (10, "u", other), (11, "l" * 6000, other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "a")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = warc.parse_records(warc.read_archive(spark, path)).collect()
    assert len(got) == 10
    for r in got:
        sources = [(h or "").encode() for i, _, h in rows if i == r.page_id]
        assert bytes(r.payload) in sources and r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.stated_digest == f"sha1:{r.payload_digest}"
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (None, "revisit", 11), (10, "revisit", 11), (11, "response", None)}
    record = bytes(next(r.record for r in warc.read_archive(spark, path).collect() if r.page_id == 7))
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\nsmall\r\n\r\n")
    assert warc.archive_round_trip(H.empty(df)).count() == 0


def test_warc_long_payload_and_ids(spark, tmp_path):
    """Payloads of any length are one record; repeated page_ids have record ids of their own; dates are stated."""
    long = "<p>long</p>" * 300_000
    df = spark.createDataFrame([(1, "u", long), (2, "a\nb", "x"), (2, "v", "x")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"), "2020-02-02T02:02:02Z")
    records = warc.read_archive(spark, str(tmp_path / "w"))
    heads = [bytes(r.record).split(b"\r\n\r\n", 1)[0].decode() for r in records.collect()]
    assert len({re.search("WARC-Record-ID: (.*)", h)[1] for h in heads}) == 3 and all("WARC-Date: 2020-02-02T02:02:02Z\r\n" in h for h in heads)
    got = {(r.page_id, r.url, r.payload_bytes) for r in warc.parse_records(records).collect()}
    assert got == {(1, "u", len(long)), (2, "a%0Ab", 1), (2, "v", 1)}
