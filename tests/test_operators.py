"""Hand-made graphs and rows with known answers."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom import model
from linkloom.functions import keys as K
from linkloom.operators import cliques, components, compound, curate, editing, events, jobs, linking, neighborhood, paths, reports, resolve, search, twins
from linkloom.plans import derived, graph
from linkloom.sources import formats, loaders, sinks
from linkloom.storage import scratch
from linkloom.streaming import ingest


@pytest.fixture(scope="module")
def core(spark):
    data = {
        1: {"I_CAS": "1-2-3 2-1-3 3-1-2 3-2-1", "I_CID": "11 22 33 44", "N_Name": "one two three"},
        2: {"I_CAS": "1-2-4 4-2-1 2-1-3", "I_CID": "1 11 2 3 33 4", "N_Name": "one four five"},
        3: {"N_Name": "one three four five"},
        4: {"I_CAS": "3-2-3 5-4-3"},
    }
    rows = [(e, k, v) for e, ks in data.items() for k, vs in ks.items() for v in vs.split()]
    return spark.createDataFrame(rows, "entity_id long, key string, value string")


def test_core_graph(core):
    comp = components.incidence_components(core)
    sizes = [r["size"] for r in components.component_sizes(comp).collect()]
    assert sorted(sizes) == [1, 3]
    assert linking.shared_value_edges(core).count() == 9
    assert core.filter("key = 'I_CID' and value = '11'").count() == 2
    assert linking.find_any(core, "N_Name", ["one", "foobar"]).count() == 3
    assert [r[0] for r in linking.find_all(core, "N_Name", ["four", "five"]).orderBy("entity_id").collect()] == [2, 3]
    edges = linking.shared_value_edges(core)
    path = paths.bfs_path(edges, 1, 3, ["N_Name"]).first()[0]
    assert path == [1, 3]
    assert paths.bfs_path(edges, 1, 4).count() == 0


def test_deletion_splits(core):
    left = core
    for k, v in (("N_Name", "one"), ("N_Name", "three")):
        left = curate.delete_value(left, k, v)
    for cas in ("2-1-3",):
        left = curate.delete_value(left, "I_CAS", cas)
    left = left.filter("key <> 'I_CID'")
    assert sorted(r["size"] for r in components.component_sizes(components.incidence_components(left)).collect()) == [1, 1, 2]


def test_cliques(spark):
    rows = [(e, k, f"{k}1") for e in (1, 2, 3) for k in ("I_CAS", "I_UNII", "N_Name")] + [(4, "I_CAS", "I_CAS1")]
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    found = {(tuple(r["members"]), tuple(r["keys"])) for r in cliques.value_cliques(inc).collect()}
    assert found == {((1, 2, 3), ("I_UNII", "N_Name")), ((1, 2, 3, 4), ("I_CAS",))}
    assert sorted(len(r["members"]) for r in cliques.maximal(cliques.value_cliques(inc)).collect()) == [4]
    assert cliques.high_confidence(cliques.value_cliques(inc)).count() == 0
    keys = {tuple(r["members"]): r["keys"] for r in cliques.propagate_keys(cliques.value_cliques(inc)).collect()}
    assert keys[(1, 2, 3)] == ["I_CAS", "I_UNII", "N_Name"]
    assert sorted(map(tuple, cliques.bron_kerbosch({1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}))) == [(1, 2, 3), (3, 4)]


def test_delta_and_equality(spark):
    one = spark.range(1)
    a = lambda s: F.array(*[F.lit(x) for x in s.split()])
    v1, v2, v3 = a("one two three four five six"), a("two five nine ten"), a("seven")
    r = one.select(K.delta(v2, v1).alias("p"), K.delta(v1, v2).alias("q"), K.delta(v3, v1).alias("r"), K.delta(v1, v1).alias("s"), K.same_set(a("x y"), a("y")).alias("t"), K.same_set(a("y"), a("y y")).alias("u"), K.same_set(a("x y"), a("y x")).alias("v")).first()
    assert (len(r.p["values"]), len(r.q["values"]), r.r["state"], r.s["state"], r.t, r.u, r.v) == (2, 4, "NO_CHANGE", "NULL", False, True, True)


def test_key_functions(spark):
    df = spark.createDataFrame([("ab 123-45-6 and 99-11-1 \"123-45-6\"", "a.1.x"), (None, None)], "t string, s string")
    r = df.select(K.regex_values(F.col("t"), r"\d+-\d+-\d").alias("m"), K.source_label(F.col("s")).alias("l"), K.long_tokens(F.col("t")).alias("n")).collect()
    assert r[0].m == ["123-45-6", "99-11-1"] and r[0].l == "S_A_1" and r[0].n == []
    assert r[1].m is None and r[1].l is None
    assert model.keys_between(5, 0) == ["H_SHA1", "H_SHA256", "R_activeMoiety"] and "I_CID" in model.keys_of_type("long")


def test_similarities(core):
    edges = linking.shared_value_edges(core)
    v = {(r.src, r.dst): r.similarity for r in neighborhood.value_jaccard(core, edges).collect()}
    assert v[(2, 1)] == round(4 / (11 + 12 - 4), 6)
    s = {(r.src, r.dst): r.similarity for r in neighborhood.structural_similarity(edges).collect()}
    assert s == {(2, 1): 1.0, (3, 1): 1.0, (3, 2): 1.0}


def test_intervals(spark):
    rows = [(1, "a", "2000-01-01", "2001-01-01"), (2, "a", "2000-02-01", "2000-03-01"), (3, "a", "2000-02-01", None), (4, "b", "2000-02-01", "2000-03-01"), (5, "b", "2000-02-01", "2000-03-01")]
    df = spark.createDataFrame(rows, "k int, g string, s string, e string").withColumns({"s": F.col("s").cast("date"), "e": F.col("e").cast("date")})
    assert sorted(r.k for r in events.undominated(df, ["g"], "s", "e", "k").collect()) == [1, 3, 4]


def test_guarded_classes(spark):
    entities = spark.createDataFrame([(1, 1, "x", True), (2, 1, "x", False), (3, 1, "y", False), (4, 1, None, True)], "entity_id long, comp long, guard string, is_root boolean")
    edges = spark.createDataFrame([(2, 1, "I_UNII"), (3, 2, "N_Name"), (4, 1, "I_CAS"), (4, 3, "N_Name")], "src long, dst long, key string")
    got = {r.entity_id: r.cls for r in resolve.guarded_classes(entities, edges).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[4]
    roots = {r.root: r["rank"] for r in resolve.class_root(resolve.guarded_classes(entities, edges), entities).collect()}
    assert roots == {1: 2, 4: 2}


def test_value_groups(spark):
    rng, sets = random.Random(5), {}
    for v in range(120):
        near = sets.get(rng.randrange(v)) if v and v % 2 else None
        sets[v] = set(rng.sample(sorted(near), max(1, len(near) * rng.randrange(3, 10) // 10))) if near else set(rng.sample(range(300), rng.choice([1, 2, 5, 7, 30, 200])))
    inc = spark.createDataFrame([(e, v) for v, s in sets.items() for e in s], "entity_id long, value long")
    for percent in (40, 75):
        want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) > percent * len(sets[a] | sets[b])}
        assert want and {(r.a, r.b): r.similarity for r in resolve.value_groups(inc, percent).collect()} == want


def test_value_similarity_takes_all_rows(spark, sf):
    sets = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        sets.setdefault(r.l_partkey, set()).add(r.l_suppkey)
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) > 4 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in derived.value_similarity(spark, sf).collect()} == want


def test_long_chain_and_empty(spark):
    n = 60
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.comp for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0
    assert components.incidence_components(spark.createDataFrame([], "entity_id long, key string, value string")).count() == 0


def test_long_ways_are_walked_to_their_end(spark):
    links = lambda n: spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("PRODRUG").alias("type"), F.lit("k").alias("key")).coalesce(1)
    labels = {r.entity_id: r.label for r in editing.member_labels(links(12), 0, spark.range(13).withColumnRenamed("id", "entity_id")).collect()}
    assert labels[12] == " ".join(["Prodrug"] * 12)
    assert paths.bfs_path(links(22), 0, 22).first()[0] == list(range(23))
    up = links(22).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    assert {len(r.path) for r in paths.ancestor_paths(up).filter("start = 0").collect()} == {23}
    seeds = spark.createDataFrame([(0, "red")], "entity_id long, colour string")
    assert editing.grown(links(22), seeds).filter("colour = 'red'").count() == 23
    down = links(51).select(F.col("dst").alias("child"), F.col("src").alias("parent"))
    assert [r.node for r in paths.leaves(down, spark.range(1).withColumnRenamed("id", "node")).collect()] == [51]


def test_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tname\n1\tx|y\n3\tz\tw\n4\t\n')
    assert [(r.id, r.name) for r in formats.table_records(spark, str(tmp_path / "a.tsv")).collect()] == [(["1"], ["x", "y"]), (["4"], None)]
    cells = formats.split_line(spark.createDataFrame([('a\t"b\tc"\t',), ("a\tb",)], "value string"), "\t", 3).collect()
    assert [tuple(r) for r in cells] == [("a", "b\tc", None)]
    (tmp_path / "m.sdf").write_text("mol1\n x\nM  END\n> <CAS>\n1-2-3\n4-5-6\n\n> <ID>\n7\n\n$$$$\n")
    r = formats.structure_records(spark, str(tmp_path / "m.sdf")).first()
    assert r["id"] == "mol1" and r["props"] == {"CAS": ["1-2-3", "4-5-6"], "ID": ["7"]}
    (tmp_path / "o.nt").write_text('<http://a#1> <http://x#label> "one" .\n<http://a#1> <http://x#subClassOf> <http://a#2> .\n<http://a#1> <http://x#subClassOf> _:b .\n_:b <http://x#onProperty> <http://x#part> .\n_:b <http://x#someValuesFrom> <http://a#3> .\n# no\n')
    resources, edges = formats.ontology(formats.ntriples(spark, str(tmp_path / "o.nt")))
    assert {(e.src[-1], e.dst[-1], e.key) for e in edges.collect()} == {("1", "2", "R_subClassOf"), ("1", "3", "R_rel")}
    assert formats.content_key(spark, str(tmp_path / "o.nt")).first()["key"].isalnum()
    (tmp_path / "r.xml").write_text("<all><drug><name>A</name></drug><drug><name>B</name></drug></all>")
    assert sorted(r.name for r in formats.xml_records(spark, str(tmp_path / "r.xml"), "drug").collect()) == ["A", "B"]


def test_substances(spark):
    j = '{"uuid":"u","approvalID":"A1","substanceClass":"chemical","names":[{"name":"abc"},{"name":"abcd","displayName":true}],"codes":[{"codeSystem":"CAS","code":"1","type":"PRIMARY"},{"codeSystem":"CAS","code":"2","type":"ALTERNATIVE"}],"relationships":[{"type":"ACTIVE MOIETY","relatedSubstance":{"approvalID":"A2"}}]}'
    rec = spark.createDataFrame([(j,), (j.replace('"A1"', '"A2"'),)], "s string").select(F.from_json("s", formats.SUBSTANCE).alias("record"))
    s = formats.substances(rec)
    r = s.filter("unii = 'A1'").first()
    assert r.names == ["abcd"] and r.preferred == "abcd" and r.codes == {"CAS": ["1"]} and r.moieties == ["A2"]
    assert [tuple(x) for x in formats.moiety_edges(s).collect()] == [("A1", "A2")]


def test_loader_rules(spark):
    inc = spark.createDataFrame([(1, "I_CODE", "UMLS:C1"), (2, "I_CODE", "UMLS:C2"), (3, "I_CODE", "UMLS:C2")], "entity_id long, key string, value string")
    rel = spark.createDataFrame([("C1", "C2", "isa"), ("C1", "C1", "isa"), ("C1", "C2", None)], "cui1 string, cui2 string, rela string")
    assert sorted((r.src, r.dst, r.key) for r in loaders.relations(rel, inc).collect()) == [(1, 2, "R_subClassOf"), (1, 3, "R_subClassOf")]
    g = spark.createDataFrame([("O1", "G1", "C1"), ("O1", "-", "C1")], "omim string, gene string, concept string")
    assert loaders.gene_links(g).count() == 3
    p = spark.createDataFrame([("A1", "prod", "x; y", "5mg;", None)], "application string, product string, ingredients string, strength string, date string")
    rows = {r.ingredient: (r.strength, r.date) for r in loaders.by_ingredient(p).collect()}
    assert rows["x"] == (["5mg"], ["Not found"]) and set(rows) == {"x", "y"}
    x = spark.createDataFrame([("SNOMED_CT", "12"), ("GARD", "7")], "d string, v string").select(loaders.prefixed(F.col("d"), F.col("v")).alias("p"))
    assert [r.p for r in x.collect()] == ["SNOMEDCT_US:12", "GARD:0000007"]
    k = loaders.keyed(spark.createDataFrame([(1, "a", ["b", "c"])], "id long, name string, synonyms array<string>"), "id", "drugbank")
    assert sorted(r.value for r in k.collect()) == ["A", "B", "C"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "The red fox"), (2, "red red dog"), (3, None)], "id long, t string")
    idx = search.index(docs, "id", "t")
    assert [r.entity_id for r in search.search(idx, "+red -fox").collect()] == [2]
    assert [r.entity_id for r in search.search(idx, "red ~fox", 1).collect()] == [1]
    found = lambda q: sorted(r.entity_id for r in search.search_text(docs, "id", "t", q).collect())
    assert found('+"red dog"') == [2] and found('"dog red"') == [] and found('"the fox"') == [] and found('"the fox"~1') == [1]
    assert found("red NOT fox") == [2] and found("red AND dog") == [2] and found("fox OR red") == [1] and found("~fox ~dog") == [1, 2] and found("fox's") == [1] and found('red -"red fox"') == [2]
    grams = docs.filter("id = 2").select(F.explode(search.ngrams(F.col("t"))).alias("g")).collect()
    assert sorted(r.g for r in grams) == ["dog", "red", "red", "red dog", "red red", "red red dog"]


def test_text_tokens_keeps_rare_ones(spark, tmp_path):
    spark.createDataFrame([(i, "fox fox" if i else "Fox hen") for i in range(6)] + [(9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.token, r.n, r.docs) for r in derived.text_tokens(spark, str(tmp_path)).collect()} == {("fox", 11, 6), ("hen", 1, 1)}


def test_ngrams_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "The red fox"), (2, "Red fox, red dog"), (3, None), (4, "the")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "red hen")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.gram: r.n for r in derived.ngrams(spark, str(tmp_path)).collect()}
    assert got == {"red": 3, "fox": 2, "dog": 1, "red fox": 2, "fox red": 1, "red dog": 1, "red fox red": 1, "fox red dog": 1}


def test_exports(spark, core, tmp_path):
    edges = linking.shared_value_edges(core)
    nodes = spark.createDataFrame([(i, ["L"], f"n<{i}") for i in range(1, 5)], "entity_id long, labels array<string>, label string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g/counts")).first()[0] == "4 3"
    n, e = sinks.gexf_elements(nodes, edges)
    assert n.filter("xml like '%n&lt;1%'").count() == 1 and e.count() == edges.count() == 9
    assert sinks.as_json(sinks.component_documents(core, components.incidence_components(core))).count() == 2


def test_stream(spark, core, tmp_path):
    core.filter("entity_id in (1, 4)").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(core.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start(read(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    core.filter("entity_id in (2, 3)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.start(read(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.entity_id: r.comp for r in ingest.labels(spark, str(tmp_path / "out")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_batches_add_up(spark):
    """Batch after batch the labels are those of all rows, and a batch writes no more rows than it brings."""
    rng, rows, state = random.Random(4), [], None
    for _ in range(4):
        batch = [(rng.randrange(40), "k", f"v{rng.randrange(45)}") for _ in range(12)]
        rows += batch
        new = ingest.merge_batch(state, spark.createDataFrame([*batch, (None, "k", "v1"), (3, "k", None)], "entity_id long, key string, value string"))
        parts = {name: spark.createDataFrame(t.collect(), t.schema) for name, t in new.items()}
        assert all(t.count() <= 2 * len(batch) for t in parts.values())
        state = parts if state is None else {name: state[name].unionByName(t) for name, t in parts.items()}
        whole = components.incidence_components(spark.createDataFrame(rows, "entity_id long, key string, value string"))
        got = ingest.current(state["entities"], state["renames"])
        assert {r.entity_id: r.comp for r in got.collect()} == {r.entity_id: r.comp for r in whole.collect()}


def test_long_names_are_resolved(spark):
    docs = spark.createDataFrame([(1, "Under the GNU General Public License, and the gnu general public licence; GNU General Public License"), (2, None)], "id long, t string")
    names = spark.createDataFrame([("GNU General Public License",), ("license and",), ("MIT",), ("public",)], "name string")
    assert {(r.entity_id, r["name"], r.hits) for r in search.resolve(docs, "id", "t", names).collect()} == {(1, "gnu general public license", 2), (1, "license and", 1), (1, "public", 3)}


def test_components_by_rounds(spark):
    """Without the last step's one task, round after round."""
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(30)]
    parent = {x: x for p in pairs for x in p}
    for _ in range(len(parent)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    for few in (0, 40, 1000):
        assert {r.node: r.comp for r in components.connected_components(df, few).collect()} == parent


def compound_info(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, unii array<string>, active array<string>, l4 array<string>")


def test_guarded_merges(spark):
    """Roots and stated moieties keep classes apart, whatever else merges at once."""
    info = compound_info(spark, [(i, [f"U{i}"], ["U1"] if i == 1 else ["U9"] if i in (6, 7) else None, []) for i in range(1, 12)])
    roots = spark.createDataFrame([(1, True), (4, True)], "entity_id long, is_root boolean")
    classes = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 4), (8, 8)], "entity_id long, cls long")
    pairs = spark.createDataFrame([(2, 5), (3, 2), (6, 7), (6, 1), (10, 11), (8, 9)], "src long, dst long")
    got = {r.entity_id: r.cls for r in compound.guarded(classes, pairs, info, roots).collect()}
    # 2-5 would join two roots; 6-1 differ in what they state; 3 joins 2's class; 6-7 agree
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10}


def test_compound_phases(spark):
    info = compound_info(spark, [(1, ["U1"], None, ["a-N"]), (2, ["U2"], None, ["a-N", "s-S"]), (3, None, None, ["a-N"]), (4, ["U4"], ["U4"], ["b-M"]), (5, ["U5"], None, ["c-N"]), (6, None, None, ["z-N"])])
    moieties = spark.createDataFrame([(2, ["UNII000001"]), (5, ["U5", "UA", "UB"])], "entity_id long, values array<string>")
    links = spark.createDataFrame([(2, 1), (5, 4), (5, 6)], "src long, dst long")
    assert {r.entity_id: r.is_root for r in compound.active_roots(info, links).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert {r.entity_id: r.n for r in compound.moiety_counts(info, moieties).collect()} == {2: 1, 5: 2}
    inc = spark.createDataFrame([(i, "H_LyChI_L4", v) for i, v in [(1, "a-N"), (2, "a-N"), (2, "s-S"), (3, "a-N"), (4, "b-M"), (5, "c-N"), (6, "z-N")]] + [(i, "N_Name", "N") for i in (4, 6)], "entity_id long, key string, value string")
    comp = components.incidence_components(inc)
    got = {r.entity_id: r.cls for r in compound.resolve_compounds(inc, comp, info, moieties, links).collect()}
    # 2 follows its one moiety, 3 the equal structure; 4 and 6 share a name and clique, as two roots they stay apart
    assert got[1] == got[2] == got[3] == 1 and len(got) == 6 and got[4] == 4
    votes = {r.entity_id: r.target for r in compound.unsure_votes(spark.createDataFrame([(5,)], "entity_id long"), links, info).collect()}
    assert votes == {5: None}


def test_verdicts(spark):
    rows = [(1, 2, 1.0, ["H_LyChI_L5"], [], ["x-N"], []), (1, 3, 9.0, ["H_LyChI_L4"], ["a-N"], ["a-N", "s-S"], ["a-N"]), (1, 4, 9.0, ["H_LyChI_L4"], ["a-N"], ["a-N", "b-M"], ["a-N"]), (1, 5, 9.0, ["H_LyChI_L4", "N_Name", "I_CAS"], ["a-N"], ["a-N", "b-M"], ["a-N"]), (1, 6, 6.0, ["H_LyChI_L3", "N_Name", "I_CAS"], [], [], []), (1, 7, 9.0, ["H_LyChI_L3", "N_Name", "I_CAS"], [], [], [])]
    df = spark.createDataFrame(rows, "src long, dst long, score double, keys array<string>, l4 array<string>, src_l4 array<string>, dst_l4 array<string>")
    assert {r.dst: r.accepted for r in compound.stitch_verdicts(df, F.lit(3.0)).collect()} == {2: True, 3: True, 4: False, 5: True, 6: False, 7: True}


def test_loader_records(spark):
    xml = "<a><title>T</title><kwd-group kwd-group-type='GeneSymbol'><kwd>G1</kwd><kwd> G2 </kwd></kwd-group><contrib><name><surname>S</surname></name><xref rid='x1'/></contrib><aff id='x1'>Place</aff><history><date><day>3</day><month>4</month><year>2001</year></date></history></a>"
    c = loaders.chapters(spark.createDataFrame([(1, xml)], "id long, xml string")).first()
    assert (c.title, c.GeneSymbol, c.Include, [tuple(a) for a in c.authors], c.dates) == ("T", ["G1", "G2"], [], [("S", "Place")], ["04/03/2001"])
    d = spark.createDataFrame([([("D1", True), ("D2", None)], "n", ["b", "a"], ["a", ""])], "`drugbank-id` array<struct<_VALUE:string,_primary:boolean>>, name string, synonyms array<string>, groups array<string>")
    r = loaders.drug_records(d).first()
    assert (r["id"], r.others, r.terms) == ("D1", ["D2"], ["a", "b"])
    j = spark.createDataFrame([("CC", "Unknown", ["a", "Unknown"], (1,)), (" ", "x", None, None), (None, "x", None, None)], "smiles string, name string, syn array<string>, o struct<k:int>")
    rows = loaders.json_records(j, "smiles").collect()
    assert len(rows) == 1 and rows[0]["name"] is None and rows[0].syn == ["a"] and rows[0].o
    m = spark.createDataFrame([("H1", ["H1", "H2"], "n", ["x", "x"], [("p",), (None,)])], "accession string, secondary array<string>, name string, synonyms array<string>, abnormal_concentrations array<struct<patient_information:string>>")
    assert [tuple(r) for r in loaders.metabolites(m).collect()] == [("H1", ["H2"], "n", ["x"], ["p"])]
    p = spark.createDataFrame([("o1", "s", "1", "5 [x] 123[PMID]_45[PMID]", "rare"), ("o1", "s", "1", "other", "z")], "disorder string, source string, id string, reference string, class string")
    inc = spark.createDataFrame([(9, "I_CODE", "O1")], "entity_id long, key string, value string")
    got = loaders.prevalence(p, inc).collect()
    assert len(got) == 1 and got[0].src == 9 and got[0].pmids == [123, 45]
    t = spark.createDataFrame([("a b", "CC(=O)O", 1), ("c", "c1ccccc1", 2)], "name string, s string, n int")
    assert loaders.structure_column(t) == "s" and loaders.structure_column(t.select("name")) is None


def test_service_and_jobs(spark, core, tmp_path):
    from linkloom import __main__ as cli

    core.write.parquet(str(tmp_path / "inc"))
    assert [tuple(r) for r in cli.main(["metrics", str(tmp_path / "inc")])] == [(4, 2, 1, 9)]
    assert cli.main(["values", str(tmp_path / "inc"), "I_CID", "1"])[0]["edges"] == 1
    made = []
    make = lambda: made.append(1) or core
    for version, now in (("a", 0), ("a", 5), ("a", 50), ("b", 51)):
        assert jobs.kept(spark, str(tmp_path / "kept"), version, make, 10, now).count() == core.count()
    assert len(made) == 3


def test_strict_clusters(spark):
    strong = "R_activeMoiety"
    rows = [(1, strong, "A"), (2, strong, "A"), (3, strong, "B"), (4, strong, "B"), (5, strong, "A"), (5, strong, "B"), (6, "N_Name", "x"), (1, "N_Name", "x"), (7, "N_Name", "y"), (8, "N_Name", "y"), (9, "N_Name", "z")]
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    got = {(r.cls, r.entity_id, r.how) for r in reports.strict_clusters(inc).collect()}
    assert got == {(1, 1, "core"), (1, 2, "core"), (3, 3, "core"), (3, 4, "core"), (1, 6, "near"), (1, 5, "several"), (3, 5, "several"), (7, 7, "left"), (7, 8, "left")}
    placed = spark.createDataFrame([(1, 1)], "cls long, entity_id long")
    assert {(r.entity_id, r.cls) for r in reports.candidates(inc, placed).collect()} == {(6, 1)}


def test_designations(spark):
    d = spark.createDataFrame([(1, "Treatment of cystic fibrosis", "01/02/2003"), (2, "none", None)], "id long, text string, date string")
    n = spark.createDataFrame([("Cystic Fibrosis", "G1"), ("fibrosis", "G2")], "name string, disease_id string")
    assert [(r.id, r.disease_id, str(r.granted)) for r in reports.designation_map(d, n).collect()] == [(1, "G1", "2003-01-02")]


def test_greedy_cliques(spark):
    rng = random.Random(6)
    inc = spark.createDataFrame([(rng.randrange(40), "N_Name", f"v{rng.randrange(18)}") for _ in range(140)], "entity_id long, key string, value string").distinct()
    found = [list(r.members) for r in cliques.value_cliques(inc).collect()]
    used, want = set(), []
    for m in sorted(found, key=lambda m: (-len(m) * len(m) * (len(m) - 1) // 2, m)):
        if used.isdisjoint(m):
            want.append(m)
            used |= set(m)
    assert sorted(list(r.members) for r in cliques.greedy_disjoint(cliques.value_cliques(inc)).collect()) == sorted(want)


def test_value_classes(spark):
    rows = [(e, v) for v, es in {"a": (1, 2, 3), "b": (1, 2, 3, 4), "c": (7, 8), "d": (4, 7, 8)}.items() for e in es]
    inc = spark.createDataFrame(rows, "entity_id long, value string")
    # a and b are alike, c and d are; 4 has b and d: one of two values of either class, so the least
    assert {r.entity_id: r.cls for r in resolve.value_classes(inc).collect()} == {1: "a", 2: "a", 3: "a", 4: "a", 7: "c", 8: "c"}


def test_merges_by_score(spark):
    """3-4 would join two classes with roots, but only because the stronger pairs came first."""
    info = compound_info(spark, [(i, [f"U{i}"], None, []) for i in range(1, 7)])
    roots = spark.createDataFrame([(1, True), (2, True)], "entity_id long, is_root boolean")
    v = spark.createDataFrame([(1, 4, 9.0, True), (2, 3, 8.0, True), (3, 4, 5.0, True), (5, 6, 1.0, False)], "src long, dst long, score double, accepted boolean")
    assert {r.entity_id: r.cls for r in compound.resolve_by_scores(v, info, roots).collect()} == {1: 1, 4: 1, 2: 2, 3: 2, 5: 5, 6: 6}


def test_guarded_values_equal_pairs(spark, sf, monkeypatch):
    rng = random.Random(5)
    for n, guards in ((40, ["x", "y", None]), (60, ["x", None]), (60, ["x", "y", "z"]), (50, ["x"])):
        rows = sorted({(rng.randrange(n), k, f"{k}{rng.randrange(n // 3)}") for _ in range(2 * n) for k in [rng.choice(["I_UNII", "N_Name", "Z_One", "A_Two"])]})
        inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
        entities = spark.createDataFrame([(e, rng.choice(guards), rng.random() < 0.4) for e in range(n)], "entity_id long, guard string, is_root boolean")
        placed = entities.join(components.incidence_components(inc), "entity_id", "left").withColumn("comp", F.coalesce("comp", "entity_id"))
        want = {tuple(r) for r in resolve.guarded_classes(placed, linking.shared_value_edges(inc)).collect()}
        assert {tuple(r) for r in resolve.guarded_values(entities, inc).collect()} == want

    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(derived, "shared_value_edges", never)
    assert derived.untangle(spark, sf).count() == 200 and derived.sgroups(spark, sf).count() > 0


def test_key_cliques_equal_pairs(spark, sf, monkeypatch):
    rng = random.Random(6)
    for n, per in ((30, 2), (24, 3), (40, 1)):
        rows = sorted({(e, k, f"{k}{rng.randrange(n // 3)}") for e in range(n) for k in ("I_CAS", "N_Name") for _ in range(rng.randrange(per + 1))})
        inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
        comp = components.incidence_components(inc)
        for least in (2, 3):
            want = sorted((r.comp, r.key, tuple(r.members)) for r in cliques.component_cliques(linking.shared_value_edges(inc), comp, least).collect())
            assert sorted((r.comp, r.key, tuple(r.members)) for r in cliques.key_cliques(inc, comp, least).collect()) == want

    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(graph, "shared_value_edges", never)
    assert graph.component_cliques(spark, sf).count() > 0


def test_similarity_of_twins_equals_pairs(spark, sf, monkeypatch):
    rng = random.Random(7)
    rows = sorted({(e, k, f"{k}{rng.randrange(6)}") for e in range(60) for k in ("I_CAS", "N_Name") for _ in range(rng.randrange(3))})
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    want = {tuple(r) for r in neighborhood.structural_similarity(linking.shared_value_edges(inc), 0.6).collect()}
    monkeypatch.setattr(twins, "BLOCK", 2)
    got = [tuple(r) for r in twins.structural_similarity(inc, 0.6).collect()]
    assert len(got) == len(want) and set(got) == want

    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(graph, "shared_value_edges", never)
    assert graph.struct_similarity(spark, sf).count() >= graph.struct_neighbors(spark, sf).count() > 0


def test_similarity_makes_pairs_where_values_lie(spark, monkeypatch):
    rng = random.Random(10)
    rows = sorted({(e, k, f"{k}{rng.randrange(m)}") for e in range(150) for k, m in (("I_CODE", 6), ("N_Name", 9))})
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    several = inc.union(spark.createDataFrame([(e, "I_CAS", f"{c}{e % m}") for e in range(60) for c, m in (("a", 7), ("b", 11))], inc.schema))
    want = [{tuple(r) for r in neighborhood.structural_similarity(linking.shared_value_edges(i)).collect()} for i in (inc, several)]
    monkeypatch.setattr(twins, "PAIRS", 100)
    monkeypatch.setattr(twins, "BLOCK", 2)
    got = [tuple(r) for r in twins.structural_similarity(several).collect()]
    assert len(got) == len(want[1]) and set(got) == want[1]

    def never(*_, **__):
        raise AssertionError("pairs of classes are shuffled")

    monkeypatch.setattr(twins, "between", never)
    got = [tuple(r) for r in twins.structural_similarity(inc).collect()]
    assert len(got) == len(want[0]) and set(got) == want[0]


def test_verdicts_of_classes_equal_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = sorted({(e, k, f"{k}{rng.randrange(m)}{rng.choice(['-S', '-N'])}") for e in range(60) for k, m in (("I_CAS", 2), ("H_LyChI_L4", 3), ("I_UNII", 12), ("N_Name", 3)) for _ in range(rng.randrange(3))})
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    info = spark.createDataFrame([(e, sorted(v for x, k, v in rows if x == e and k == "H_LyChI_L4")) for e in range(60)], "entity_id long, l4 array<string>")
    a, b = inc.withColumnRenamed("entity_id", "src"), inc.withColumnRenamed("entity_id", "dst")
    pairs = a.join(b, ["key", "value"]).filter("src > dst").groupBy("src", "dst").agg(F.collect_set("key").alias("keys"), F.collect_list(F.when(F.col("key") == "H_LyChI_L4", F.col("value"))).alias("l4"), F.count(F.lit(1)).cast("double").alias("score"))
    of = lambda c: info.select(F.col("entity_id").alias(c), F.col("l4").alias(f"{c}_l4"))
    want = {tuple(r) for r in compound.stitch_verdicts(pairs.join(of("src"), "src").join(of("dst"), "dst"), F.lit(3.0)).collect()}
    monkeypatch.setattr(twins, "BLOCK", 2)
    for few in (0, 5, 10**6):
        got = [tuple(r) for r in twins.value_verdicts(inc, info, F.lit(3.0), few).collect()]
        assert len(got) == len(want) and set(got) == want


def test_verdicts_are_made_where_a_value_lies(spark, monkeypatch):
    rng = random.Random(12)
    kinds = (("I_CAS", 3), ("H_LyChI_L3", 4), ("H_LyChI_L4", 5), ("H_LyChI_L5", 9), ("N_Name", 4))
    rows = sorted({(e, k, f"{rng.randrange(m)}{rng.choice(['-S', '-N'])}") for e in range(90) for k, m in kinds for _ in range(rng.randrange(3))} | {(e, "I_CAS", "all") for e in range(90, 130)})
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    # some state a hash that they do not hold, some nothing at all
    stated = lambda e: None if e % 11 == 5 else [v for x, k, v in rows if x == e and k == "H_LyChI_L4"] + ["9-N"] * (e % 9 == 0)
    info = spark.createDataFrame([(e, stated(e)) for e in range(130)], "entity_id long, l4 array<string>")
    a, b = inc.withColumnRenamed("entity_id", "src"), inc.withColumnRenamed("entity_id", "dst")
    pairs = a.join(b, ["key", "value"]).filter("src > dst").groupBy("src", "dst").agg(F.collect_set("key").alias("keys"), F.collect_list(F.when(F.col("key") == "H_LyChI_L4", F.col("value"))).alias("l4"), F.count(F.lit(1)).cast("double").alias("score"))
    of = lambda c: info.select(F.col("entity_id").alias(c), F.col("l4").alias(f"{c}_l4"))
    want = {tuple(r) for r in compound.stitch_verdicts(pairs.join(of("src"), "src").join(of("dst"), "dst"), F.lit(3.0)).collect()}
    assert {accepted for *_, accepted in want} == {True, False, None}

    def never(*_, **__):
        raise AssertionError("pairs of classes are shuffled")

    monkeypatch.setattr(twins, "between", never)
    for block, together in ((1000, 4_000_000), (2, 100)):
        monkeypatch.setattr(twins, "BLOCK", block)
        monkeypatch.setattr(twins, "PAIRS", together)
        got = [tuple(r) for r in twins.value_verdicts(inc, info, F.lit(3.0)).collect()]
        assert len(got) == len(want) and set(got) == want


def test_phenotypes_of_one_code_are_dealt_over_tasks(spark, monkeypatch):
    holders = [*((e, "I_CODE", "A|1") for e in range(60)), *((e, "I_CODE", "B|2") for e in (7, 7, None)), (1, "N_Name", "A|1"), (2, "I_CODE", None)]
    inc = spark.createDataFrame(holders, "entity_id long, key string, value string")
    links = [("a|1", "A|1", " often ")] * 40 + [("A|1", "b|2", "n/a"), ("b|2", "b|2", None), ("A|1", "none", "x"), (None, "A|1", "x"), ("b|2", None, "x")]
    rows = spark.createDataFrame(links, "disorder string, phenotype string, frequency string")
    of = {c: [e for e, k, v in holders if k == "I_CODE" and v == c] for c in ("A|1", "B|2")}
    want = Counter((x, y, "often" if f == " often " else None) for a, b, f in links for x in of.get((a or "").upper(), []) for y in of.get((b or "").upper(), []))
    for block, pairs in ((1000, 4_000_000), (7, 1000)):
        monkeypatch.setattr(loaders, "BLOCK", block, raising=False)
        monkeypatch.setattr(loaders, "PAIRS", pairs, raising=False)
        out = loaders.phenotypes(rows, inc)
        assert Counter((r.src, r.dst, r.attrs and r.attrs["frequency"]) for r in out.collect()) == want and {r.key for r in out.select("key").distinct().collect()} == {"R_hasPhenotype"}
    in_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(in_task) > 20 and max(in_task) < sum(in_task) / 5


def test_rarest_structure_of_many_equal(spark):
    n = 20_000
    info = spark.range(n).select(F.col("id").alias("entity_id"), F.array(F.lit("salt-S")).alias("l4"))
    inc = info.select("entity_id", F.lit("H_LyChI_L4").alias("key"), F.lit("salt-S").alias("value"))
    none = spark.createDataFrame([], "l4 string, targets array<long>")
    got = {r.src: (r.dst, r.edges) for r in compound.rarest_structure(info, inc, info, none).collect()}
    assert got == {e: (0 if e else 1, n * (n - 1) // 2) for e in range(n)}


def test_classes_by_scores_equal_pairs(spark):
    rng = random.Random(9)
    for n, few in ((60, 0), (80, 6), (60, 10**6)):
        rows = sorted({(e, k, f"{k}{rng.randrange(m)}{rng.choice(['-S', '-N'])}") for e in range(n) for k, m in (("I_CAS", 4), ("H_LyChI_L4", 12), ("I_UNII", 20), ("N_Name", 5)) for _ in range(rng.randrange(3))})
        inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
        info = spark.createDataFrame([(e, sorted(v for x, k, v in rows if x == e and k == "H_LyChI_L4"), [rng.choice("ab")] if rng.random() < 0.4 else None) for e in range(n)], "entity_id long, l4 array<string>, active array<string>")
        roots = spark.createDataFrame([(e, rng.random() < 0.2) for e in range(n)], "entity_id long, is_root boolean")
        want = {tuple(r) for r in compound.resolve_by_scores(twins.value_verdicts(inc, info, F.lit(3.0)), info, roots).collect()}
        got = [tuple(r) for r in twins.classes_by_scores(inc, info, roots, F.lit(3.0), few).collect()]
        assert len(got) == len(want) and set(got) == want and len({c for _, c in want}) > 2


def test_accepted_classes_are_met_without_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    kinds = (("I_CAS", 3), ("H_LyChI_L4", 5), ("H_LyChI_L5", 40), ("H_LyChI_L3", 6), ("N_Name", 4), ("I_DB", 3))
    rows = sorted({(e, k, f"{rng.randrange(m)}{rng.choice(['-S', '-S', '-N', '-M'])}") for e in range(120) for k, m in kinds for _ in range(rng.randrange(3))})
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    # some state a hash that they do not hold, or do not state one that they hold
    info = spark.createDataFrame([(e, sorted(v for x, k, v in rows if x == e and k == "H_LyChI_L4" and rng.random() < 0.9) + ["9-N"] * (e % 9 == 0)) for e in range(120)], "entity_id long, l4 array<string>")
    classes, *_ = twins.verdict_classes(inc, info, 0)
    want = {(r.p, r.q, r.score) for r in twins.class_verdicts(classes, F.lit(3.0)).filter("accepted and p <> q").collect()}
    got = [(r.p, r.q, r.score) for r in twins.accepted_pairs(classes, F.lit(3.0)).filter("p <> q").collect()]
    assert len(got) == len(want) > 50 and set(got) == want

    def never(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(twins, "class_verdicts", never)
    roots = info.select("entity_id", (F.col("entity_id") % 5 == 0).alias("is_root"))
    assert twins.classes_by_scores(inc, info.withColumn("active", F.lit(None).cast("array<string>")), roots, F.lit(3.0), 0).count() == inc.select("entity_id").distinct().count()


def test_small_conflicts_are_walked_together(spark, monkeypatch):
    n = 400
    rows = [(3 * i + j, None, ["x"] if j == 2 else None, []) for i in range(n) for j in range(3)]
    info = spark.createDataFrame(rows, "entity_id long, unii array<string>, active array<string>, l4 array<string>")
    roots = spark.createDataFrame([(3 * i + j, j < 2) for i in range(n) for j in range(3)], "entity_id long, is_root boolean")
    classes = info.filter("entity_id % 3 < 2").select("entity_id", F.col("entity_id").alias("cls"))
    pairs = spark.createDataFrame([p for i in range(n) for p in ((3 * i + 1, 3 * i), (3 * i + 2, 3 * i + 1))], "src long, dst long")
    want = {3 * i + j: 3 * i + min(j, 1) for i in range(n) for j in range(3)}
    for lot in (50, 10**6):
        monkeypatch.setattr(compound, "LOT", lot)
        assert {r.entity_id: r.cls for r in compound.guarded(classes, pairs, info, roots).collect()} == want


def test_scored_groups_are_walked_together(spark):
    rows, states = [], []
    for i in range(60):
        for j, (active, root) in enumerate([(None, True), (["x"], False), (["y"], False), (None, True), (None, False)]):
            e = 5 * i + j
            rows += [(e, k, f"{k}{i}") for k in ("I_CAS", "N_Name", "I_DB")] + [(e, "I_UNII", f"{e // 3}")]
            states.append((e, [], active, root))
    inc = spark.createDataFrame(rows, "entity_id long, key string, value string")
    info = spark.createDataFrame(states, "entity_id long, l4 array<string>, active array<string>, is_root boolean")
    roots, info = info.select("entity_id", "is_root"), info.drop("is_root")
    want = {tuple(r) for r in compound.resolve_by_scores(twins.value_verdicts(inc, info, F.lit(3.0)), info, roots).collect()}
    left = lambda: {str(p) for name in ("twins", "blocks", "rare") for p in Path(scratch(spark).removeprefix("file://")).glob(f"linkloom/*/{name}")}
    for lot, few in ((40, 3), (10**6, 3), (40, 8)):
        before = left()
        assert {tuple(r) for r in twins.classes_by_scores(inc, info, roots, F.lit(3.0), few, lot).collect()} == want
        assert left() == before
