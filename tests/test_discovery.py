import itertools
import time

import numpy as np
import pytest
from fixtures import edge_set, node_frame, random_vectors, unit, vector_frame
from pyspark.sql import functions as F

from factweave.operators import causal, components, containment, cross_reference, entities, paths, semantic, table_text, temporal
from factweave.operators.similarity import similarity_join
from factweave.plans import build
from factweave.session import ensure_checkpoint_dir

EDGE = ("source_id", "edge_type", "target_id", "confidence")


def test_temporal_links_consecutive_periods(spark):
    rows = [
        {"id": f"FL_{y}", "type": "FINANCIAL_LINE", "text": "Total Revenue", "filing_id": f"F{y}", "period": f"FY{y}", "xbrl_tag": "us-gaap:Revenues"}
        for y in (2022, 2023, 2024)
    ] + [
        {"id": f"NT_{y}", "type": "NOTE", "text": "Note 3", "filing_id": f"F{y}", "period": f"FY{y}", "note_number": 3} for y in (2023, 2024)
    ]
    nodes = node_frame(spark, rows)
    vectors = vector_frame(spark, random_vectors([r["id"] for r in rows]))
    assert edge_set(temporal.discover(nodes, vectors), *EDGE) == {
        ("FL_2022", "TEMPORAL_NEXT", "FL_2023", 0.95), ("FL_2023", "TEMPORAL_NEXT", "FL_2024", 0.95),
        ("NT_2023", "TEMPORAL_NEXT", "NT_2024", 0.9),
    }


def test_next_in_key_equals_a_lead_over_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [
        {"id": f"n{i:03d}", "type": "FINANCIAL_LINE", "text": "x", "filing_id": "F", "xbrl_tag": f"t{rng.integers(3)}",
         "period": ["FY2021", "Q1-FY2022", "FY2022", "FY2023", "odd", "strange"][rng.integers(6)]}
        for i in range(120)
    ]
    nodes = node_frame(spark, rows)
    got = {tuple(r) for r in temporal.next_in_key(nodes, "xbrl_tag").collect()}
    order = {"odd": (-1, "odd"), "strange": (-1, "strange"), "FY2021": (20215, ""), "Q1-FY2022": (20221, ""), "FY2022": (20225, ""), "FY2023": (20235, "")}
    want = set()
    for tag in ("t0", "t1", "t2"):
        group = sorted((r for r in rows if r["xbrl_tag"] == tag), key=lambda r: order[r["period"]])
        want |= {(tag, a["id"], b["id"]) for a, b in itertools.pairwise(group) if a["period"] != b["period"]}
    assert got == want


def test_semantic_similarity_within_and_across_filings(spark):
    rng = np.random.default_rng(42)
    base, other = rng.standard_normal(768), rng.standard_normal(768)
    noisy = lambda v, s: unit(v + s * rng.standard_normal(768))
    vectors = {"TS_001": noisy(base, 0.1), "TS_002": noisy(base, 0.1), "TS_003": noisy(other, 0.1), "TS_004": noisy(base, 0.15)}
    place = {"TS_001": ("F2024", 1000), "TS_002": ("F2024", 5000), "TS_003": ("F2024", 8000), "TS_004": ("F2023", 1000)}
    nodes = node_frame(spark, [
        {"id": i, "type": "TEXT_SECTION", "text": i, "filing_id": f, "period": "FY", "section": "Item 7", "char_offset": o} for i, (f, o) in place.items()
    ])
    got = edge_set(semantic.discover(nodes, vector_frame(spark, vectors)), "source_id", "target_id", "algorithm")
    assert got == {("TS_001", "TS_002", "within_filing_similarity"), ("TS_004", "TS_001", "cross_filing_similarity")}


def test_neighbouring_passages_are_skipped_and_hits_are_capped_in_order(spark):
    v = unit([1, 0.0])
    rows = [{"id": f"a{i}", "type": "NOTE", "text": "", "filing_id": "F", "period": "", "char_offset": i * 600} for i in range(9)]
    got = edge_set(semantic.within_filing(node_frame(spark, rows), vector_frame(spark, {r["id"]: v for r in rows})), "left_id", "right_id")
    want = {(f"a{i}", f"a{j}") for i in range(9) for j in list(range(i + 2, 9))[:5]}
    assert got == want


def test_causal_statements_resolve_by_keyword(spark):
    text = ("Revenue increased due to strong iPhone sales in emerging markets. "
            "Higher operating costs resulted in lower gross margin for the period.")
    nodes = node_frame(spark, [
        {"id": "TS", "type": "TEXT_SECTION", "text": text, "filing_id": "F", "period": "FY2024"},
        {"id": "FL_001", "type": "FINANCIAL_LINE", "text": "Gross Margin: 45%", "filing_id": "F", "period": "FY2024"},
        {"id": "FL_002", "type": "FINANCIAL_LINE", "text": "Total Sales: $10B", "filing_id": "F", "period": "FY2024"},
        {"id": "FL_900", "type": "FINANCIAL_LINE", "text": "Total Sales and cost", "filing_id": "G", "period": "FY2024"},
    ])
    vectors = vector_frame(spark, random_vectors(["TS", "FL_001", "FL_002", "FL_900"]))
    found = {tuple(r) for r in causal.statements(nodes.filter("type = 'TEXT_SECTION'")).select("direction", "connector", "cause", "effect").collect()}
    assert ("forward", "resulted in", "Higher operating costs", "lower gross margin for the period.") in found
    # "Revenue increased" is long enough; its cause names sales, the effect finds nothing in this filing.
    assert edge_set(causal.discover(nodes, vectors), *EDGE) == {
        ("TS", "CAUSED_BY", "FL_002", 0.7), ("TS", "LEADS_TO", "FL_001", 0.7),
    }


def test_causal_fallbacks_follow_similarity_then_keywords(spark):
    nodes = node_frame(spark, [
        {"id": "A", "type": "NOTE", "text": "The heavy storm season resulted in closed stores everywhere.", "filing_id": "F", "period": ""},
        {"id": "B", "type": "NOTE", "text": "Unrelated words about nothing.", "filing_id": "F", "period": ""},
        {"id": "C", "type": "NOTE", "text": "A quiet month, consequently people went home.", "filing_id": "G", "period": ""},
        {"id": "L", "type": "FINANCIAL_LINE", "text": "Goodwill", "filing_id": "G", "period": ""},
    ])
    vectors = vector_frame(spark, {"A": unit([1, 0.2]), "B": unit([1, 0]), "C": unit([0, 1]), "L": unit([1, 0])})
    # A and B share no word of the spans' first five beyond chance; "the" is not in B.
    got = edge_set(causal.discover(nodes, vectors), *EDGE)
    assert ("C", "LEADS_TO", "L", 0.6) in got
    assert ("A", "LEADS_TO", "B", 0.65) in got
    assert len(got) == 2


def test_cross_references_prefer_the_own_filing(spark):
    nodes = node_frame(spark, [
        {"id": "TS_001", "type": "TEXT_SECTION", "filing_id": "F24", "period": "FY2024", "section": "Item 1",
         "text": "As discussed in Note 3, the Company recognized revenue. See Item 7 for more details on this."},
        {"id": "NT_old", "type": "NOTE", "text": "Note 3 of last year", "filing_id": "F23", "period": "FY2023", "section": "Note 3", "note_number": 3},
        {"id": "NT_003", "type": "NOTE", "text": "Note 3 - Revenue", "filing_id": "F24", "period": "FY2024", "section": "Note 3", "note_number": 3},
        {"id": "TS_007", "type": "TEXT_SECTION", "text": "Management's Discussion", "filing_id": "F24", "period": "FY2024", "section": "Item 7"},
        {"id": "TS_x", "type": "TEXT_SECTION", "text": "refer to Note 9 and see Note 3", "filing_id": "F22", "period": "FY2022", "section": "Item 9"},
    ])
    vectors = vector_frame(spark, random_vectors(["TS_001", "NT_003", "TS_007"]))
    assert edge_set(cross_reference.discover(nodes, vectors), *EDGE) == {
        ("TS_001", "REFERS_TO", "NT_003", 1.0), ("TS_001", "REFERS_TO", "TS_007", 0.95), ("TS_x", "REFERS_TO", "NT_old", 0.95),
    }


def test_references_take_the_first_pattern_at_a_position(spark):
    nodes = node_frame(spark, [{"id": "t", "type": "NOTE", "text": 'See Note 4. The following table and Note 12 - "Leases" apply. See Part II, Item 7A.',
                                "filing_id": "F", "period": ""}])
    got = {tuple(r) for r in cross_reference.extract_references(nodes).select("ref_type", "ref_value", "start").collect()}
    assert ("note", "4", 0) in got and ("table", "", 12) in got and ("note_title", "12", 36) in got
    assert ("part_item", "Part II Item 7A", nodes.first()["text"].index("Part II")) in got


def test_figures_in_text_explain_lines_within_tolerance(spark):
    nodes = node_frame(spark, [
        {"id": "TS_001", "type": "TEXT_SECTION", "text": "Total net sales were $383 billion for the year.", "filing_id": "F", "period": ""},
        {"id": "NT_001", "type": "NOTE", "text": "Product sales were $200.6 billion.", "filing_id": "F", "period": ""},
        {"id": "FL_001", "type": "FINANCIAL_LINE", "text": "Net Sales", "filing_id": "F", "period": "", "value": 383.3e9},
        {"id": "TR_001", "type": "TABLE_ROW", "text": "Products", "filing_id": "F", "period": "", "value": 200.583e9},
        {"id": "FL_002", "type": "FINANCIAL_LINE", "text": "Other", "filing_id": "G", "period": "", "value": 383.3e9},
        {"id": "FL_003", "type": "FINANCIAL_LINE", "text": "Zero", "filing_id": "F", "period": "", "value": 0.0},
    ])
    vectors = vector_frame(spark, random_vectors(["TS_001", "NT_001", "FL_001", "TR_001"]))
    assert edge_set(table_text.discover(nodes, vectors), *EDGE) == {
        ("TS_001", "EXPLAINS_LINE_ITEM", "FL_001", 0.85), ("NT_001", "EXPLAINS_LINE_ITEM", "TR_001", 0.85),
    }


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    nums, values = np.exp(rng.uniform(0, 4, 300)), np.exp(rng.uniform(0, 4, 200))
    left = spark.createDataFrame([(int(i), "k", float(x)) for i, x in enumerate(nums)], "i int, k string, num double")
    right = spark.createDataFrame([(int(j), "k", float(x)) for j, x in enumerate(values)], "j int, k string, value double")
    got = {(r["i"], r["j"]) for r in table_text.band_join(left, right, ["k"]).collect()}
    want = {(i, j) for i, x in enumerate(nums) for j, v in enumerate(values) if abs(x - v) / v <= 0.05}
    assert got == want and len(want) > 100


def test_tag_words_and_similarity_make_a_discussion(spark):
    nodes = node_frame(spark, [
        {"id": "T", "type": "NOTE", "text": "operating income fell", "filing_id": "F", "period": ""},
        {"id": "U", "type": "NOTE", "text": "nothing here", "filing_id": "F", "period": ""},
        {"id": "L", "type": "FINANCIAL_LINE", "text": "x", "filing_id": "F", "period": "", "xbrl_tag": "us-gaap:OperatingIncomeLoss"},
    ])
    vectors = vector_frame(spark, {"T": [1, 0], "U": [1, 0.1], "L": [0.7, (1 - 0.49) ** 0.5]})
    got = edge_set(table_text.discover(nodes, vectors), *EDGE)
    assert got == {("T", "DISCUSSES", "L", round((2 / 3 + 0.7) / 2, 3))}


@pytest.mark.parametrize("keep,n,per", [("all", 1, None), ("first", 3, None), ("best", 1, None), ("best", 4, None), ("best", 1, "tag")])
def test_similarity_join_equals_brute_force(spark, keep, n, per):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 16))
    data = np.array([unit(centres[i % 8] + 0.25 * rng.standard_normal(16)) for i in range(160)])
    data[20:60] = data[20]  # a hot group of copies
    rows = [(i, i, "g" if i % 3 else "h", int(i % 4), [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, pos long, grp string, tag int, vec array<float>")
    threshold = 0.75
    got = similarity_join(df, df, threshold=threshold, key=("grp",), keep=keep, n=n, per=per, where=lambda l, r: r["pos"] > l["pos"],
                          block_rows=24)
    got = {(r["left_id"], r["right_id"]) for r in got.collect()}
    f32 = data.astype(np.float32).astype(float)
    f32 /= np.linalg.norm(f32, axis=1, keepdims=True)
    sims = f32 @ f32.T
    want = set()
    for i in range(160):
        js = [j for j in range(i + 1, 160) if rows[i][2] == rows[j][2] and sims[i, j] >= threshold]
        groups = {}
        for j in js:
            groups.setdefault(rows[j][3] if per else 0, []).append(j)
        for g in groups.values():
            if keep == "first":
                g = sorted(g)[:n]
            elif keep == "best":
                g = sorted(g, key=lambda j: (-round(sims[i, j], 12), j))[:n]
            want |= {(i, j) for j in g}
    assert got == want and len(want) > 50


def test_small_name_tables_move_no_text(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS text_id", "text")
    names = spark.createDataFrame([(1, "the"), (2, "of ")], "name_id int, name string")
    plan = containment.containment_join(texts, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 0


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    names = [(0, "red widget"), (1, "ab"), (2, "widget factory"), (3, "zzz"), (4, "red widget"), (5, ""), (6, None), (7, "é"), (8, "x" * 30)]
    names += [(10 + i, f"Customer#{i:09d}") for i in range(300)]  # all begin alike
    texts = [("a", "one red widget factory"), ("b", "cab ride"), ("c", "nothing"), ("d", "abab red widget"), ("e", ""), ("f", None), ("g", "é" * 600 + "x" * 40)]
    texts += [(f"t{i}", " ".join(f"Customer#{j:09d}" for j in rng.integers(0, 400, 120))) for i in range(40)]  # a third and more hold a frequent word
    n = spark.createDataFrame(names, "name_id int, name string")
    t = spark.createDataFrame(texts, "text_id string, text string")
    want = {(tid, nid) for tid, text in texts if text for nid, name in names if name and name in text}
    for chars in (containment.AUTOMATON_CHARS, 500, 20):  # one automaton, and shards of them
        got = [(r["text_id"], r["name_id"]) for r in containment.containment_join(t, n, chars).collect()]
        assert set(got) == want and len(got) == len(want)
    assert containment.containment_join(t.limit(0), n, 20).count() == containment.containment_join(t.limit(0), n).count() == 0
    assert containment.containment_join(t, n.filter("name_id = 5")).count() == 0


def test_a_path_of_any_length_is_found(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "source_id string, target_id string")
    found = paths.shortest_path(edges, "n060", "n000").orderBy("step").collect()
    assert [r["id"] for r in found] == [f"n{i:03d}" for i in range(60, -1, -1)]
    assert paths.shortest_path(edges, "n060", "n000", max_hops=59) is None and paths.shortest_path(edges, "n000", "gone") is None


def test_entities_are_canonical_and_cooccur(spark):
    mentions = spark.createDataFrame(
        [("n1", 0, 0, " Acme ", "company", "ctx", "F", "P"), ("n1", 0, 1, "Widget", "PRODUCT", "", "F", "P"),
         ("n2", 1, 0, "ACME", "COMPANY", "", "G", "P"), ("n2", 1, 1, "Bob", "alien", "", "G", "P"), ("n2", 1, 2, "x", "PERSON", "", "G", "P")],
        "node_id string, input_pos long, ordinal int, name string, type string, context string, filing_id string, period string")
    found = entities.canonical_entities(mentions).cache()
    assert edge_set(found, "id", "text", "filing_id") == {
        ("ENTITY_COMPANY_0001", "Acme (COMPANY)", "F"), ("ENTITY_PRODUCT_0002", "Widget (PRODUCT)", "F"), ("ENTITY_COMPANY_0003", "Bob (COMPANY)", "G")}
    edges = entities.extracted_edges(mentions, found)
    assert edge_set(entities.cooccurrence_edges(edges), "source_id", "target_id") == {
        ("ENTITY_COMPANY_0001", "ENTITY_PRODUCT_0002"), ("ENTITY_COMPANY_0001", "ENTITY_COMPANY_0003")}


def test_cooccurrence_blocks_lose_no_pair(spark):
    rows = [("s", f"t{i:02d}") for i in range(40)] + [("u", "t01"), ("u", "z")]
    df = spark.createDataFrame(rows, "source_id string, target_id string")
    got = {tuple(r) for r in entities.cooccurrence(df, block=7).collect()}
    want = set(itertools.combinations([f"t{i:02d}" for i in range(40)], 2)) | {("t01", "z")}
    assert got == want


def _brute_components(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(2)
    ids = [f"v{i:03d}" for i in range(120)]
    if shape == "chain":
        edges = [(ids[i], ids[i + 1]) for i in range(100)]
    elif shape == "star":
        edges = [(ids[60], x) for x in ids[:90] if x != ids[60]]
    else:
        edges = [tuple(rng.choice(ids, 2)) for _ in range(70)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [("gone", ids[0])], "source_id string, target_id string")
    got = {r["id"]: r["component"] for r in components.connected_components(nodes, e).collect()}
    assert got == _brute_components(ids, [(str(a), str(b)) for a, b in edges])


def test_leaves_of_hubs_are_gone_after_one_round(spark, monkeypatch):
    """Leaves whose ids are smaller than those of their hubs went through every round."""
    leaves = [(f"a{i:04d}", f"z{i % 4}") for i in range(800)]
    hubs = [(f"z{i}", f"z{i + 1}") for i in range(3)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in leaves + hubs for x in e}) + ["lone"]], "id string")
    sizes, hung = [], components._hung
    monkeypatch.setattr(components, "_hung", lambda pairs: sizes.append(pairs.count()) or hung(pairs))
    got = components.connected_components(nodes, spark.createDataFrame(leaves + hubs, "source_id string, target_id string"))
    assert {(r.id == "lone", r.component) for r in got.collect()} == {(False, "a0000"), (True, "lone")}
    assert sizes[0] == 803 and max(sizes[1:], default=0) <= 3


def _bridges(spark, **options):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(768)
    vectors = {"A1": unit(base), "A2": unit(rng.standard_normal(768)), "A3": unit(rng.standard_normal(768)),
               "B1": unit(base + 0.15 * rng.standard_normal(768)), "B2": unit(rng.standard_normal(768))}
    towards = -sum(vectors.values())
    vectors["C1"] = unit(towards)
    nodes = spark.createDataFrame([(i,) for i in vectors], "id string")
    edges = spark.createDataFrame([("A1", "A2"), ("A2", "A3"), ("B1", "B2")], "source_id string, target_id string")
    got = components.bridge_edges(nodes, edges, vector_frame(spark, vectors), **options)
    return nodes, edges, got


def test_bridges_join_everything(spark):
    nodes, edges, got = _bridges(spark)
    rows = got.collect()
    assert {(r["source_id"], r["target_id"]) for r in rows} >= {("A1", "B1")}
    assert len(rows) == 2 and sorted(r["forced"] for r in rows) == [False, True]
    assert [r["confidence"] for r in rows if r["forced"]] == [0.5]
    joined = components.connected_components(nodes, edges.unionByName(got.select("source_id", "target_id")))
    assert joined.select("component").distinct().count() == 1


def test_bridges_can_refuse_non_positive_similarity(spark):
    _, _, got = _bridges(spark, positive_only=True)
    assert {(r["source_id"], r["target_id"]) for r in got.collect()} == {("A1", "B1")}


def test_bridges_form_a_maximum_spanning_tree(spark):
    rng = np.random.default_rng(9)
    vectors = {f"p{i:02d}": unit(rng.standard_normal(6)) for i in range(24)}
    nodes = spark.createDataFrame([(i,) for i in vectors], "id string")
    edges = spark.createDataFrame([("p00", "p01"), ("p02", "p03"), ("p04", "p05")], "source_id string, target_id string")
    got = components.bridge_edges(nodes, edges, vector_frame(spark, vectors))
    ids = sorted(vectors)
    f = {k: unit(np.asarray(v, dtype=np.float32).astype(float)) for k, v in vectors.items()}
    pairs = sorted(itertools.combinations(ids, 2), key=lambda p: (-float(f[p[0]] @ f[p[1]]), p))
    comp = _brute_components(ids, [("p00", "p01"), ("p02", "p03"), ("p04", "p05")])
    want = set()
    for a, b in pairs:
        if comp[a] != comp[b]:
            want.add((a, b))
            old, new = comp[b], comp[a]
            comp = {k: new if c == old else c for k, c in comp.items()}
    assert {(r["source_id"], r["target_id"]) for r in got.collect()} == want


def test_build_graph_end_to_end(spark):
    text = "As discussed in Note 3, revenue growth was strong. See the financial statements for details."
    rows = [
        {"id": "TS_001", "type": "TEXT_SECTION", "text": text, "filing_id": "F", "period": "FY2024", "section": "Item 7"},
        {"id": "TS_002", "type": "TEXT_SECTION", "text": "Store closures in spring resulted in a quieter second half.", "filing_id": "F", "period": "FY2024", "section": "Item 1"},
        {"id": "NT_003", "type": "NOTE", "text": "Note 3 - Revenue Recognition", "filing_id": "F", "period": "FY2024", "note_number": 3},
        {"id": "FL_001", "type": "FINANCIAL_LINE", "text": "Total Revenue: $391B", "filing_id": "F", "period": "FY2024", "xbrl_tag": "us-gaap:Revenues", "value": 391e9},
        {"id": "EN_1", "type": "ENTITY", "text": "Widget (PRODUCT)", "filing_id": "F", "period": "FY2024"},
    ]
    graph = build.build_graph(node_frame(spark, rows), vector_frame(spark, random_vectors([r["id"] for r in rows])))
    got = edge_set(graph.edges, "source_id", "edge_type", "target_id")
    assert {("TS_001", "REFERS_TO", "NT_003"), ("TS_001", "REFERS_TO", "FL_001"), ("TS_002", "LEADS_TO", "FL_001")} <= got
    assert sum(1 for e in got if e[1] == "BRIDGE") == 1
    row = graph.summary().first()
    assert row["is_connected"] and row["total_nodes"] == 5 and row["bridge_edges"] == 1


def test_build_skips_a_failing_discovery(spark):
    rows = [{"id": f"a{i}", "type": "NOTE", "text": "x", "filing_id": "F", "period": "FY2024", "note_number": 1} for i in range(2)]
    nodes, vectors = node_frame(spark, rows), vector_frame(spark, random_vectors(["a0", "a1"]))

    def broken(nodes, vectors):
        raise ValueError("no")

    jobs = {"broken": broken, temporal.NAME: temporal.discover}
    edges, skipped = build.discover_edges(nodes, vectors, jobs, skip_failing=True)
    assert skipped == ["broken"] and edges.isEmpty()
    with pytest.raises(ValueError):
        build.discover_edges(nodes, vectors, jobs)


@pytest.mark.parametrize(("keep", "n", "per"), [("best", 1, None), ("best", 1, "kind"), ("best", 3, "kind"), ("first", 2, None)])
def test_block_size_changes_no_kept_pair(spark, monkeypatch, keep, n, per):
    from factweave.operators import similarity

    rng = np.random.default_rng(5)
    rows = [(f"n{i:03d}", i * 7 % 300, [float(x) for x in rng.standard_normal(4).astype(np.float32)], f"k{rng.integers(12)}") for i in range(300)]
    v = spark.createDataFrame([*rows, ("n900", 300, [1.0, 0.0, 0.0, 0.0], None)], "id string, pos long, vec array<float>, kind string")
    settings = {"threshold": 0.4, "keep": keep, "n": n, "per": per, "where": lambda l, r: r["kind"] > l["kind"]}
    whole = {(r.left_id, r.right_pos, round(r.sim, 9)) for r in similarity.similarity_join(v, v, **settings).collect()}
    brute = {}
    held = [*rows, ("n900", 300, [1.0, 0.0, 0.0, 0.0], "")]
    for a in held:
        for b in held:
            x, y = np.array(a[2]), np.array(b[2])
            size = np.sqrt(x @ x) * np.sqrt(y @ y)
            sim = round(float(x @ y / size), 9) if size else 0.0
            if b[3] > a[3] and sim >= 0.4:
                brute.setdefault((a[0], b[3] if per else None), []).append((-sim if keep == "best" else 0, b[1], sim))
    assert whole == {(left, pos, sim) for (left, _), hits in brute.items() for _, pos, sim in sorted(hits)[:n]}
    cut = similarity.similarity_join(v, v, block_rows=16, **settings)
    assert {(r.left_id, r.right_pos, round(r.sim, 9)) for r in cut.collect()} == whole
    monkeypatch.setattr(similarity, "BLOCKS", 2)
    sides = similarity.similarity_join(v, v, block_rows=16, **settings)
    assert {(r.left_id, r.right_pos, round(r.sim, 9)) for r in sides.collect()} == whole
    # Each row goes to two blocks of the other side, not to one for every 16 rows.
    sent = spark.createDataFrame([(301, 4, 12, n)], "rows int, _dims int, _per int, n int").select(similarity.blocks("rows", 16, keep, n))
    assert sent.first()[0] == 2


@pytest.mark.parametrize("directed", [True, False])
def test_levels_leave_nothing_on_disk_but_themselves(spark, monkeypatch, directed):
    """Many edges in shares; the shuffle files of all levels, and of the edges, stayed until the driver collected its garbage."""
    monkeypatch.setattr(paths, "MANY_EDGES", 10, raising=False)
    monkeypatch.setattr(paths, "FEW_ROWS", 2, raising=False)
    rng = np.random.default_rng(4)
    pairs = [(None if i == 3 else f"n{a}", f"n{b}") for i, (a, b) in enumerate(rng.integers(400, size=(500, 2)))]
    edges = spark.createDataFrame(pairs + pairs[:40], "source_id string, target_id string").distinct()
    seeds = spark.createDataFrame([(f"n{i}",) for i in (0, 1, 2, 1, 399)] + [("alone",)], "id string")
    sc = spark.sparkContext
    manager = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in manager.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")}
    folder = sc._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    listed = lambda: {f.getPath().getName() for f in folder.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(folder)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, listed_before = shuffles(), listed()
        found = paths.hop_distances(edges, seeds, 5, directed=directed)
        for _ in range(50):  # files go in the background
            if shuffles() <= before:
                break
            time.sleep(0.2)
        assert shuffles() <= before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    names = {name.rsplit("/", 2)[-2].split("-")[0] for name in found.inputFiles()}
    assert names == {"level", "seeds"}
    assert not {n for n in listed() - listed_before if n.startswith(("steps", "reached"))}
    after = {}
    for a, b in pairs:
        if a is not None:
            after.setdefault(a, set()).add(b)
            if not directed:
                after.setdefault(b, set()).add(a)
    want = {}
    for s in ("n0", "n1", "n2", "n399", "alone"):
        level = {s}
        for hop in range(6):
            want |= {(s, v): hop for v in level}
            level = {w for v in level for w in after.get(v, ()) if (s, w) not in want}
    rows = found.collect()
    assert {(r.seed, r.id): r.hop for r in rows} == want and len(rows) == len(want)


def test_seeds_travel_together_and_edges_are_computed_once(spark):
    """More seeds than bits of a number, on a ring with a chord, both ways and directed; each edge was computed anew per level."""
    n = 130
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [("r0", "r65")]
    touched = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            touched.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(ring, "source_id string, target_id string").mapInArrow(count, "source_id string, target_id string")
    seeds = spark.createDataFrame([(f"r{i}",) for i in range(n)], "id string")
    for directed in (True, False):
        touched.value = 0
        got = {(r.seed, r.id): r.hop for r in paths.hop_distances(edges, seeds, 3, directed=directed).collect()}
        after = {}
        for a, b in ring:
            after.setdefault(a, set()).add(b)
            if not directed:
                after.setdefault(b, set()).add(a)
        want = {}
        for s in (f"r{i}" for i in range(n)):
            level = {s}
            for hop in range(4):
                want.update({(s, x): hop for x in level if (s, x) not in want})
                level = {y for x in level for y in after.get(x, ())}
        assert got == want and touched.value == len(ring)


def test_review_pairs_leave_a_block_only_as_the_best_of_it(spark, monkeypatch):
    """The best pairs of all are the same whatever the blocks, and each two blocks give no more than was asked for."""
    from factweave.operators import similarity

    rng = np.random.default_rng(5)
    rows = [(i, i, [float(x) for x in rng.standard_normal(4)]) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, pos long, vec array<double>")
    m = np.array([unit(np.array(r[2])) for r in rows])
    sims = m @ m.T
    want = sorted((-sims[i, j], i, j) for i in range(90) for j in range(i + 1, 90) if 0.25 <= sims[i, j] < 0.9)[:7]
    later = lambda l, r: r["pos"] > l["pos"]
    for block_rows in (16, 2048):
        got = similarity.similarity_join(v, v, threshold=0.25, below=0.9, keep="top", n=7, where=later, block_rows=block_rows)
        assert [(r.left_id, r.right_id) for r in got.collect()] == [(i, j) for _, i, j in want]
