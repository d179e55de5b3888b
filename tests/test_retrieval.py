import heapq

import numpy as np
from fixtures import node_frame, random_vectors, unit, vector_frame
from pyspark.sql import functions as F

from factweave.operators import retrieval, traversal
from factweave.plans.retrieval_loop import retrieve

KINDS = ("FINANCIAL_LINE", "TEXT_SECTION", "NOTE", "ENTITY", "TABLE_ROW")
EDGES = ("EXPLAINS_LINE_ITEM", "DISCUSSES", "SEMANTICALLY_SIMILAR", "TEMPORAL_NEXT", "CAUSED_BY", "ENTITY_RELATED_TO")
WALK = traversal.Walk(edge_types=EDGES, hops=3, per_node=4, min_confidence=0.3, decay=0.9, explore=0.4, min_score=0.25)


def _graph(seed):
    rng = np.random.default_rng(seed)
    ids = [f"n{i:02d}" for i in range(30)]
    kinds = {i: KINDS[rng.integers(len(KINDS))] for i in ids}
    base = rng.standard_normal((4, 8))
    vec = {i: np.asarray(unit(base[rng.integers(4)] + 0.4 * rng.standard_normal(8)), dtype=np.float32) for i in ids if rng.random() > 0.1}
    edges, seen = [], set()
    for _ in range(150):
        a = ids[0] if rng.random() < 0.25 else ids[rng.integers(30)]
        b, t = ids[rng.integers(30)], EDGES[rng.integers(len(EDGES))]
        if a != b and (a, b, t) not in seen:
            seen.add((a, b, t))
            edges.append((a, b, t, round(float(rng.uniform(0.25, 1.0)), 4)))
    return ids, kinds, vec, edges, np.asarray(unit(base[0]), dtype=np.float32)


def _oracle(kinds, vec, edges, query, seeds, met, walk):
    """A direct reading of the scoring rules, written independently of the operator."""
    w = walk.explore
    W = dict(cross=.2 + .1 * w, rel=.35 - .1 * w, nov=.1 + .15 * w, bridge=.15, conv=.2 - .1 * w,
             drift=.5 - .15 * w, iso=.4 - .1 * w, low=.25 - .1 * w, red=.3 - .05 * w, fan=.35 - .1 * w)
    dom = {"FINANCIAL_LINE": "F", "TABLE_ROW": "F", "TEXT_SECTION": "N", "NOTE": "N", "ENTITY": "E"}
    cos = lambda a, b: float(np.dot(a.astype(float), b.astype(float)) / (np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float))))
    out = {}
    for a, b, t, c in edges:
        out.setdefault(a, []).append((b, t, c))
    heap, count, visited, order, chain = [], 0, {}, [], 0
    for s in seeds:
        heap.append((-1.0, count, s, 0, None, 1.0))
        count += 1
    heapq.heapify(heap)
    history = []
    while heap:
        _, _, n, hop, via, conf = heapq.heappop(heap)
        if n in visited:
            continue
        visited[n] = conf
        order.append((n, hop, round(conf, 9)))
        if via:
            history.append(n)
            chain = chain + 1 if via == "SEMANTICALLY_SIMILAR" else 0
        if hop >= walk.hops:
            continue
        fan = len(out.get(n, []))
        allowed = sorted((e for e in out.get(n, []) if e[1] in walk.edge_types and e[2] >= walk.min_confidence), key=lambda e: (-e[2], e[0], e[1]))
        scored = []
        for b, t, c in allowed[: walk.per_node * 3]:
            s = c * conf
            pair = {dom[kinds[n]], dom[kinds[b]]}
            s += W["cross"] * (1 if pair == {"F", "N"} else .5 if "E" in pair else 0)
            if b in vec and cos(query, vec[b]) > .7:
                s += W["rel"] * (cos(query, vec[b]) - .7) / .3
            near = [cos(vec[b], vec[x]) for x in history[:20] if x in vec] if b in vec else []
            s += W["nov"] * (1 if not history else .5 if b not in vec else 1 - min(1, max(0, (max([0] + near) - .5) / .4)))
            s += W["bridge"] * (1 if t in ("EXPLAINS_LINE_ITEM", "DISCUSSES") else .7 if t in ("CAUSED_BY", "LEADS_TO") else 0)
            s += W["conv"] * (b in met)
            if t == "SEMANTICALLY_SIMILAR":
                s -= W["drift"] * (.2 if chain == 0 else .5 if chain == 1 else min(1, .5 + .25 * (chain - 1)))
            if len(history) >= 2:
                run = 0
                while run < len(history) and dom[kinds[history[-1 - run]]] == dom[kinds[b]]:
                    run += 1
                s -= W["iso"] * (min(1, .3 + .15 * (run - 3)) if run >= 3 else .1 * run if run == 2 else 0)
            s -= W["low"] * (0 if c >= .6 else (.6 - c) / .6)
            if b in history:
                s -= W["red"]
            elif b in vec and any(cos(vec[b], vec[x]) > .85 for x in history[:10] if x in vec):
                s -= W["red"] * .8
            if fan > 15:
                f = min(1, (fan - 15) / 25)
                s -= W["fan"] * (min(1, f * 1.5) if t in ("SEMANTICALLY_SIMILAR", "ENTITY_RELATED_TO") else f)
            s = min(1.0, max(0.0, s))
            if s >= walk.min_score:
                scored.append((s, b, t, c))
        for s, b, t, c in sorted(scored, key=lambda x: -x[0])[: walk.per_node]:
            if b not in visited:
                heapq.heappush(heap, (-s, count, b, hop + 1, t, conf * c * walk.decay))
                count += 1
    return order


def test_level_expansion_reaches_first_hop_by_the_same_scores(spark):
    ids, kinds, vec, edges, query = _graph(5)
    nodes = spark.createDataFrame(list(kinds.items()), "id string, type string")
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, confidence double")
    q = spark.createDataFrame([("q", [float(x) for x in query]), ("r", [float(x) for x in query])], "query_id string, vec array<float>")
    s = spark.createDataFrame([("q", ids[0], 0), ("r", ids[0], 0)], "query_id string, id string, rank int")
    one = traversal.Walk(**{**WALK.__dict__, "hops": 1})
    v = vector_frame(spark, vec)
    level = {(r["query_id"], r["id"]) for r in traversal.expand(q, s, nodes, e, v, one).collect()}
    best = {(k, x) for x, _, _ in _oracle(kinds, vec, edges, query, [ids[0]], set(), one) for k in "qr"}
    assert level == best and len(level) > 4


def test_best_first_equals_the_heap_replay(spark):
    tried = 0
    for seed in range(5, 11):
        ids, kinds, vec, edges, query = _graph(seed)
        met = set(ids[5:9])
        nodes = spark.createDataFrame(list(kinds.items()), "id string, type string")
        e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, confidence double")
        walks = {"a": WALK, "b": traversal.Walk(**{**WALK.__dict__, "explore": 0.9, "per_node": 2}), "c": traversal.Walk(**{**WALK.__dict__, "hops": 2, "min_score": 0.0, "decay": 0.7})}
        starts = {"a": [ids[0]], "b": [ids[3], ids[0]], "c": [ids[1], "gone", ids[2]]}
        q = spark.createDataFrame([(k, [float(x) for x in query], w.explore, w.per_node, w.decay, w.min_score, w.hops) for k, w in walks.items()],
                                  "query_id string, vec array<float>, explore double, per_node int, decay double, min_score double, hops int")
        s = spark.createDataFrame([(k, i, n) for k, own in starts.items() for n, i in enumerate(own)], "query_id string, id string, rank int")
        o = spark.createDataFrame([(k, i) for k in walks for i in met], "query_id string, id string")
        got = traversal.best_first(q, s, nodes, e, vector_frame(spark, vec), WALK, o).orderBy("query_id", "visit").collect()
        for k, w in walks.items():
            want = _oracle(kinds, vec, edges, query, [i for i in starts[k] if i in kinds], met, w)
            assert [(r.id, r.hop, round(r.path_confidence, 9)) for r in got if r.query_id == k] == want, (seed, k)
            tried += len(want)
    assert tried > 150


def test_best_first_without_input(spark):
    nodes = spark.createDataFrame([("a", "NOTE")], "id string, type string")
    e = spark.createDataFrame([], "source_id string, target_id string, edge_type string, confidence double")
    q = spark.createDataFrame([("q", [1.0]), ("r", None)], "query_id string, vec array<float>")
    s = spark.createDataFrame([("q", "a"), ("q", "a"), ("r", "a"), ("q", "b"), (None, "a")], "query_id string, id string")
    v = spark.createDataFrame([], "id string, vec array<float>")
    assert sorted((r.query_id, r.id, r.visit) for r in traversal.best_first(q, s, nodes, e, v, WALK).collect()) == [("q", "a", 1), ("r", "a", 1)]
    assert traversal.best_first(q, s.limit(0), nodes, e, v, WALK).count() == 0


def test_confidence_expansion_equals_best_first(spark):
    ids, _, _, edges, _ = _graph(9)
    hops, per_node, decay = 3, 4, 0.9
    out = {}
    for a, b, t, c in edges:
        floor = {"SEMANTICALLY_SIMILAR": .9, "ENTITY_RELATED_TO": .85, "DISCUSSES": .8}.get(t, 0.5)
        if c >= floor:
            out.setdefault(a, []).append((b, t, c))
    heap, n, visited = [(-1.0, 0, ids[0], 0)], 1, {}
    while heap:
        neg, _, x, hop = heapq.heappop(heap)
        if x in visited and visited[x][0] >= -neg:
            continue
        visited[x] = (-neg, hop)
        if hop >= hops:
            continue
        for b, _, c in sorted(out.get(x, []), key=lambda e: (-e[2], e[0], e[1]))[:per_node]:
            p = -neg * c * decay ** (hop + 1)
            if b not in visited or visited[b][0] < p:
                heapq.heappush(heap, (-p, n, b, hop + 1))
                n += 1
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, confidence double")
    s = spark.createDataFrame([("q", ids[0])], "query_id string, id string")
    got = traversal.expand_by_confidence(s, e, list(EDGES), hops=hops, per_node=per_node, min_confidence=0.5, decay=decay).collect()
    assert {r["id"]: (round(r["path_confidence"], 9), r["hop"]) for r in got} == {k: (round(c, 9), h) for k, (c, h) in visited.items()}


def test_tag_boost_and_risk_seeds(spark):
    nodes = node_frame(spark, [
        {"id": "L1", "type": "FINANCIAL_LINE", "text": "debt", "filing_id": "F", "period": "", "xbrl_tag": "us-gaap:LongTermDebt"},
        {"id": "L2", "type": "FINANCIAL_LINE", "text": "sales", "filing_id": "F", "period": "", "xbrl_tag": "us-gaap:Revenues"},
        {"id": "T1", "type": "TEXT_SECTION", "text": "competition and tariff pressure", "filing_id": "F", "period": "", "section": "Item 7"},
        {"id": "T2", "type": "TEXT_SECTION", "text": "supply chain", "filing_id": "F", "period": "", "section": "Item 1A"},
        {"id": "T3", "type": "TEXT_SECTION", "text": "nothing", "filing_id": "F", "period": ""},
    ])
    v = vector_frame(spark, {"L1": [1, 0], "L2": [0, 1]})
    top = retrieval.tag_boosted_search(nodes, v, F.array(F.lit(1.0), F.lit(0.0)), ["FINANCIAL_LINE"], keywords=["debt"]).collect()
    assert [(r["id"], round(r["score"], 3)) for r in top] == [("L1", 1.3)]
    q = spark.createDataFrame([("a", "What are the main risks?"), ("b", "What was revenue?")], "query_id string, text string")
    got = {(r["query_id"], r["id"]): r["rank"] for r in retrieval.risk_seeds(q, nodes).collect()}
    assert got == {("a", "T2"): 1, ("a", "T1"): 2, ("a", "L1"): 3}


def test_forced_overlap_shares_first_ids(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "d"], 1.0), (["a"], ["b"], 0.5)], "a array<string>, b array<string>, delta_e double")
    rows = [(sorted(r["a"]), sorted(r["b"])) for r in retrieval.forced_overlap(df).collect()]
    assert rows == [(["a", "b", "c", "d"], ["a", "b", "c", "d"]), (["a"], ["b"])]


def test_retrieval_loop_decides_every_question(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        kind = ("FINANCIAL_LINE", "TEXT_SECTION", "NOTE")[i % 3]
        rows.append({"id": f"{kind[:2]}{i:02d}", "type": kind, "text": f"Total revenue and margin of unit {i}", "filing_id": "F", "period": f"FY20{20 + i % 4}",
                     "section": f"Item {i % 4}", "xbrl_tag": "us-gaap:Revenues" if kind == "FINANCIAL_LINE" else None})
    nodes, ids = node_frame(spark, rows), [r["id"] for r in rows]
    edges = [(ids[a], ids[b], ("EXPLAINS_LINE_ITEM", "DISCUSSES", "REFERS_TO")[k % 3], 0.9) for k, (a, b) in enumerate(rng.integers(0, 12, (40, 2))) if a != b]
    e = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string, confidence double")
    vectors = vector_frame(spark, random_vectors(ids, dim=8))
    q = spark.createDataFrame([("1", "What was total revenue in FY2023?", [1.0] + [0.0] * 7), ("2", "Is the margin pressure cyclical or structural?", [0.0, 1.0] + [0.0] * 6)],
                              "query_id string, text string, vec array<float>")
    out = retrieve(q, nodes, e, vectors, max_hops=2)
    rows = {r["query_id"]: r for r in out.decisions.collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["query_type"] == "numerical" and rows["2"]["query_type"] == "opinion" and rows["2"]["mode"] != "EXPLOIT"
    for r in rows.values():
        assert 0 <= r["combined"] <= 1 and 0.3 <= r["confidence"] <= 0.95 and r["stop"] and 1 <= r["hops"] <= 3
    assert out.evidence.filter("side = 'A' and type = 'FINANCIAL_LINE'").count() > 0
