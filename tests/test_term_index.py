"""Searches through the stored index against scans of the texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from factweave.operators import graph_filters as gf
from factweave.operators import term_index


def some_texts():
    rng = random.Random(2)
    words = ["net", "sales", "Net", "salesforce", "the", "other", "ΟΔΟΣ", "a", "$1.5", "it's", "é"]
    gaps = [" ", " ", " ", "\n", "  ", "\t ", "\x0b"]
    texts = ["", " ", "net", " net", "net ", None, "net sales", "internet sales", "net salesforce", "net\nsales", "  net sales"]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts += [rng.choice(["", "x"]).join(rng.choice(words + gaps) for _ in range(6)) for _ in range(60)]
    return [(f"n{i:03d}", t, ("NOTE", "TEXT_SECTION")[i % 2], f"F{i % 3}") for i, t in enumerate(texts)]


NEEDLES = ["net", "Net sales", "net sales", "et sal", "t s", " ", "  ", " net", "sales ", " net ", "\n", "the other net", "e", "ΟΔ", "οδος", "no", "", "a\tx", "$1.5 it's", "net  sales", "ales\n", "\x0b"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = some_texts()
    path = str(tmp_path_factory.mktemp("terms"))
    nodes = spark.createDataFrame(rows, "id string, text string, type string, filing_id string").repartition(3)
    term_index.write_index(nodes, path, buckets=4)
    return rows, nodes, term_index.TermIndex(spark, path)


def test_needles_equal_the_scan(built):
    rows, _, index = built
    for needle in NEEDLES:
        got = {r.id: r["first"] for r in index.found(needle).collect()}
        assert got == {i: t.startswith(needle) for i, t, _, _ in rows if t is not None and needle in t}, repr(needle)
        got = {r.id: r["first"] for r in index.found(needle, ignore_case=True).collect()}
        low = needle.lower()
        assert got == {i: t.lower().startswith(low) for i, t, _, _ in rows if t is not None and low in t.lower()}, repr(needle)


def test_searches_equal_the_filters(built):
    _, nodes, index = built
    for needle in ("net", "sales", "net sales", "t"):
        assert [r.id for r in index.search(needle, "NOTE", "F1", 7).collect()] == [r.id for r in gf.search_nodes(nodes, needle, "NOTE", "F1", 7).collect()]
        want = [(r.id, r.score) for r in gf.search_ranked(nodes, needle, ["TEXT_SECTION"], 9).collect()]
        assert [(r.id, r.score) for r in index.search_ranked(needle, ["TEXT_SECTION"], 9).collect()] == want


def test_lookups_read_no_text_and_few_folders(built):
    _, _, index = built
    for looked in (index.search("net sales"), index.search_ranked("net")):
        plan = looked._jdf.queryExecution().toString()
        assert "text#" not in plan and "bucket" in plan
        assert "dynamicpruning" in plan or "BroadcastHashJoin" in plan or "SortMergeJoin" in plan


def test_bm25_is_the_formula(spark, built):
    rows, _, index = built
    texts = {i: [w.lower() for w in re.split(r"\s+", t, flags=re.ASCII)] for i, t, _, _ in rows if t is not None}
    average = sum(sum(w != "" for w in t) for t in texts.values()) / len(texts)
    asked = {"a": ["Net", "net", "sales"], "b": ["é", "nowhere", ""], "c": None, "d": ["nowhere"]}
    want = {}
    for q, terms in asked.items():
        for term in {t.lower() for t in terms or () if t}:
            df = sum(term in t for t in texts.values())
            for i, t in texts.items():
                if tf := t.count(term):
                    part = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(w != "" for w in t) / average))
                    want[q, i] = want.get((q, i), 0) + part
    questions = spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>")
    got = {(r.query_id, r.id): r.score for r in index.bm25(questions).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = sorted(((r.query_id, r.id) for r in index.bm25(questions, 3).collect()))
    assert top == sorted(k for q in "ab" for k in sorted((k for k in want if k[0] == q), key=lambda k: (-want[k], k[1]))[:3])


def test_empty_index(spark, tmp_path):
    nodes = spark.createDataFrame([("a", None, "NOTE", "F")], "id string, text string, type string, filing_id string")
    term_index.write_index(nodes, f"{tmp_path}/none")
    index = term_index.TermIndex(spark, f"{tmp_path}/none")
    assert index.found("a").count() == index.search("a b").count() == 0
    assert index.bm25(spark.createDataFrame([("q", ["a"])], "query_id string, terms array<string>")).count() == 0


def test_postings_need_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(term_index, "HANDED_ON", 3)
    texts = {1: " a  b\ta\n", 2: "", 3: "a\u00a0b a", 4: "\x0b\x0c", 5: "a b"}
    made = term_index.postings_of(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(2))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the test's own rows
    got = {(r.word, r.id): [tuple(p) for p in r.places] for r in made.collect()}
    want = {}
    for i, text in texts.items():
        words, gaps = re.split(r"\s+", text, flags=re.ASCII), re.findall(r"\s+", text, flags=re.ASCII)
        for pos, word in enumerate(words):
            want.setdefault((word, i), []).append((pos, gaps[pos] if pos < len(gaps) else ""))
    assert got == want


def test_lookups_of_few_words_move_no_postings(built, monkeypatch):
    rows, _, index = built
    for few, moved in ((term_index.FEW, False), (0, True)):
        monkeypatch.setattr(term_index, "FEW", few)
        plan = index._matching(F.col("word") == "net")._jdf.queryExecution().toString()
        assert ("rightHint=(strategy=broadcast)" in plan) != moved
        assert {r.id for r in index.found("net").collect()} == {i for i, t, _, _ in rows if t is not None and "net" in t}
