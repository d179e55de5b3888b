"""Sharding, quality rules, language, packing and encoding."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge_tables import edge_docs, edge_rows, ids, no_docs
from oracle import compare, connect, type_problems
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factweave.llm import language_id, packing, pair_index_bpe, quality_rules, queries, sharding


def test_sql_matches(spark, sf):
    con = connect(sf)
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        problem, _ = compare(df.columns, df.collect(), con, sql)
        assert problem is None, problem
        assert not type_problems(df.dtypes, con, sql)


def test_shards_are_even_and_match_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_rows(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    total, sources = len(rows), {r.source for r in rows}
    for shard in range(16):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(len(own) - total / 16) < 1
        for s in sources:
            assert abs(sum(r.source == s for r in own) - sum(r.source == s for r in rows) / 16) <= 2
    again = sharding.shard_rows(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_interleave_is_the_plain_ranking(spark):
    docs = spark.range(1, 200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("source"))
    rows = [(r.doc_id, r.source, r.h) for r in docs.withColumn("h", F.xxhash64(F.lit(20), F.col("doc_id").cast("string"))).collect()]
    placed = []
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: r[2])
        placed += [((k + 0.5) / len(own), r[2], r[0]) for k, r in enumerate(own)]
    order = [r[2] for r in sorted(placed)]
    got = sorted(sharding.interleave(docs, 7).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == order


def test_sharding_edges(spark):
    got = sharding.interleave(edge_docs(spark), 4)
    assert ids(got) == ids(edge_docs(spark)) and set(got.columns) == set(edge_docs(spark).columns)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [4, 4, 4, 5]
    sized = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard_rows(edge_docs(spark)).collect()}
    assert sized[1] == sized[2] == (1, 0)
    assert sharding.interleave(no_docs(spark)).count() == 0


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)} if len(grams) < 3000 else set()
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_base_rules(spark):
    rng = random.Random(4)
    texts = ["", None, "a b c d e a b c d e", "x x x x x x x", "a\na\n\n b \na", "# * | <> %& é ß", " \n \n", "a b c d e f g a b c d e h i j a b c d e"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "\nx y\nx y"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.base_counts(df).collect():
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, texts[r.doc_id]
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = "this line number {} has twelve words that are found in it only today"
    rows = []
    for i in range(30):
        rows.append((i, f"Read  THIS notice\n{own.format(i)}", "a"))
    for i in range(30, 40):
        rows.append((i, "read this notice\nread this NOTICE\nread this notice\nread this notice", "a"))  # n_words 12, repeated windows
    rows += [(i, f"read this notice\n{own.format(i)} ", "b") for i in range(40, 45)]
    rows += [(i, "one line of a plain copy that all of these hold in full today here", "a") for i in range(45, 75)]
    rows += [(75, "read this notice\nread THIS notice\nread this Notice\nfour more words here", "a")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_share=0.1, floor=6).collect()}
    assert got[0].kept and got[0].n_removed_words == 0  # the first holder keeps the line
    assert all(got[i].kept and got[i].n_removed_words == 3 for i in range(1, 30))
    assert not any(got[i].kept for i in range(30, 40)) and got[40].kept and got[40].n_removed_words == 0
    assert all(got[i].kept for i in range(45, 75))  # copies of one text count once
    assert not got[75].base_failed and not got[75].kept
    texts = {r.doc_id: r.text for r in quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_share=0.1, floor=6).collect()}
    assert texts[1] == own.format(1) and texts[0] == rows[0][1] and 75 not in texts and len(texts) == 30 + 5 + 30


def test_quality_edges(spark):
    docs = edge_docs(spark)
    judged = quality_rules.judge(docs.select("doc_id", "text", "source"))
    assert ids(judged) == ids(docs)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and ids(kept) == [4, 4, 8, 9, 10, None]
    assert {r.n_words for r in kept.collect()} == {"many"}
    assert quality_rules.quality_filter(no_docs(spark)).count() == quality_rules.judge(no_docs(spark)).count() == 0


def test_quality_runs_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op5_line_frequency"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95


def test_language_looks_at_the_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1).withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = sorted((r.doc_id + 1, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect())
    assert a == sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(moved, model).collect())
    assert sorted(model.members["germanic"] + model.members["romance"]) == ["de", "en", "es", "fr"]


def test_language_edges(spark):
    got = {r.doc_id: r for r in language_id.identify(edge_docs(spark)).collect()}
    assert len(got) == len(set(ids(edge_docs(spark))))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 11)) and got[None].held_out is False
    assert got[4].lang_pred in ("en", "fr", "de")
    assert language_id.language_filter(edge_docs(spark), 0.0).columns == edge_docs(spark).columns
    assert language_id.identify(no_docs(spark)).count() == language_id.language_filter(no_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    one = edge_docs(spark).withColumn("lang", F.lit("qq"))
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"und", "qq"}


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randrange(0, 300))]
    histogram = {n: lengths.count(n) for n in lengths}
    filled, ranks = {}, set()
    for length, rank, count, first, offset in packing.plan(histogram, capacity).tolist():
        for i in range(count):
            ranks.add((length, rank + i))
            filled.setdefault(first + i, []).append((offset, length))
    assert ranks == {(n, k) for n, c in histogram.items() for k in range(c)}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, capacity)


def test_packing_holds_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    slow = Tokenizer.from_file(packing.paths()[0])
    cut = packing.pieces(docs, *packing.paths()).cache()
    packed = packing.pack(cut)
    rows = packed.collect()
    whole = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and (r.length == 1024 or r.piece == 0)
        if r.doc_id != 4:
            whole.setdefault(r.doc_id, []).append(r)
    for d in docs.filter("doc_id is null or doc_id <> 4 and doc_id > 15").collect():
        ids_ = np.frombuffer(b"".join(r.ids for r in sorted(whole[d.doc_id], key=lambda r: r.piece)), "<u4").tolist()
        assert ids_ == slow.encode(d.text, add_special_tokens=False).ids + [2]
    spots = {}
    for r in rows:
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    histogram = {}
    for r in rows:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    assert len(spots) == len(plain_best_fit([r.length for r in rows], 1024)) and sorted(spots) == list(range(len(spots)))
    for parts in spots.values():
        assert [p[0] for p in sorted(parts)] == [sum(q[1] for q in sorted(parts)[:k]) for k in range(len(parts))]
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(bytes(p[2]) for p in sorted(spots[r.sequence_id])) and r.length <= 1024
    cut.unpersist()


def test_packing_query_edges(spark):
    rows = packing.pack_documents(edge_docs(spark)).collect()
    alone = [r for r in rows if r.doc_id == 1]
    assert len(alone) == 1 and alone[0].length == 1 and alone[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert {r.doc_id for r in rows} == set(ids(edge_docs(spark)))
    assert packing.pack_documents(no_docs(spark)).count() == 0


ODD = [
    "", " ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", " " * 6000 + "x", "x" * 6000, "\n \n" * 3000, "don't I'LL 've", "ΑΣ ΟΔΟΣ", "a\x85b\x1cc d　e", "日本語 テキスト 😀😀",
    "İstanbul ǅ ﬁ ½²³ ٣", "aaaa aaaaaaa", "é ́x Å̧", "<|startoftext|>a <|start", "1234567", "!?" * 300, "՘ ₝", "​  z",
]


def odd_texts():
    rng = random.Random(6)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x400), (0x4E00, 0x4F00), (0, 32)]
    return ODD + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(50)) for _ in range(200)]


def test_packing_encoder_gives_the_library_ids():
    fast, slow = packing.encoder(*packing.paths()), Tokenizer.from_file(packing.paths()[0])
    for text in odd_texts():
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_pair_index_matches_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    slow, own = Tokenizer.from_file(path), pair_index_bpe.PairIndexBpe(path)
    texts = odd_texts()
    for text, (ids_, n, decoded) in zip(texts, own.encode_batch(texts)):
        want = slow.encode(text, add_special_tokens=False).ids
        assert ids_ == " ".join(map(str, want)) and n == len(want), repr(text[:60])
        assert decoded == slow.decode(want, skip_special_tokens=False)


def test_pair_index_knows_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    slow, own = Tokenizer.from_file(path), pair_index_bpe.PairIndexBpe(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"x{c}y{c}!" for c in points[at : at + 2000]) for at in range(0, len(points), 2000)]
    rng = random.Random(2)
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(20)) for _ in range(20_000)]
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        want = [" ".join(map(str, e.ids)) for e in slow.encode_batch(part, add_special_tokens=False)]
        assert [r[0] for r in own.encode_batch(part)] == want


def test_pair_index_caches_turn_over(monkeypatch):
    monkeypatch.setattr(pair_index_bpe, "CACHE_WORDS", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, fresh = pair_index_bpe.PairIndexBpe(path), pair_index_bpe.PairIndexBpe(path)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["one", "two,", "Three", "four4", "fünf", "six's", "seven", "ACHT", "9", "zehn"]) for _ in range(8)) for _ in range(40)]
    assert [own.encode_batch([t])[0] for t in texts] == fresh.encode_batch(texts)


def test_pair_index_on_documents(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    slow = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pair_index_bpe.encode_documents(docs, path).collect():
        assert r.ids == " ".join(map(str, slow.encode(texts[r.doc_id], add_special_tokens=False).ids))
    edges = pair_index_bpe.token_digests(edge_docs(spark), path).collect()
    assert len(edges) == len(edge_rows()) and {r.n_tokens for r in edges if r.doc_id in (1, 2, 3)} == {0}
    assert pair_index_bpe.token_digests(no_docs(spark), path).count() == 0
