"""Runs with a period, repair of conversations and pieces with offsets, against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from edge_tables import edge_docs, ids, no_docs

from factweave.llm import offset_pieces, period_runs, queries, turn_repair

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACES = "[\x20\x09-\x0d]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- runs ----------------------------------------------------------------------------


def plain_runs(own):
    """``start, period, length`` by trying every period at every place."""
    runs = {}
    for q in range(1, len(own) // 4 + 1):
        i = 0
        while i < len(own) - q:
            if own[i] != own[i + q]:
                i += 1
                continue
            j = i
            while j < len(own) - q and own[j] == own[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                runs.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in runs.items())


def joined(pieces):
    """The stitching in plain Python."""
    runs = {}
    for p in sorted({f[0] for f in pieces}):
        held = []
        for _, s, e in sorted(f for f in pieces if f[0] == p):
            if held and s + p <= held[-1][1]:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([s, e])
        for s, e in held:
            if e - s >= max(6, 4 * p):
                runs.setdefault((s, e), p)
    return sorted((s, q, e - s) for (s, e), q in runs.items())


def test_fragments_hold_all_runs():
    rng = random.Random(3)
    for t in range(3000):
        n = rng.randint(0, 400 if t % 20 == 0 else 60)
        own = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                for i in range(a, min(n, a + rng.randint(1, n))):
                    own[i] = own[a + (i - a) % p]
        assert joined(period_runs.fragments(np.array(own, np.int64))) == plain_runs(own), own


def plain_digests(doc_id, text, plant=True):
    words = [w for w in re.split(SPACES + "+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 3000 else []
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    first = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {i for i, t in docs if len((t or "").split()) < 3000}
    got = [tuple(r) for r in queries.QUERIES["op11_tiled_period_runs"](spark, sf).collect() if r.doc_id in short]
    want = [plain_digests(i, t) for i, t in docs if i in short]
    assert sorted(got) == sorted(want)
    assert len(short) > 150 and sum(r[1] > 0 for r in want) > 10


def test_run_edges(spark):
    docs = edge_docs(spark)
    got = period_runs.collapse_runs(docs).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [i for i in ids(docs) if i is not None] and sum(r.doc_id is None for r in got) == 1
    assert {tuple(map(tuple, r.runs)) for r in got if r.doc_id in (1, 2, 3)} == {()} and {r.collapsed for r in got if r.doc_id in (1, 2, 3)} == {""}
    assert period_runs.run_digests(no_docs(spark)).count() == 0
    same = spark.createDataFrame([(1, "a b " * 9), (1, "a b " * 9), (2, "x " * 5), (3, "x " * 6 + "y"), (4, "w " * 3000)], "doc_id long, text string")
    got = sorted((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in period_runs.collapse_runs(same).collect())
    assert got == [(1, ((0, 2, 18),), "a b"), (1, ((0, 2, 18),), "a b"), (2, (), "x x x x x"), (3, ((0, 1, 6),), "x y"), (4, ((0, 1, 3000),), "w")]


# ---- repair --------------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(turns, inserts=3):
    """Least cost and audit over all edits with at most so many insertions."""
    best = (10**9, "")

    def go(i, out, audit, cost, left):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and GRAMMAR.match(out):
            best = min(best, (cost, audit))
        for c in "ua" if left else "":
            go(i, out + c, audit + "I", cost + 5, left - 1)
        if i < len(turns):
            initial, gone, cut = turns[i]
            go(i + 1, out, audit + "D", cost + 2, left)
            if not gone:
                go(i + 1, out + (initial or "?"), audit + "K", cost + 5 * cut, left)
                for c in "ua":
                    go(i + 1, out + c, audit + "R", cost + 1 + 5 * cut, left)

    go(0, "", "", 0, inserts)
    return best


def some_turns(rng, n):
    turns = [(rng.choice(["u", "a", "u", "a", "s", " ", ""]), rng.random() < 0.15) for _ in range(n)]
    return [(x, g, not g and rng.random() < 0.3) for x, g in turns]


def test_repair_is_brute_force_at_every_fragment_size():
    rng = random.Random(5)
    for _ in range(500):
        turns = some_turns(rng, rng.randint(0, 5))
        want = plain_repair(turns)
        assert [turn_repair.repair(turns, size) for size in (256, 1, 2, 3)] == [want] * 4, turns
    for _ in range(40):
        turns = some_turns(rng, rng.randint(20, 80))
        assert len({turn_repair.repair(turns, size) for size in (1, 5, 16, 256)}) == 1


def plain_report(conv, rows):
    """``rows``: turn, role, text."""
    after = []
    for turn, role, text in sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r)):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    seen, turns, faults = set(), [], [0, 0, 0]
    for _, role, text in after:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        turns.append((role[:1], fault in (0, 1), fault == 2))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    known = [t for t, _, _ in after if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = plain_repair(turns, 2)
    out, at = [], 0
    for edit in audit:
        role = "user" if sum(r[:1] in "ua" for r, _ in out) % 2 == 0 else "assistant"
        if edit == "I":
            out.append((role, ""))
            continue
        _, own, text = after[at]
        at += 1
        if edit != "D":
            out.append((own if edit == "K" else role, text))
    return (conv, gaps, *faults, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def test_repair_query_is_brute_force(spark, sf):
    by_conv = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = sorted(tuple(r) for r in queries.QUERIES["op12_turn_alignment"](spark, sf).collect())
    assert got == sorted(plain_report(c, rows) for c, rows in by_conv.items())


def test_repair_edges(spark):
    kinds = "conv_id long, turn long, role string, text string, row int, copy int, lost string, audit int"
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (1, None, None, None), (1, None, "user", "x."), (2, 3, "user", ""), (2, 9, "assistant", " \n"),
            (3, 0, "system", "s."), (4, 0, "", "no role."), (5, 0, "user", "long " * 50_000 + "."), (5, 1, "assistant", "y."), (5, 1, "assistant", "y.")]
    rows += [(6, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(1500)]
    got = sorted((tuple(r) for r in turn_repair.repair_report(spark.createDataFrame([(*r, 1, 2, "l", 3) for r in rows], kinds)).collect()), key=str)
    by_conv = {}
    for c, *r in rows:
        by_conv.setdefault(c, []).append(tuple(r))
    assert sorted(map(str, (g for g in got if g[0] != 6))) == sorted(str(plain_report(c, r)) for c, r in by_conv.items() if c != 6)
    assert turn_repair.repair_report(spark.createDataFrame([], kinds)).count() == 0
    whole = turn_repair.repair_report(spark.createDataFrame([(6, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(600)], "conv_id long, turn long, role string, text string"), damage=False).first()
    assert tuple(whole)[1:8] == (0, 0, 0, 0, 0, 0, "K" * 600)


# ---- pieces --------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(1)
    some = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "日", "😀", "\x00", "1", ".", "\t", "<s>", "<0x0A>", "́", "ß", "가", " ⁇ "]
    odd = ["", " ", "   a", "a  ", "▁▁a", "日本語 テキスト", "x" * 5000, " " * 100 + "the", "\r\n", "<s> </s> <unk>"]
    odd += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return odd + ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(1000)]


def test_pieces_are_the_librarys():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), offset_pieces.loaded(MODEL)
    texts = odd_texts()
    for text, want, (decimal, got, offsets, decoded) in zip(texts, library.encode(texts), own.encode_batch(texts)):
        assert got.tolist() == want and decimal == ",".join(map(str, want))
        assert decoded == own.decode(want) == library.decode(want)
        raw = text.encode()
        spans = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
        assert "".join(spans) == text and spans == [p.surface for p in library.encode(text, return_type="proto").pieces]


def test_compiled_map_is_the_librarys():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        spec = dict(offset_pieces._fields(dict(offset_pieces._fields(library.serialized_model_proto()))[offset_pieces.NORMALIZER]))
        with open(MODEL, "rb") as f:
            own = offset_pieces.OffsetPieces(f.read())
        own.map, own.squeeze = offset_pieces.CharacterMap(spec[2]), True
        for text in odd_texts():
            want, places = library.normalize(text, with_offsets=True)
            got, at = own.normalize(text)
            raw = text.encode()
            assert got == want
            assert not got or [len(raw[:k].decode("utf-8", "ignore")) for k in at.tolist()] == list(places)


def test_piece_query_and_edges(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs, got in (
        (spark.read.parquet(f"{sf}/documents.parquet"), queries.QUERIES["op13_offset_pieces"](spark, sf)),
        (edge_docs(spark), offset_pieces.piece_digests(edge_docs(spark), MODEL)),
    ):
        want = []
        for r in docs.collect():
            found = library.encode(r.text or "")
            want.append((r.doc_id, len(found), sha(",".join(map(str, found))), sha(library.decode(found)), len((r.text or "").encode())))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert offset_pieces.piece_digests(no_docs(spark), MODEL).count() == 0
