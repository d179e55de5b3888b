"""Byte-pair encoding with a pair occurrence index, and decoding.

Texts are split into words as the vocabulary file says. For all new words of a batch at once, an index
maps each mergeable pair to all its positions. Ranks that have positions wait in a heap; the least is taken,
its merge is applied at once at all positions still valid, and the lists of the neighbouring pairs are updated.
A merge can only create pairs of higher rank (checked on loading), so each rank is handled once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Known words of a worker; the older half goes when the newer is full.
CACHE_WORDS = 150_000
BATCH_ROWS = 1000

# The characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() takes these for blanks, the vocabulary does not


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    """Encodes and decodes with a vocabulary file of words that end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this vocabulary is normalised or merged in another way")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens.update({i: t for t, i in self.special.items()})
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.names = [str(i) for i in range(len(self.tokens))]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_pattern = regex.compile(pattern.replace(r"\s", SPACES))
        # Python's tables end at some version of Unicode; of later code points only the vocabulary's own library knows the class.
        self.is_later = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.is_later, [False]]))).tolist()
        self.later = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2])) + "]")
        self.library = Tokenizer.from_file(path)
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        created: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            new, left, right = vocab[a + b], vocab[a], vocab[b]
            if max(created.get(left, -1), created.get(right, -1)) >= rank or new in created:
                raise ValueError("a merge uses what a later merge makes")
            created[new] = rank
            ranks[left * self.width + right] = rank
            self.pairs.append((left, right, new))
        self.codes = np.array(sorted(ranks), np.int64)
        self.code_ranks = np.array([ranks[c] for c in self.codes.tolist()], np.int64)
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, list[int]] = {}

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (as UTF-8, not empty), by one index of pairs over all of them."""
        if not words:
            return []
        # A mark of -1 ends each word; it takes the place of one more byte.
        joined = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        stops = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
        codes = self.inner[joined]
        codes[stops - 1] = self.last[joined[stops - 1]]
        codes[stops] = -1
        sym, n = codes, len(codes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Put the mergeable pairs at these places into the index."""
            wanted = sym[places] * self.width + sym[after[places]]
            at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            held = self.codes[at] == wanted
            found = self.code_ranks[at[held]]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[held][order]
            edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else found
            for rank, start, stop in zip(found[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(found)]):
                if rank in index:
                    index[rank].append(places[start:stop])
                else:
                    index[rank] = [places[start:stop]]
                    heappush(heap, rank)

        note(np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0)))
        while heap:
            rank = heappop(heap)
            p = np.concatenate(index.pop(rank))
            left, right, new = self.pairs[rank]
            p = p[(sym[p] == left) & (sym[after[p]] == right)]
            if left == right:
                # Pairs that overlap go from left to right: every other one of a chain.
                p.sort()
                first = np.concatenate([[True], p[1:] != after[p[:-1]]]) if len(p) else np.empty(0, bool)
                at = np.arange(len(p))
                p = p[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            q = after[p]
            sym[p], sym[q] = new, -2
            r = after[q]
            after[p], before[r] = r, p
            o = before[p]
            note(np.unique(np.concatenate([o[sym[o] >= 0], p[sym[r] >= 0]])))
        ids = sym[sym >= 0].tolist()
        ends = np.cumsum(sym >= 0)[stops].tolist()
        return [ids[x:y] for x, y in zip([0, *ends[:-1]], ends)]

    def _learn(self, chunks: set[str]) -> None:
        """Put the encodings of new chunks (texts without blanks) into the cache."""
        split, new_words = {}, {}
        others = [c for c in chunks if not c.isascii()]
        points = np.frombuffer("".join(others).encode("utf-32-le", "surrogatepass"), "<u4")
        later = self.later.search if self.is_later[points].any() else None
        for chunk in chunks:
            if chunk.isascii():
                found = self.word_pattern.findall(chunk.lower())
            elif later and later(chunk):
                found = self._words_of_library(chunk)
            else:
                # A capital sigma is lowered without regard to its place in the word.
                found = self.word_pattern.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
            split[chunk] = found
            for word in found:
                if word not in self.words:
                    new_words[word] = None
        if len(self.words) + len(new_words) > 2 * CACHE_WORDS:
            self.words = {}
            new_words = {w: None for found in split.values() for w in found}
        names = list(new_words)
        self.words.update(zip(names, self.encode_words([w.encode("utf-8", "surrogatepass") for w in names])))
        numbers, shown, known = self.names.__getitem__, self.tokens.__getitem__, self.words
        for chunk, found in split.items():
            ids = known[found[0]] if len(found) == 1 else [i for word in found for i in known[word]]
            self.young[chunk] = (" ".join(map(numbers, ids)), len(ids), " ".join(map(shown, ids)))

    def _words_of_library(self, chunk: str) -> list[str]:
        """Words of a text as the vocabulary's own normaliser and splitter find them; merges stay ours."""
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, part)).decode("utf-8") for part, _ in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks: the vocabulary names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encode_batch(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its decimal ids joined by blanks, their number, and the decoded text."""
        rows = [self._chunks(t) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        unknown = set()
        for row in rows:
            unknown.update(row)
        unknown.difference_update(self.young)
        for chunk in [c for c in unknown if c in self.old]:
            self.young[chunk] = self.old[chunk]
            unknown.discard(chunk)
        for name in unknown & self.special.keys():
            self.young[name] = (str(self.special[name]), 1, name)
            unknown.discard(name)
        self._learn(unknown)
        out, known = [], self.young
        for row in rows:
            parts = list(map(known.__getitem__, row))
            if parts:
                ids, counts, decoded = zip(*parts)
                if 0 in counts:
                    parts = [p for p in parts if p[1]]
                    ids, counts, decoded = zip(*parts) if parts else ((), (), ())
                out.append((" ".join(ids), sum(counts), " ".join(decoded)))
            else:
                out.append(("", 0, ""))
        return out

    def _chunks(self, text: str) -> list[str]:
        if self.special_pattern and "<|" in text:
            out: list[str] = []
            for part in self.special_pattern.split(text):
                out += [part] if part in self.special else self._split(part)
            return out
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=2)
def loaded(path: str) -> PairIndexBpe:
    """One encoder per worker process, so that its known words serve all its tasks."""
    return PairIndexBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: decimal ids joined by one blank, and what they decode to.

    Whole texts are encoded; a null text counts as empty, with no ids. Repeated rows come out repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = loaded(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids, counts, decoded = zip(*bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    coded = encode_documents(docs, vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
