"""Token counts by rank-synchronous merging of arrays.

Texts are cut into pre-tokens as the tokenizer's file says. The distinct ones of a stretch of texts lie one after another in
ragged numpy arrays, a symbol a byte. In each round every sequence merges its own pair of lowest rank, wherever it stands, all
sequences at once; a sequence without a pair that merges is done, and its surviving symbols are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.packing import default_tokenizer, words_of

LIMIT = 2048
#: Pre-tokens and words whose counts a worker remembers, characters of the texts that are counted together, and of the words that are cut together.
REMEMBERED, STRETCH, TOGETHER = 1_000_000, 1 << 21, 1 << 16
NEVER = np.int32(2**31 - 1)
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1, else the
    next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """The pairs that merge, by rank, as sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.size = max(vocabulary.values()) + 1
        pairs = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        # A merge whose result takes part in one of lower rank must wait for that one before it is made again further right.
        lowest: dict[str, int] = {}
        for r in range(len(merges) - 1, -1, -1):
            lowest[merges[r][0]] = lowest[merges[r][1]] = r
        self.waits = np.array([lowest.get(a + b, len(merges)) < r for r, (a, b) in enumerate(merges)], bool)
        characters = byte_characters()
        self.inner, self.final = np.full(512, -1, np.int32), np.full(512, -1, np.int32)
        for c in characters:
            self.inner[ord(c)], self.final[ord(c)] = vocabulary[c], vocabulary[c + suffix]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank[at], NEVER)

    def surviving(self, pieces: list[str]) -> np.ndarray:
        """The number of symbols that each piece ends with; pieces are not empty, their characters stand for bytes."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        symbols, ends = self.inner[codes], np.cumsum(sizes)
        symbols[ends - 1] = self.final[codes[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        out = sizes.copy()
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(starts, append=len(symbols))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            if done.any():
                out[owner[starts[done]]] = lengths[done]
                alive = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[alive], owner[alive], rank[alive]
                lowest, lengths = lowest[~done], lengths[~done]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = rank == np.repeat(lowest, lengths)
            # Where places overlap, as in a run of one symbol, they are taken from the left.
            places = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(places) > 1))
            run = np.maximum.accumulate(np.where(first, places, 0))
            taken = (places - run) % 2 == 0
            if self.waits[lowest].any():
                leftmost = np.concatenate(([True], owner[places[1:]] != owner[places[:-1]]))
                taken &= leftmost | ~self.waits[rank[places]]
            at = places[taken]
            symbols[at] = self.made[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
            at = at - np.arange(len(at))  # as many symbols are gone before each
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = NEVER
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return out


class Counter:
    """Counts tokens of texts. Where the tokenizer drops white space, words are counted alone and each only once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.by_words = all(" " not in p and "Ġ" not in p for p, _ in self.pre_tokenizer.pre_tokenize_str("a b"))
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.pre_tokenizer.pre_tokenize_str(text) if text else []

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if new:
            self.pieces.update(zip(new, self.merges.surviving(new).tolist()))

    def _learn(self, words: list[str]) -> None:
        """The counts of words that are new: cut many together, told apart by where their pre-tokens start."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) < TOGETHER):
                size += len(words[end]) + 1
                end += 1
            group = words[at:end]
            normal = [self._normal(" ".join(group))]
            lengths = [len(w) for w in normal[0].split(" ")]
            if len(lengths) != len(group):  # a word that is written with white space in normal form
                normal = [self._normal(w) for w in group]
            cut = [self._cut(t) for t in normal]
            self._learn_pieces({p for found in cut for p, _ in found})
            if len(normal) == 1:
                starts = np.cumsum([0] + [n + 1 for n in lengths])
                found = cut[0]
                of = np.searchsorted(starts, [s for _, (s, _) in found], "right") - 1
                counts = np.bincount(of, [self.pieces[p] for p, _ in found], len(group)).astype(np.int64).tolist() if found else [0] * len(group)
            else:
                counts = [sum(self.pieces[p] for p, _ in found) for found in cut]
            self.words.update(zip(group, counts))
            at = end

    def _parts(self, text: str) -> list[str]:
        """A text between the added tokens in it, which are there one fewer."""
        return self.added_pattern.split(text) if self.added_pattern and any(a in text for a in self.added) else [text]

    def count(self, texts: list[str]) -> Iterator[int]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < STRETCH):
                size += len(texts[end])
                end += 1
            if len(self.words) > REMEMBERED or len(self.pieces) > REMEMBERED:
                self.words, self.pieces = {}, {}
            parts = [self._parts(t) for t in texts[at:end]]
            if self.by_words:
                words = [list(chain.from_iterable(map(words_of, p))) for p in parts]
                self._learn(list(set().union(*words) - self.words.keys()))
                for p, w in zip(parts, words):
                    yield len(p) - 1 + sum(map(self.words.__getitem__, w))
            else:
                cut = [[x for part in p for x, _ in self._cut(self._normal(part))] for p in parts]
                self._learn_pieces(set(chain.from_iterable(cut)))
                for p, x in zip(parts, cut):
                    yield len(p) - 1 + sum(map(self.pieces.__getitem__, x))
            at = end


COUNTERS: dict[str, Counter] = {}


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in COUNTERS:
            COUNTERS[path] = Counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array(COUNTERS[path].count([t or "" for t in texts.to_pylist()]), pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    tokenizer is the file of a byte-level BPE of the tokenizers library, by default word_bpe_49k.json; counts are what the
    library gives with add_special_tokens=False, no truncation and no padding, and an added token's string in a text is that
    token. A null text is empty and has no token; a null doc_id stays null; repeated rows stay. Other columns are ignored, and an
    empty table gives an empty result. Nothing is shuffled, and a worker remembers the counts of a bounded number of words.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(tokenizer or default_tokenizer(), limit), COUNTS)
