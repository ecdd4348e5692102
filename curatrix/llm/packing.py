"""Best-fit packing of token pieces into sequences, mended by swap-based local search.

Texts become ids in tasks, and what leaves a task is one short row for each piece. Pieces that fill a sequence are done.
All others are dealt into groups of bounded size; each group is packed by best fit and then mended: a document moves to
another bin, or is exchanged for one or two of its documents, whenever that increases the sum of squared fills, until bins
empty or nothing grows. The emptiest bins of all groups then meet in further, ever fewer groups, down to a single one.
"""

from __future__ import annotations

import heapq
import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialise

CAPACITY = 2048
END_ID = 0
#: A group has about so many pieces, less than twice as many, or more where that would not fill so many sequences. Of each group
#: this share of the tokens, in its emptiest bins, is packed once more with that of others.
GROUP_PIECES, GROUP_BINS, HANDED_ON = 10_000, 64, 1 / 16
#: Words whose ids a worker remembers.
REMEMBERED = 1_250_000

#: The white space that the tokenizer drops, and how it cuts the rest.
WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS = string.punctuation
#: Words that are not composed already, or not lowered letter by letter, or have a special token, are encoded as they are.
SPECIAL = re.compile("[^\x00-\u024f]|İ|<\\|")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(low: str) -> tuple | list:
    """A word in lower case cut as PIECE does; most that are not all letters are letters and then marks."""
    body = low.rstrip(MARKS)
    return (body, low[len(body) :]) if body.isalpha() else PIECE.findall(low)


class Encoder:
    """A text's ids as bytes (little-endian, 4 an id). White space parts a text into words that are encoded alone, so
    every word is encoded once as long as it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str], together: int = 200) -> list[bytes]:
        """Runs of letters, many in one call; each ends with its own id."""
        out: list[bytes] = []
        groups = [runs[i : i + together] for i in range(0, len(runs), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(at, at[1:])] if len(at) == len(group) + 1 else self._encode(group)
        return out

    def learn(self, new: set[str]) -> None:
        plain = list(new)
        if SPECIAL.search("\n".join(plain)):
            plain = [w for w in plain if not SPECIAL.search(w)]
        low = "\n".join(plain).lower().split("\n") if plain else []
        cut = [(w,) if w.isalpha() else pieces_of(w) for w in low]
        parts = set(chain.from_iterable(cut)) - self.parts.keys()
        runs = [p for p in parts if p.isalpha()]
        self.parts.update(zip(runs, self._encode_runs(runs)))
        others = list(parts.difference(runs))
        self.parts.update(zip(others, self._encode(others)))
        known, words = self.parts, self.words
        for w, x in zip(plain, cut):
            n = len(x)
            words[w] = known[x[0]] if n == 1 else known[x[0]] + known[x[1]] if n == 2 else b"".join([known[p] for p in x])
        if len(plain) < len(new):
            rest = list(new.difference(plain))
            words.update(zip(rest, self._encode(rest)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One after the other, a bounded stretch of text at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 21):
                size += len(texts[end])
                end += 1
            if len(self.words) > REMEMBERED or len(self.parts) > REMEMBERED:
                self.words, self.parts = {}, {}
            words = [words_of(t) for t in texts[at:end]]
            self.learn(set().union(*words) - self.words.keys())
            get = self.words.__getitem__
            for x in words:
                yield b"".join(map(get, x))
            at = end


def words_of(text: str) -> list[str]:
    """What the tokenizer's white space leaves; Python's own takes four control characters for white space too."""
    return WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


ENCODERS: dict[str, Encoder] = {}


def _cut(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.setdefault(path, Encoder(path)) if path not in ENCODERS else ENCODERS[path]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t.as_py() or "" for t in batch.column(1)])):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    out.append((doc_id, piece, start, min(capacity, n - start), zlib.crc32(ids[4 * start : 4 * (start + capacity)])))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, capacity), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fits := open_rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        if room > n:
            open_rooms |= 1 << (room - n)
    return bins


def exchangeable(bin_lengths: list[int], capacity: int) -> int:
    """What a bin can give back for one document, as bits: bit s for nothing, one document or two of s tokens together."""
    ones = 0
    twos = 0
    for n in bin_lengths:
        twos |= ones << n
        ones |= 1 << n
    return (1 | ones | twos) & ((1 << capacity) - 1)


def taken_in(give: int, room: int) -> int:
    """The lengths, as bits, of documents that a bin with so much room and give can take so that it gets fuller."""
    out, reach = give << 1, 1
    while reach < room:
        step = min(reach, room - reach)
        out |= out << step
        reach += step
    return out


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins of the same documents. The emptiest bin gives a document away, or takes one or two shorter ones for it, so
    that the sum of squared fills grows with every step; bins that end up empty go. Bins with the same room are looked
    through together: what any of them ever could give back is known as bits, so that hardly any is tried in vain."""
    bins = [list(b) for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(lengths) // capacity)
    give = [exchangeable([lengths[i] for i in b], capacity) for b in bins]
    by_room: dict[int, set[int]] = {}
    any_give: dict[int, int] = {}  # of each room, what its bins give or once gave
    refused = 0  # lengths that no bin can take, as bits
    queue: list[tuple[int, int]] = []

    def enter(b: int) -> None:
        nonlocal refused
        if room := capacity - fill[b]:
            by_room.setdefault(room, set()).add(b)
            any_give[room] = any_give.get(room, 0) | give[b]
            refused &= ~taken_in(give[b], room)
            heapq.heappush(queue, (fill[b], b))

    def change(b: int, out: tuple, into: tuple) -> None:
        if room := capacity - fill[b]:
            by_room[room].discard(b)
        bins[b] = [i for i in bins[b] if i not in out] + list(into)
        fill[b] += sum(lengths[i] for i in into) - sum(lengths[i] for i in out)
        if bins[b]:
            give[b] = exchangeable([lengths[i] for i in bins[b]], capacity)
            enter(b)

    def best_for(n: int, source: int) -> tuple[int, int] | None:
        """(target, tokens given back) for a document of n tokens, with the most room first."""
        nonlocal refused
        unfit = False
        for room in sorted(by_room, reverse=True):
            low = max(0, n - room)
            window = (1 << n - low) - 1
            if not any_give[room] >> low & window:
                continue
            for t in by_room[room]:
                if found := give[t] >> low & window:
                    back = low + (found & -found).bit_length() - 1
                    if t != source and fill[t] + n - back > fill[source]:  # squared fills grow
                        return t, back
                    unfit = True
        if not unfit:
            refused |= 1 << n
        return None

    for b in range(len(bins)):
        enter(b)
    alive, changed = len(bins), False
    while alive > least and (queue or changed):
        if not queue:  # once more, as bins that could not be helped before may be now
            queue, changed = sorted((fill[b], b) for b in range(len(bins)) if bins[b] and fill[b] < capacity), False
        was, source = heapq.heappop(queue)
        if not bins[source] or fill[source] != was:
            continue  # it has changed since
        for doc in sorted(bins[source], key=lambda i: (-lengths[i], i)):
            n = lengths[doc]
            if refused >> n & 1:
                continue
            if not (found := best_for(n, source)):
                continue
            target, back = found
            returned = given_back(bins[target], lengths, back)
            change(source, (doc,), returned)
            change(target, returned, (doc,))
            alive -= not bins[source]
            changed = True
            break
    return [b for b in bins if b]


def given_back(inside: list[int], lengths: list[int], tokens: int) -> tuple:
    """None, one or two of the documents inside that have so many tokens together."""
    if not tokens:
        return ()
    seen: dict[int, int] = {}
    for i in inside:
        if lengths[i] == tokens:
            return (i,)
    for i in inside:
        if (j := seen.get(tokens - lengths[i])) is not None:
            return (j, i)
        seen[lengths[i]] = i
    raise ValueError("no such documents")


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, group_bins: int = GROUP_BINS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text and then END_ID; a null text is empty, so every document has a piece. Only what
    is longer than capacity is cut. Rows that repeat an id, or have none, are packed one by one like all others. Other
    columns are ignored; an empty table gives an empty result.
    """
    cut = materialise(token_pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return whole.unionByName(pack_pieces(cut.filter(F.col("length") < capacity), capacity, group_pieces, group_bins))


def pack_pieces(rest: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, group_bins: int = GROUP_BINS) -> DataFrame:
    """The rows of rest, whose column length is less than capacity, with sequence_id (odd) and offset."""
    kind = rest.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    done, level = None, 0
    while True:
        size = rest.agg(F.count("*").alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        groups = max(1, min(size["pieces"] // group_pieces, size["tokens"] // (capacity * group_bins)))
        packed_ = _pack_level(rest, kind, capacity, groups, level)
        if groups == 1:
            return packed_.drop("open") if done is None else done.unionByName(packed_.drop("open"))
        packed_ = materialise(packed_, "packed")
        closed = packed_.filter("not open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        rest, level = packed_.filter("open").drop("open", "sequence_id", "offset"), level + 1


def _pack_level(rest: DataFrame, kind: str, capacity: int, groups: int, level: int) -> DataFrame:
    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([c for c in ("length", "doc_id", "piece", "ids_crc32") if c in rows], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        share = sum(lengths) * HANDED_ON if groups > 1 else 0
        found = sorted(((sum(lengths[i] for i in b), b) for b in pack(lengths, capacity)), key=lambda x: x[0])
        for b, (fill, inside) in enumerate(found):
            at = 0
            for i in inside:
                sequence[i], offset[i] = b, at
                at += lengths[i]
            if fill <= share and fill < capacity:
                left[inside] = True
                share -= fill
        first = (level << 36) + int(rows["deal"].iloc[0])
        return rows.drop(columns="deal").assign(sequence_id=2 * ((first << 20) + sequence) + 1, offset=offset, open=left)

    dealt = rest.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(pack_group, kind + ", sequence_id long, offset long, open boolean")
