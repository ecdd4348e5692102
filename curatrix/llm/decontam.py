"""Benchmark decontamination by latent semantic retrieval.

Every text is read once and stored as the numbers of its words. Document passages and benchmark items become TF-IDF vectors
over the benchmark's words. A randomised SVD, whose sketch is summed over the cluster, gives one latent space of RANK
dimensions for the whole benchmark. Every passage of every document is compared with every item by its cosine there, inside
the task that has read its words. What is near enough is checked at once against the words themselves: the longest common
subsequence with the item, and the item's rare words, which stand for its answer. Only links that pass leave the tasks. A
benchmark of more than BLOCK_WORDS words is searched for in several passes, in the same space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialise

#: A passage has two neighbouring half passages of so many words; items are cut into queries of as many at most.
HALF = 32
RANK = 128
#: Items are searched for in passes of about so many words; so many queries are compared with a stretch of text at once.
BLOCK_WORDS, QUERIES = 1 << 20, 4096
#: The words that the space knows: those that most items have. Queries without any are looked up in every passage.
VOCABULARY = 200_000
#: A query that fills a share of a passage has a cosine of about the root of that share, if it stands there; this part of that is
#: near enough. By recall on short and long items, planted whole and changed; what is checked in vain costs little.
NEAR = 0.5
#: Shares of the item's words that must occur in its order, and of its answer's words that must occur, in a region.
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
#: An item's answer are its words with this share of its highest inverse document frequency; there is no answer column.
CONTENT = 0.7
#: An item of more words is found if one of its sections of at most so many is.
SECTION = 128
#: Items with fewer words must occur as they are.
FEW_WORDS = 5
LINKS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
#: So many words of a text are held as vectors at once.
STRETCH = 1 << 16
#: So many half passages are summed up together.
IN_CACHE = 64
#: Candidates whose words are looked up together.
TOGETHER = 1 << 15

SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; what is not ASCII counts as a letter."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SEPARATORS).split()


def lcs(item: list[int], region: list[int]) -> int:
    """The length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(item)) - 1
    for w in region:
        if m := masks.get(w):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(item) - row.bit_count()


@dataclass
class Space:
    """The benchmark's words, and where each lies in the latent space."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    unseen: float  # the idf of words that the space does not know
    basis: np.ndarray  # (words, RANK), times idf


def numbered(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))


class Block:
    """Items that are searched for in one pass: their words as numbers, their queries, and what stands for their answers."""

    def __init__(self, space: Space, rows: list[tuple[int, str | None]]):
        known = len(space.vocabulary)
        self.vocabulary = dict(space.vocabulary)  # and words that only this block knows
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        for item_id, text in rows:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for section in cut_evenly(found, SECTION):
                self.ids.append(item_id)
                self.words.append(section)
        self.basis = np.zeros((len(self.vocabulary), space.basis.shape[1]), np.float32)
        self.basis[:known] = space.basis
        idf = np.concatenate([space.idf, np.full(len(self.vocabulary) - known, space.unseen)])
        parts = [(k, part) for k, words in enumerate(self.words) for part in cut_evenly(words, HALF)]
        self.owner = np.array([k for k, _ in parts], int)
        sums = np.stack([self.basis[part].sum(0) for _, part in parts]) if parts else np.zeros((0, self.basis.shape[1]), np.float32)
        self.queries = _unit(sums)
        self.least = NEAR * np.sqrt(np.array([len(part) for _, part in parts]) / (2 * HALF)).astype(np.float32)
        self.least[~sums.any(axis=1)] = -2.0  # without a place in the space, so anything may be near
        self.answers = [frozenset(x for x in w if idf[x] >= CONTENT * max(idf[y] for y in w)) for w in self.words]
        self.sets = [frozenset(w) for w in self.words]

    def numbers(self, text: str | None) -> np.ndarray:
        return numbered(text, self.vocabulary)


def cut_evenly(words: list[int], most: int) -> list[list[int]]:
    """Runs of at most so many words, of about the same length."""
    n = -(-len(words) // most)
    cuts = np.linspace(0, len(words), n + 1).round().astype(int).tolist() if n else []
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w for t in batch.column(0) for w in set(words_of(t.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])


def _number_type(vocabulary: dict[bytes, int]) -> np.dtype:
    """The smallest type for the numbers of a vocabulary, and -1."""
    return np.min_scalar_type(-max(1, len(vocabulary)))


def _numbering(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.value
        kind = _number_type(vocabulary)
        for batch in batches:
            ids, held, size, first = batch.column(0), [], 0, 0
            for i, t in enumerate(batch.column(1)):
                held.append(numbered(t.as_py(), vocabulary).astype(kind).tobytes())
                size += len(held[-1])
                if size >= STRETCH * kind.itemsize or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([ids[first : i + 1], pa.array(held, pa.binary())], ["doc_id", "words"])
                    held, size, first = [], 0, i + 1

    return run


def in_numbers(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, words) of (id, text): each text's words as numbers, -1 where the vocabulary has none, in _number_type."""
    words = texts.sparkSession.sparkContext.broadcast(vocabulary)
    return texts.mapInArrow(_numbering(words), "doc_id long, words binary")


def _document_counts(n_words: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words, np.int64)
        for batch in batches:
            for _, found in _stretches(batch.column(0), kind):
                word, text = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
                once = np.unique((text * n_words + word)[word >= 0])
                total += np.bincount(once % n_words, minlength=n_words)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["word", "n"])

    return run


def _placed(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half passage and the number of each known word, and the number of halves before each text and after the last."""
    first = np.concatenate(([0], np.cumsum([-(-len(x) // HALF) for x in found]))).astype(np.int64)
    half = np.concatenate([np.arange(len(x)) // HALF + at for x, at in zip(found, first)]) if found else np.zeros(0, int)
    word = np.concatenate(found) if found else np.zeros(0, np.int32)
    known = word >= 0
    return half[known], word[known], first


def _counted(half: np.ndarray, word: np.ndarray, halves: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """IN_CACHE half passages, the words there, and how often each of these occurs in each of them."""
    bounds = np.searchsorted(half, np.arange(0, halves + IN_CACHE, IN_CACHE))
    for first, a, b in zip(range(0, halves, IN_CACHE), bounds, bounds[1:]):
        n = min(IN_CACHE, halves - first)
        here, place = np.unique(word[a:b], return_inverse=True)
        counts = np.bincount((half[a:b] - first) * len(here) + place, minlength=n * len(here))
        yield slice(first, first + n), here, counts.reshape(n, -1).astype(np.float32)


def _halves(found: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the weights of each half passage's words, and of each text the number of its halves."""
    half, word, first = _placed(found)
    sums = np.zeros((first[-1], weights.shape[1]), np.float32)
    for rows, here, counts in _counted(half, word, int(first[-1])):
        np.matmul(counts, weights[here], out=sums[rows])
    return sums, np.diff(first)


def _passages(halves: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each half with the next one of its text; a text's last half stands alone."""
    out = halves.copy()
    if len(out) > 1:
        goes_on = np.ones(len(out), bool)
        goes_on[np.cumsum(n[n > 0]) - 1] = False
        goes_on[-1] = False
        at = np.flatnonzero(goes_on)
        out[at] += halves[at + 1]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _stretches(batch_words, kind: np.dtype) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(row, numbers) of texts, so many words together; a long text is a stretch of its own."""
    rows, found, size = [], [], 0
    for i, t in enumerate(batch_words):
        x = np.frombuffer(t.as_py(), kind).astype(np.int32)
        if found and size + len(x) > STRETCH:
            yield rows, found
            rows, found, size = [], [], 0
        rows.append(i)
        found.append(x)
        size += len(x)
    if found:
        yield rows, found


def _cut_long(x: np.ndarray) -> list[np.ndarray]:
    """A text in cuts that overlap by a half passage, so that vectors of a very long one need bounded memory."""
    step = STRETCH // HALF * HALF
    return [x[at : at + step + HALF] for at in range(0, max(1, len(x)), step)]


def _sketch(started, kind: np.dtype):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, start = started.value
        total = np.zeros(start.shape, np.float32)
        weights = np.concatenate([start * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32)
        for batch in batches:
            for _, found in _stretches(batch.column(0), kind):
                half, word, first = _placed(found)
                for _, here, counts in _counted(half, word, int(first[-1])):
                    sums = counts @ weights[here]
                    total[here] += counts.T @ (sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9))  # both sides scaled to unit length
        used = np.flatnonzero(total.any(axis=1))
        rows = total[used] * idf[used, None]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(rows), pa.list_(pa.float32()))], ["word", "row"])

    return summed


def benchmark_words(benchmark: DataFrame) -> dict[bytes, int]:
    """The VOCABULARY words that most items have, numbered."""
    counted = benchmark.select("text").mapInArrow(_item_words, "word binary").groupBy("word").agg(F.count("*").alias("n"))
    words = sorted(bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect())
    return {w: i for i, w in enumerate(words)}


def fitted(docs: DataFrame, benchmark: DataFrame, rank: int, total: int) -> Space:
    """The latent space of all the benchmark's words, fitted on every document and item."""
    words = benchmark_words(benchmark)
    return fitted_on_numbers(in_numbers(docs.select("doc_id", "text"), words), benchmark, words, rank, total)


def fitted_on_numbers(docs: DataFrame, benchmark: DataFrame, vocabulary: dict[bytes, int], rank: int, total: int) -> Space:
    """As fitted, of documents in_numbers. What reaches the driver has a row for each of VOCABULARY words at most."""
    sc = docs.sparkSession.sparkContext
    n_words, kind = len(vocabulary), _number_type(vocabulary)
    counts = docs.select("words").mapInArrow(_document_counts(n_words, kind), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n_words)
    df[counts["word"].to_numpy(int)] = counts["n"].to_numpy()
    space = Space(vocabulary, np.log((total + 1) / (df + 1)) + 0.05, float(np.log(total + 1)) + 0.05, np.zeros((n_words, 0), np.float32))
    rank = min(rank, n_words)
    if not rank:
        return space
    omega = np.random.default_rng(7).standard_normal((n_words, rank)).astype(np.float32)
    started = sc.broadcast((space.idf.astype(np.float32), omega))

    def sketch(texts: DataFrame) -> np.ndarray:
        sums = texts.select("words").mapInArrow(_sketch(started, kind), "word int, row array<float>").groupBy("word").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(rank)]).alias("row")).toPandas()
        y = np.zeros((n_words, rank))
        if len(sums):
            y[sums["word"].to_numpy(int)] = np.stack(sums["row"].to_numpy())
        return y / max(np.linalg.norm(y), 1e-9)

    # The items themselves are rows of the matrix too, so that their words span the space; scaled to weigh like the documents.
    y = sketch(docs) + 3 * sketch(in_numbers(benchmark.select("item_id", "text"), vocabulary))
    # Nystrom: from the sketch of the Gram matrix to its leading singular vectors.
    core = omega.T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > values.max() * 1e-8
    u, _, _ = np.linalg.svd(y @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    space.basis = (u * space.idf[:, None]).astype(np.float32)
    return space


def check_words(items: Block, k: int, x: np.ndarray, at: int) -> tuple[float, float]:
    """Of item k and the passage of text x that begins at word at: shares of the item in order, and of its answer, in the
    best region. Every place where a word of the item stands may begin it."""
    item = items.words[k]
    region = x[max(0, at - len(item)) : at + 2 * HALF + len(item)].tolist()
    if len(item) < FEW_WORDS:
        whole = any(region[i : i + len(item)] == item for i in range(len(region)))
        return (1.0, 1.0) if whole else (0.0, 0.0)
    if lcs(item, region) < LCS_SHARE * len(item):
        return 0.0, 0.0
    length = len(item) + len(item) // 2 + 2  # what is spread further is no passage
    own, answer = items.sets[k], items.answers[k]
    best, s = (0, 0), 0
    while s < len(region):
        if region[s] not in own:
            s += 1
            continue
        inside = region[s : s + length]
        n = lcs(item, inside)
        if n >= best[0]:
            best = max(best, (n, len(answer & set(inside))))
        if best == (len(item), len(answer)) or s + length > len(region):
            break  # later ones have less
        s += max(1, best[0] - n)  # one word further on, at most one more is in order
    return best[0] / len(item), best[1] / len(answer)


def _flat(lists: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists one behind the other, with where each begins and its length."""
    lists = [list(x) for x in lists]
    size = np.array([len(x) for x in lists])
    return np.array([w for x in lists for w in x], np.int64), np.cumsum(size) - size, size


def _held(occurs: np.ndarray, halves: int, low: np.ndarray, high: np.ndarray, k: np.ndarray, lists: tuple) -> np.ndarray:
    """The share of list k whose words occur from half passage low up to high; occurs: word x halves + half passage of every
    word, ascending. The first place from low on tells."""
    flat, start, size = lists
    n = size[k]
    begin = np.cumsum(n) - n
    word = flat[np.repeat(start[k] - begin, n) + np.arange(n.sum())] * halves
    next_place = occurs[np.searchsorted(occurs, word + np.repeat(low, n))]
    return np.add.reduceat(next_place < word + np.repeat(high, n), begin, dtype=np.int64) / n


def _may_pass(found: list[np.ndarray], at: np.ndarray, k: np.ndarray, answers: tuple, words: tuple) -> np.ndarray:
    """Which candidates (half passage at, ascending, item k) have enough of the item's words and of its answer's in the
    region that check_words reads. A share in order is no more than the share that occurs, so none that passes is lost."""
    half, word, bound = _placed(found)
    halves = int(bound[-1]) + 1
    occurs = np.append(np.sort(word * np.int64(halves) + half), np.iinfo(np.int64).max)
    text = np.searchsorted(bound, at, side="right") - 1
    reach = -(-words[2][k] // HALF)
    low, high = np.maximum(bound[text], at - reach), np.minimum(bound[text + 1], at + 2 + reach)
    out = np.zeros(len(at), bool)
    for c in range(0, len(at), TOGETHER):
        some = np.arange(c, min(len(at), c + TOGETHER))
        for lists, least in ((answers, ANSWER_SHARE), (words, LCS_SHARE)):
            if len(some):
                some = some[_held(occurs, halves, low[some], high[some], k[some], lists) >= least]
        out[some] = True
    return out


def _near(passages: np.ndarray, items: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half passage, query, cosine) of what is near enough, ascending."""
    found = []
    for q in range(0, len(items.queries), QUERIES):
        near = passages @ items.queries[q : q + QUERIES].T
        at = np.flatnonzero(near >= items.least[q : q + QUERIES])  # much faster than the places of a table
        p, k = np.divmod(at, near.shape[1])
        found.append((p, k + q, near.ravel()[at]))
    p, q, c = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(p, kind="stable")
    return p[order], q[order], c[order]


def _search(items):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Block = items.value
        answers, words, kind = _flat(it.answers), _flat(it.words), _number_type(it.vocabulary)
        for batch in batches:
            ids = batch.column(0)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for rows, found in _stretches(batch.column(1), kind):
                whole = found
                cuts = [(r, x, 0) for r, x in zip(rows, found)]
                if len(found) == 1:
                    step = STRETCH // HALF * HALF
                    cuts = [(rows[0], c, i * step) for i, c in enumerate(_cut_long(found[0]))]
                for group in ([cuts] if len(found) > 1 else [[c] for c in cuts]):
                    halves, n = _halves([c[1] for c in group], it.basis)
                    if not len(halves):
                        continue
                    p, q, cosine = _near(_unit(_passages(halves, n)), it)
                    able = _may_pass(whole, p + group[0][2] // HALF, it.owner[q], answers, words)
                    first = np.concatenate(([0], np.cumsum(n)))
                    text = np.searchsorted(first, p, side="right") - 1
                    seen: dict[tuple[int, int, int], float] = {}
                    for i, t, j, c in zip(p[able].tolist(), text[able].tolist(), it.owner[q[able]].tolist(), cosine[able].tolist()):
                        seen[i, t, j] = max(c, seen.get((i, t, j), -1))
                    for (i, t, j), c in seen.items():
                        row, _, offset = group[t]
                        x = whole[0] if len(whole) == 1 else group[t][1]
                        share, answer = check_words(it, j, x, offset + (i - int(first[t])) * HALF)
                        if share >= LCS_SHARE and answer >= ANSWER_SHARE:
                            best[row, j] = max(best.get((row, j), (0, 0, 0)), (share, answer, c))
            out = [(ids[r].as_py(), it.ids[j], c, s, a) for (r, j), (s, a, c) in best.items()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.float64()] * 3))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return searched


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in turn, about so many words together; only one block's texts are held."""
    rows, size = [], 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 5 + 1
        if size >= block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Links (doc_id, item_id, cosine, lcs_share, answer_share) of documents that contain a benchmark item.

    A link has LCS_SHARE of the item's words in its order within a region of the text, and ANSWER_SHARE of its rare
    words there; the best region counts. Items of fewer than FEW_WORDS words must occur as they are, items without words
    are never found; one of more than SECTION words is found by its sections, each with a link of its own. Null texts are empty; rows without an id are
    searched and have a null id, items without one are left out. Repeated rows, of either table, give repeated links.
    Other columns are ignored; if either table is empty, so is the result.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    space, stored, result = None, None, None
    for rows in _blocks(known, block_words):
        if space is None:
            words = benchmark_words(known)
            stored = materialise(in_numbers(texts, words), "words")
            space = fitted_on_numbers(stored, known, words, rank, stored.count())
        block = Block(space, rows)
        if block.ids:
            # Words that the space does not know are not in the store, so a block that has any reads the texts again.
            found = stored if len(block.vocabulary) == len(space.vocabulary) else in_numbers(texts, block.vocabulary)
            links = found.mapInArrow(_search(spark.sparkContext.broadcast(block)), LINKS)
            result = links if result is None else result.unionByName(links)
    return result if result is not None else spark.createDataFrame([], LINKS)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a link to the benchmark (contaminated), with all their columns; rows without an id stay, rows
    that repeat an id stay or go together. An empty table gives an empty result, an empty benchmark leaves all rows."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("__gone_id")).filter("__gone_id is not null").distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
