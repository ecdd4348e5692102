"""Scores of a Brown class-based bigram model.

Exchange clustering assigns words to classes so that class bigrams tell most about each other. The probability of a word is
that of its class after the class before, times its share of its class. Word counts cover all training texts and stay
distributed: words that are frequent are known to every task, so no hot word is ever shuffled; of the others each text
sends every distinct word once to where its count is.

Clustering starts on the driver from counts of some 600 kinds of words after each other: the most frequent words, and all
others by their last characters. Then every frequent word is moved on its own: tasks count the classes before and after each,
the counts of a word meet in one place, and there it goes to the class where the classes' mutual information is greatest.
Only words outside the frequent ones keep the class of their ending.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import crc32_mod, materialise

FOLDS, HELD_OUT = 7, 2
#: Words known to every task, each with a class of its own choice; of these the kinds that clustering starts from, and kinds of
#: all others, by their last three bytes; classes.
FREQUENT, CLUSTERED, ENDINGS, CLASSES = 100_000, 400, 200, 48
#: Passes of the start, at most, and passes over the corpus in which all frequent words may move.
PASSES, MOVES = 12, 2
ADD = 0.5
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Tokens whose neighbours a task holds before it sums them up.
HELD_TOKENS = 2_000_000
#: Stands for the end of a text; no word has white space.
END = b"\n"


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; the end is left out."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([_strings(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0):
            held.update(tokens_of(t.as_py()))
            held[END] += 1
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


@dataclass
class Words:
    """The frequent words, in order, END first of all; kind: number of each, and after them of each ending, for what is
    counted: kinds at the start, classes later."""

    index: dict[bytes, int]
    kind: np.ndarray

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of each word its place among the frequent ones, or that of its ending after them."""
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        n = len(self.kind) - ENDINGS
        for i in np.flatnonzero(place < 0).tolist():
            place[i] = n + ending(words[i])
        return place


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


N_KINDS = 1 + CLUSTERED + ENDINGS


def _summed(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])


def _followed(shared, size: int, contexts: bool):
    """How often a kind follows another, as code before * size + after. contexts: also how often each word has each kind
    before or after it, as code size * size + (place * 2 + side) * size + kind."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        codes, held = [], 0
        for batch in batches:
            for t in batch.column(0):
                place = np.concatenate(([0], np.frombuffer(t.as_buffer(), np.int32), [0]))
                kind = words.kind[place]
                codes.append(kind[:-1] * size + kind[1:])
                if contexts:
                    codes += [size * size + place[1:] * 2 * size + kind[:-1], size * size + (place[:-1] * 2 + 1) * size + kind[1:]]
                held += len(place)
                if held > HELD_TOKENS:
                    yield _summed(codes)
                    codes, held = [], 0
        yield _summed(codes)

    return followed


def _moved(shared, classes: int):
    """Of the frequent words in a partition, with their counts by class and side, those that move, with their new class."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table, fixed = shared.value
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        found: list[tuple[int, int]] = []
        if parts:
            code, n = (np.concatenate(x) for x in zip(*parts))
            word, side, cls = code // (2 * classes), code // classes % 2, code % classes
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], word[order][1:] != word[order][:-1])))
            table = table.copy()
            groups = sorted(np.split(order, starts[1:]), key=lambda g: (-n[g].sum(), word[g[0]]))
            for g in groups:
                w = int(word[g[0]])
                if w == 0 or w >= fixed:
                    continue
                into, out = (np.bincount(cls[g[side[g] == s]], n[g[side[g] == s]], classes) for s in (0, 1))
                table, best = best_class(table, int(of[w]), out, into, 0.0)
                if best != of[w]:
                    found.append((w, best))
        columns = list(zip(*found)) if found else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "class"])

    return moved


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each item; item 0 keeps class 0 for itself. pairs: how often an item follows another.

    Starts from the items in order of frequency, dealt out in turn, and moves one item after the other to the class
    where the classes' mutual information is greatest, until no item moves."""
    n = len(pairs)
    mass = pairs.sum(0) + pairs.sum(1)
    of = np.zeros(n, int)
    order = [i for i in np.argsort(-mass, kind="stable") if i]
    for k, i in enumerate(order):
        of[i] = 1 + k % (classes - 1)
    for _ in range(passes):
        moved = 0
        member = np.eye(classes)[of]
        table = member.T @ pairs @ member
        for w in order:
            if not mass[w]:
                continue
            c, own = of[w], pairs[w, w]
            out = np.bincount(of, pairs[w], classes)
            into = np.bincount(of, pairs[:, w], classes)
            out[c] -= own
            into[c] -= own
            table, best = best_class(table, c, out, into, own)
            if best != c:
                of[w] = best
                moved += 1
        if not moved:
            break
    return of


def best_class(table: np.ndarray, c: int, out: np.ndarray, into: np.ndarray, own: float) -> tuple[np.ndarray, int]:
    """The class where a word of class c is best, and the table of class bigrams with it there. out, into: how often a class
    follows the word and goes before it; own: how often it follows itself, not in these."""
    rest = table.copy()
    rest[c] -= out
    rest[:, c] -= into
    rest[c, c] -= own
    np.maximum(rest, 0, out=rest)
    rows, columns, diagonal = rest.sum(1), rest.sum(0), np.diag(rest)
    by_row, by_column = _x_log_x(rest + out) - _x_log_x(rest), _x_log_x(rest + into[:, None]) - _x_log_x(rest)
    gain = by_row.sum(1) - np.diag(by_row) + by_column.sum(0) - np.diag(by_column)
    gain += _x_log_x(diagonal + out + into + own) - _x_log_x(diagonal)
    gain -= _x_log_x(rows + out.sum() + own) - _x_log_x(rows) + _x_log_x(columns + into.sum() + own) - _x_log_x(columns)
    gain[0] = -np.inf
    best = int(gain.argmax())
    if gain[best] <= gain[c] + 1e-9:
        best = c
    rest[best] += out
    rest[:, best] += into
    rest[best, best] += own
    return rest, best


@dataclass
class Model:
    words: Words  # with their classes
    transition: np.ndarray  # log10 probability of a class after another
    base: np.ndarray  # log10 probability of each frequent word without context
    emission: np.ndarray  # of each frequent word in its class
    class_total: np.ndarray  # log10 of the tokens of each class
    unknown: np.ndarray  # log10 of the mass of unknown words in each class
    discount: float
    base_total: int
    n_train: int
    end_count: int


ROW_SHIFT = 36
ENCODED = "doc_id long, held_out boolean, row long, places binary, rare array<struct<word: binary, n: long>>"


def _encoded(shared):
    """Texts as places of their words, which are read again and again, and the words that have no place of their own."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        n_known = len(words.kind) - ENDINGS
        row = TaskContext.get().partitionId() << ROW_SHIFT
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            places, rare = [], []
            for t in batch.column(2):
                found = tokens_of(t.as_py())
                place = words.places(found)
                places.append(place.astype("<i4").tobytes())
                rare.append([{"word": w, "n": n} for w, n in Counter([found[i] for i in np.flatnonzero(place >= n_known).tolist()]).items()])
            rows = pa.array(range(row, row + len(places)), pa.int64())
            row += len(places)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(places, pa.binary()), pa.array(rare, kind)], ["doc_id", "held_out", "row", "places", "rare"])

    return encoded


def _partly_scored(shared):
    """All of a score but what the counts of its rare words say."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for t in batch.column(3):
                place = np.frombuffer(t.as_buffer(), np.int32)
                cls = m.words.kind[place]
                score = m.transition[np.concatenate(([0], cls)), np.concatenate((cls, [0]))].sum()
                known = place < len(m.emission)
                frequent = place[known]
                score += m.emission[frequent].sum() + m.emission[0] - m.class_total[cls[~known]].sum()
                for column, value in zip(out, (len(place) + 1, len(frequent) + 1, m.base[frequent].sum() + m.base[0], score)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score"])

    return scored


def _training(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return texts, texts.filter("not held_out").select("text")


def fitted(docs: DataFrame, frequent: int = FREQUENT, moves: int = MOVES) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training texts, the counts of all their words, and all texts as places of words."""
    sc = docs.sparkSession.sparkContext
    texts, training = _training(docs)
    counts = materialise(training.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    n_train, n_words = totals["tokens"], totals["words"]
    end = F.lit(bytearray(END))
    end_count = sum(r["n"] for r in counts.filter(F.col("word") == end).collect())
    # The frequent words are those with at least a count that so many words have at most: no sort, and a bounded result.
    others = counts.filter(F.col("word") != end)
    first = others.orderBy(F.desc("n"), "word").limit(CLUSTERED).collect()
    step = F.floor(8 * F.log2("n"))
    sizes = sorted(((r["step"], r["words"]) for r in others.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, room = None, frequent
    for at, n in sizes:
        if n > room:
            break
        least, room = at, room - n
    known = {bytes(r["word"]): r["n"] for r in first}
    if least is not None:
        found = others.filter(step >= least).toArrow()
        known.update(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    top = sorted(known.items(), key=lambda x: (-x[1], x[0]))
    top_words, top_n = [END, *[w for w, _ in top]], np.array([end_count, *[n for _, n in top]], float)
    n_known = len(top_words)
    kind = np.array([i if i <= CLUSTERED else 1 + CLUSTERED + ending(w) for i, w in enumerate(top_words)] + [1 + CLUSTERED + e for e in range(ENDINGS)])
    words = Words({w: i for i, w in enumerate(top_words) if i}, kind)

    encoded = materialise(texts.mapInArrow(_encoded(sc.broadcast(words)), ENCODED), "encoded")
    training = encoded.filter("not held_out").select("places")
    # Where clustering starts: N_KINDS squared counts at most.
    rows = training.mapInArrow(_followed(sc.broadcast(words), N_KINDS, False), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(N_KINDS * N_KINDS)
    pairs[rows["code"].to_numpy()] = rows["n"].to_numpy()
    words = replace(words, kind=exchange(pairs.reshape(N_KINDS, N_KINDS))[kind])

    square = CLASSES * CLASSES
    for turn in range(moves + 1):  # the last one only counts what classes follow each other
        last = turn == moves
        tally = training.mapInArrow(_followed(sc.broadcast(words), CLASSES, not last), "code long, n long")
        if not last:
            # All counts of a word go to one place; each task has summed them up before.
            place = F.when(F.col("code") < square, -1 - F.col("code")).otherwise(F.floor((F.col("code") - square) / (2 * CLASSES)))
            tally = materialise(tally.withColumn("place", place).repartition("place").groupBy("place", "code").agg(F.sum("n").alias("n")), "contexts")
        rows = tally.filter(F.col("code") < square).groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(square)
        table[rows["code"].to_numpy()] = rows["n"].to_numpy()
        table = table.reshape(CLASSES, CLASSES)
        if not last:
            own = tally.filter(F.col("code") >= square).repartition("place").select((F.col("code") - square).alias("code"), "n")
            moved = own.mapInArrow(_moved(sc.broadcast((words.kind, table, n_known)), CLASSES), "word long, class long").toArrow()  # of the frequent words
            cls = words.kind.copy()
            cls[moved["word"].to_numpy()] = moved["class"].to_numpy()
            words = replace(words, kind=cls)

    transition = table + ADD
    transition = np.log10(transition / transition.sum(1, keepdims=True))
    # Tokens and distinct words of each class: of the frequent words here, of the rest by their endings.
    by_ending = counts.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % ENDINGS).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    per_ending = np.zeros((ENDINGS, 2))
    per_ending[by_ending["ending"].to_numpy()] = np.stack([by_ending["n"].to_numpy(), by_ending["words"].to_numpy()], axis=1)
    for w, n in zip(top_words, top_n):
        if n:
            per_ending[ending(w)] -= (n, 1)
    of, of_ending = words.kind[:n_known], words.kind[n_known:]
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens, of, top_n)
    np.add.at(distinct, of, top_n > 0)
    np.add.at(tokens, of_ending, per_ending[:, 0])
    np.add.at(distinct, of_ending, per_ending[:, 1])
    open_classes = np.zeros(CLASSES, bool)
    open_classes[of_ending] = True  # where a word may be unknown
    discount = min(0.95, max(0.1, totals["once"] / max(1, totals["once"] + 2 * totals["twice"])))
    taken = np.where(open_classes, discount, 0.0)
    unknown = np.where(distinct > 0, taken * distinct, 1.0)
    class_total = np.where(distinct > 0, np.maximum(tokens, 1), 1.0)
    emission = np.log10(np.maximum(top_n - taken[of], 1e-9) / class_total[of])
    if not end_count:
        emission[0] = 0.0
    base_total = n_train + n_words + 1
    return Model(words, transition, np.log10((top_n + 1) / base_total), emission, np.log10(class_total), np.log10(np.maximum(unknown, 1e-9)), discount, base_total, n_train, end_count), counts, encoded


def language_scores(docs: DataFrame, frequent: int = FREQUENT, moves: int = MOVES) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is that of single words with one added to every count. score: log10 of the text's probability by classes;
    P(class after class) with ADD added to each count, P(word in class) by absolute discounting, what is discounted going
    to all unknown words of the class together. A null text is empty and has one token, the end. Null ids are not held
    out. Repeated rows are scored alike. Without training texts, counts are zero. Other columns are ignored; an empty table
    gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    model, counts, encoded = fitted(docs, frequent, moves)
    part_kind = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double"
    part = encoded.select("doc_id", "held_out", "row", "places").mapInArrow(_partly_scored(sc.broadcast(model)), part_kind)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    of_ending = model.words.kind[-ENDINGS:]
    unknown_of = F.element_at(F.lit([float(model.unknown[c]) for c in of_ending]), (F.crc32(F.expr("substring(word, -3, 3)")) % ENDINGS + 1).cast("int"))
    found = rare.join(counts, "word", "left")
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.base_total)))).alias("more_base"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("n") - F.lit(model.discount)), unknown_of)).alias("more_score"),
    )
    out = part.join(sums, "row", "left")
    zero = F.lit(0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero) - F.lit(0 if model.end_count else 1)).alias("n_known"), F.lit(model.n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"))
