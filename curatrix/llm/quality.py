"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes some two dozen measures. Cyclic boosting visits one measure after the other and fits a shallow tree to what
is left to explain; all trees of a measure add up to one lookup table over its bins. Pairs of measures that explain most of
the rest get tables over both. A score is the sum of the tables' entries, so scoring is binning and adding, batch by batch.
The model is fitted on a bounded sample of labelled rows and is a few kilobytes; every row is scored, whole texts always.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import crc32_mod

#: So many labelled rows at most are learned from, those with the smallest hash of their id.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 300, 100, 0.15, 25

MEASURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "letters", "upper", "digits", "spaces", "newlines", "pipes",
    "exclamations", "stops", "symbols", "high_bytes", "byte_entropy", "top_byte", "distinct_words", "top_word", "top_three_words",
    "next_equal", "distinct_lines", "top_line", "distinct_sentences", "upper_words", "symbol_words",
)


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        kinds[b] = [b < 128 and c.isalpha(), "A" <= c <= "Z", "0" <= c <= "9", b == 32, b == 10, c == "|", c == "!", c in ".,;:?", 33 <= b < 127 and not c.isalnum() and c not in ".,;:?!|'\"-()"]
    return kinds


KINDS = _byte_kinds()


def measures(text: str | None) -> list[float]:
    """MEASURES of a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(MEASURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = (hist @ KINDS) / n
    share = hist[hist > 0] / n
    words = raw.split()
    count = Counter(words)
    nw = max(1, len(words))
    top = [c for _, c in count.most_common(3)] or [0]
    lines = [x for x in raw.split(b"\n") if x]
    line_count = Counter(lines)
    nl = max(1, len(lines))
    sentences = raw.split(b". ")
    # Kinds of words are told from the distinct ones.
    upper = sum(c for w, c in count.items() if len(w) > 1 and w.isupper())
    symbol = sum(c for w, c in count.items() if w[-1:] in b"#$%&*@^~<>={}[]\\/|!")
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), (n - len(words)) / nw, *kinds[:8].tolist(), float(kinds[8]),
        float(hist[128:].sum()) / n, float(-(share * np.log2(share)).sum()), float(share.max()), len(count) / nw, top[0] / nw, sum(top) / nw,
        sum(map(eq, words, words[1:])) / nw, len(line_count) / nl, max(line_count.values(), default=0) * (nl > 1) / nl, len(set(sentences)) / len(sentences), upper / nw, symbol / nw,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, least: float = 3.0) -> tuple[int, float]:
    """Where to cut a row of bins by their gradients and curvatures, and what that gains; 0 where nothing does."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch > least) & (rh > least), cg**2 / (ch + 1) + rg**2 / (rh + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    at = int(gain.argmax()) if len(gain) else 0
    return (at + 1, float(gain[at])) if len(gain) and gain[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over bins, as its value for each bin."""
    at, _ = _split(g, h) if depth else (0, 0.0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: cut one side, then each part along the other; its values and its gain."""
    best = (np.zeros_like(g), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            value, gain = np.empty_like(a), 0.0
            for rows in (slice(0, at), slice(at, None)):
                sg, sh = a[rows].sum(0), b[rows].sum(0)
                cut, _ = _split(sg, sh)
                for part in (slice(0, cut), slice(cut, None)) if cut else (slice(0, None),):
                    value[rows, part] = -sg[part].sum() / (sh[part].sum() + 1)
                    gain += sg[part].sum() ** 2 / (sh[part].sum() + 1)
            if gain > best[1]:
                best = (value.T if turn else value, gain)
    return best


@dataclass
class AdditiveModel:
    """base + the sum of one table entry for each measure and each pair."""

    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(MEASURES), BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, PAIR_BINS, PAIR_BINS)))

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of measures."""
        total = np.full(len(x), self.base)
        if self.edges and len(x):
            for f, b in enumerate(self.bins(x, self.edges)):
                total += self.tables[f, b]
            coarse = self.bins(x, self.pair_edges) if self.pairs else None
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[coarse[i], coarse[j]]
        return _sigmoid(total)


def _quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], at)) for f in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> AdditiveModel:
    """check: the rows that only tell when to stop. Without rows of both labels the model is a constant."""
    model = AdditiveModel()
    learn = ~check
    mean = (y[learn].sum() + 1) / (learn.sum() + 2)
    model.base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y[learn])) < 2:
        return model
    model.edges, model.pair_edges = _quantile_edges(x[learn], BINS), _quantile_edges(x[learn], PAIR_BINS)
    bins, coarse = model.bins(x, model.edges), model.bins(x, model.pair_edges)
    total = np.full(len(y), model.base)
    loss = lambda: float(np.mean(np.logaddexp(0, -np.where(y[check] > 0, 1, -1) * total[check]))) if check.any() else 0.0

    def cycle(rounds: int, step, state: list[np.ndarray]) -> None:
        best, kept, since = loss(), [s.copy() for s in state], 0
        at_best = total.copy()
        for _ in range(rounds):
            step()
            if (now := loss()) < best - 1e-6 or not check.any():
                best, kept, since, at_best = now, [s.copy() for s in state], 0, total.copy()
            elif (since := since + 1) >= PATIENCE:
                break
        for s, k in zip(state, kept):
            s[:] = k
        total[:] = at_best

    def one_round() -> None:
        for f in range(len(MEASURES)):
            p = _sigmoid(total[learn])
            b, n = bins[f], len(model.edges[f]) + 1
            g, h = np.bincount(b[learn], p - y[learn], n), np.bincount(b[learn], p * (1 - p), n)
            step = RATE * _tree(g, h)
            model.tables[f, :n] += step
            total[:] += step[b]

    cycle(ROUNDS, one_round, [model.tables])

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = _sigmoid(total[learn]), (coarse[i] * PAIR_BINS + coarse[j])[learn]
        return np.bincount(cell, p - y[learn], PAIR_BINS**2).reshape(PAIR_BINS, -1), np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, -1)

    ranked = sorted(((-_pair_tree(*grid(i, j))[1], i, j) for i in range(len(MEASURES)) for j in range(i)))[:PAIRS]
    model.pairs = [(i, j) for _, i, j in ranked]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))

    def pair_round() -> None:
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _pair_tree(*grid(i, j))[0]
            model.pair_tables[k] += step
            total[:] += step[coarse[i], coarse[j]]

    cycle(PAIR_ROUNDS, pair_round, [model.pair_tables])
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, measures)."""
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "measures"])


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on sample labelled rows at most, none with crc32(doc_id) mod FOLDS = 0; of several labels of an id the mean counts,
    of several rows of an id the one with the smallest text."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("mean"))
    known = known.select("doc_id", (F.col("mean") >= 0.5).cast("double").alias("label"))
    open_ = known.filter(crc32_mod("doc_id", FOLDS) != 0).withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    # Twice as many as are wanted go on to be sorted, however many labels there are.
    bound = (1 << 30) * 2 * sample // max(1, open_.count())
    picked = open_.filter(F.col("hash") < bound).orderBy("hash", "doc_id").limit(sample).select("doc_id", "label")
    few = F.broadcast(picked)  # sample rows of 16 bytes
    known_texts = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = known_texts.select("doc_id", "label", "text").mapInArrow(_measured, "doc_id long, label double, measures array<double>").toArrow()
    order = np.argsort(ids := np.array(rows["doc_id"].to_pylist(), np.int64), kind="stable")
    x = np.array(rows["measures"].to_pylist(), float).reshape(len(ids), len(MEASURES))[order]
    y = np.array(rows["label"].to_pylist(), float)[order]
    return fit(x, y, ids[order] % FOLDS == 1)


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch.column("text")]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(shared.value.score(x))], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(crc32_mod("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held_out, "text").mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted.

    Only texts are inputs of a score; a null or empty text is scored as all measures zero. Null ids are not held out.
    Labels that are null, or whose id is, are ignored. With no labels at all every score is 0.5. Repeated rows are scored
    alike. Other columns are ignored, and empty tables give empty results.
    """
    return score_quality(docs, learn_quality(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1 by quality_scores, with all their columns. Rows are judged by their texts, so
    repeated rows stay or go together, and rows without an id are judged like all others; without any label all stay, as
    every score is 0.5. An empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array([measures(t) for t in texts]).reshape(-1, len(MEASURES))))

    return docs.filter(score("text") >= THRESHOLD)
