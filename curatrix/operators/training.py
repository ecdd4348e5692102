"""Training by epochs of mini-batches: a hidden layer and a head, the head first and then both.

An epoch deals entries to groups by a seeded hash, and in a group they come in a seeded order. Every group starts from the
epoch's parameters and takes its mini-batches one after the other, as rows stream through its task; what the groups end with is
averaged by their rows. Groups have about as many rows whatever the table, and are not those of the cluster, so the result does
not depend on partitions. Only parameters, losses and an epoch's counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import metrics
from curatrix.shared import materialise

WARMUP, FINETUNE = "warmup", "finetune"
HISTORY = "run_id string, epoch int, phase string, train_loss double, threshold double, precision double, recall double, f1 double"


@dataclass
class Plan:
    epochs: int = 12
    warmup: int = 2
    batch: int = 64
    rate: float = 0.05
    head_rate: float = 0.2
    decay: float = 1e-4
    hidden: int = 16
    patience: int = 3
    floor: float = 0.995
    seed: int = 7
    together: int = 100_000


def initial(size: int, plan: Plan) -> list[np.ndarray]:
    """Hidden weights and offsets, head weights and offset."""
    r = np.random.default_rng(plan.seed)
    return [r.normal(0, np.sqrt(2 / size), (size, plan.hidden)), np.zeros(plan.hidden), r.normal(0, np.sqrt(1 / plan.hidden), plan.hidden), np.zeros(1)]


def forward(parameters: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer and the probability of the positive class."""
    w, b, v, c = parameters
    hidden = np.maximum(x @ w + b, 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -30, 30)))


def step(parameters: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, decay: float, head_only: bool) -> float:
    """One mini-batch: parameters are changed in place; returns the summed loss before it."""
    w, b, v, c = parameters
    hidden, p = forward(parameters, x)
    loss = -weight * (y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))
    error = weight * (p - y) / max(1e-8, weight.sum())
    back = np.outer(error, v) * (hidden > 0)
    v -= rate * (hidden.T @ error + decay * v)
    c -= rate * error.sum()
    if not head_only:
        w -= rate * (x.T @ back + decay * w)
        b -= rate * back.sum(axis=0)
    return float(loss.sum())


def _epoch(parameters: list[np.ndarray], plan: Plan, head_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own, loss, rows, weights = None, [], 0.0, 0, 0.0
        kept: list[pd.DataFrame] = []
        held = 0

        def take(n: int) -> pd.DataFrame:
            nonlocal kept, held
            whole = pd.concat(kept) if len(kept) > 1 else kept[0]
            kept, held = [whole.iloc[n:]], held - n
            return whole.iloc[:n]

        def learn(part: pd.DataFrame) -> None:
            nonlocal loss, rows, weights
            x, y, w = np.stack(part["embedding"].to_numpy()).astype(float), part["target"].to_numpy(float), part["weight"].to_numpy(float)
            loss += step(own, x, y, w, plan.head_rate if head_only else plan.rate, plan.decay, head_only)
            rows, weights = rows + len(part), weights + w.sum()

        def given() -> pd.DataFrame:
            return pd.DataFrame({"group": [group], "rows": [rows], "loss": [loss], "weight": [weights], "parameters": [np.concatenate([p.reshape(-1) for p in own])]})

        for batch in batches:
            for g, part in batch.groupby("group", sort=False):  # rows of a group follow one another
                if g != group:
                    if group is not None:
                        if held:
                            learn(take(held))
                        yield given()
                    group, own, loss, rows, weights = g, [p.copy() for p in parameters], 0.0, 0, 0.0
                    kept, held = [], 0
                kept.append(part)
                held += len(part)
                while held >= plan.batch:
                    learn(take(plan.batch))
        if group is not None:
            if held:
                learn(take(held))
            yield given()

    return run


def dealt(rows: DataFrame, plan: Plan, epoch: int, groups: int) -> DataFrame:
    """Rows with the group and the order of an epoch."""
    draw = F.sha2(F.concat(F.lit(f"{plan.seed}:{epoch}:"), F.col("id")), 256)
    return rows.withColumn("order", draw).withColumn("group", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.lit(groups)))


def fit(entries: DataFrame, run_id: str, plan: Plan | None = None) -> tuple[list[np.ndarray], DataFrame]:
    """The parameters of the best epoch, and the history that metrics.best_epoch reads.

    entries: id, split, label, sample_weight, embedding. Positives weigh as much as negatives in all. After each epoch the
    validation split chooses the threshold, whose recall and F1 tell whether it is better; PATIENCE finetune epochs in a row
    without that end the training. An entry without an embedding is an error.
    """
    plan = plan or Plan()
    rows = materialise(entries.select("id", "split", "label", "sample_weight", "embedding"), "fit")
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    if missing := rows.filter("embedding is null").count():
        raise ValueError(f"{missing} entries have no embedding")
    first = train.select(F.size("embedding").alias("n")).first()
    if first is None:
        raise ValueError("nothing to train on")
    weight = metrics.class_weight(train).first()["positive_weight"]
    hit = F.col("label") == "positive"
    given = materialise(train.select("id", "embedding", hit.cast("double").alias("target"), (F.col("sample_weight") * F.when(hit, weight).otherwise(1.0)).alias("weight")), "fit-train")
    groups = max(1, -(-given.count() // plan.together))
    parameters, shapes = initial(first["n"], plan), [p.shape for p in initial(first["n"], plan)]
    best, chosen, stale, history = None, parameters, 0, []
    for epoch in range(1, plan.epochs + 1):
        phase = WARMUP if epoch <= plan.warmup else FINETUNE
        spread = dealt(given, plan, epoch, groups).repartition(groups, "group").sortWithinPartitions("group", "order", "id")
        done = spread.mapInPandas(_epoch(parameters, plan, phase == WARMUP), "group long, rows long, loss double, weight double, parameters array<double>")
        parts = sorted(done.collect(), key=lambda r: r["group"])  # one row a group
        flat = np.average([r["parameters"] for r in parts], axis=0, weights=[r["rows"] for r in parts])
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        parameters = [p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes)]
        one = metrics.choose_threshold(score(parameters, val, "id").join(val.select("id", "label"), "id"), plan.floor).first()
        loss = sum(r["loss"] for r in parts) / max(1e-8, sum(r["weight"] for r in parts))
        history.append((run_id, epoch, phase, float(loss), one["threshold"], one["precision"], one["recall"], one["f1"]))
        now = (one["recall"], one["f1"])
        if best is None or now > best:
            best, chosen, stale = now, parameters, 0
        elif phase == FINETUNE:
            stale += 1
            if stale >= plan.patience:
                break
    return chosen, rows.sparkSession.createDataFrame(history, HISTORY)


def score(parameters: list[np.ndarray], rows: DataFrame, key: str) -> DataFrame:
    """(key, score) of rows (key, embedding)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "score": forward(parameters, np.stack(batch["embedding"].to_numpy()).astype(float))[1]})

    return rows.select(key, "embedding").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
