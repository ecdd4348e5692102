"""The training loop against one in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from curatrix.operators import metrics, training


def entries(spark, n=240):
    r, rows = np.random.default_rng(2), []
    for i in range(n):
        hit = i % 3 == 0
        x = r.normal(0, 1, 4) + (np.array([1.5, -1.0, 0.0, 0.5]) if hit else 0)
        rows.append((f"i{i:03d}", ("train", "train", "val")[i // 3 % 3], "positive" if hit else "negative", 1.0 if i % 2 else 0.5, [float(v) for v in x]))
    return rows, spark.createDataFrame(rows, "id string, split string, label string, sample_weight double, embedding array<double>")


def by_hand(rows, plan, epochs):
    """The same epochs, one row after the other in lists."""
    train = [r for r in rows if r[1] == "train"]
    total = {k: sum(r[3] for r in train if r[2] == k) for k in ("positive", "negative")}
    weight = total["negative"] / total["positive"]
    groups, parameters, losses = -(-len(train) // plan.together), training.initial(4, plan), []
    for epoch in range(1, epochs + 1):
        drawn = sorted((hashlib.sha256(f"{plan.seed}:{epoch}:{r[0]}".encode()).hexdigest(), r) for r in train)
        parts = []
        for g in range(groups):
            own, loss = [p.copy() for p in parameters], 0.0
            some = [r for d, r in drawn if int(d[:8], 16) % groups == g]
            for at in range(0, len(some), plan.batch):
                few = some[at : at + plan.batch]
                x, y = np.array([r[4] for r in few]), np.array([float(r[2] == "positive") for r in few])
                w = np.array([r[3] * (weight if r[2] == "positive" else 1) for r in few])
                loss += training.step(own, x, y, w, plan.head_rate if epoch <= plan.warmup else plan.rate, plan.decay, epoch <= plan.warmup)
            parts.append((len(some), loss, own))
        parameters = [sum(n * o[i] for n, _, o in parts) / sum(n for n, _, _ in parts) for i in range(4)]
        losses.append(sum(x for _, x, _ in parts) / sum(r[3] * (weight if r[2] == "positive" else 1) for r in train))
    return parameters, losses


def test_epochs_are_those_of_a_loop_in_numpy(spark):
    rows, df = entries(spark)
    plan = training.Plan(epochs=4, warmup=2, batch=16, hidden=5, patience=9, floor=0.8, together=70)
    _, history = training.fit(df.repartition(7), "r", plan)
    parameters, losses = by_hand(rows, plan, 4)
    got = history.orderBy("epoch").collect()
    assert [h.phase for h in got] == ["warmup"] * 2 + ["finetune"] * 2 and [h.train_loss for h in got] == pytest.approx(losses)
    assert losses[-1] < losses[0]
    val = df.filter("split = 'val'")
    want = {r[0]: training.forward(parameters, np.array([r[4]]))[1][0] for r in rows if r[1] == "val"}
    assert {r.id: r.score for r in training.score(parameters, val, "id").collect()} == pytest.approx(want)
    chosen = metrics.choose_threshold(training.score(parameters, val, "id").join(val, "id"), 0.8).first()
    assert (got[-1].recall, got[-1].f1) == pytest.approx((chosen.recall, chosen.f1))


def test_the_best_epoch_is_kept_and_patience_ends(spark):
    rows, df = entries(spark, 120)
    plan = training.Plan(epochs=9, warmup=1, batch=8, rate=0.0, head_rate=0.3, hidden=5, patience=2, decay=0.0, floor=0.5)
    kept, history = training.fit(df, "r", plan)  # nothing is learned after the first epoch
    got = metrics.best_epoch(history, plan.patience).first()
    assert (got.best_epoch, got.stop_epoch, history.count()) == (1, 3, 3)
    assert all(np.allclose(a, b) for a, b in zip(kept, by_hand(rows, plan, 1)[0]))
    with pytest.raises(ValueError, match="no embedding"):
        training.fit(df.withColumn("embedding", df.embedding.cast("array<double>")).selectExpr("id", "split", "label", "sample_weight", "if(id = 'i000', null, embedding) as embedding"), "r", plan)
    with pytest.raises(ValueError, match="nothing"):
        training.fit(df.filter("split = 'val'"), "r", plan)


def test_steps_go_down_the_gradient():
    r = np.random.default_rng(5)
    x, y, w = r.normal(0, 1, (12, 4)), (r.random(12) < 0.5).astype(float), r.random(12)
    plan = training.Plan(hidden=3)
    start = training.initial(4, plan)
    start[1][:] = 0.1

    def mean_loss(parameters):
        p = training.forward(parameters, x)[1]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    moved = [p.copy() for p in start]
    training.step(moved, x, y, w, 1e-3, 0.0, False)
    for i, p in enumerate(start):
        for at in np.ndindex(p.shape):
            up, down = [q.copy() for q in start], [q.copy() for q in start]
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            assert (start[i][at] - moved[i][at]) / 1e-3 == pytest.approx((mean_loss(up) - mean_loss(down)) / 2e-6, abs=1e-5)
    head = [p.copy() for p in start]
    training.step(head, x, y, w, 1e-3, 0.0, True)
    assert (head[0] == start[0]).all() and (head[1] == start[1]).all() and (head[2] != start[2]).any()
