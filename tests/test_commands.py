"""The loop from manifests to a labelled, split dataset, over versions on disk."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from curatrix.plans import commands
from curatrix.sources import manifests


def _manifest(path, rows):
    path.write_text(json.dumps({"version": 1, "exported_at": "2024-01-01T00:00:00Z", "avatar_count": len(rows), "total_sightings": sum(n for _, n in rows), "avatars": [{"normalized_url": u, "original_url": u + "?o", "handles": ["h"], "display_names": [], "source_surfaces": ["tweet"], "seen_count": n, "first_seen_at": "2024-01-01T00:00:00Z", "last_seen_at": "2024-01-02T00:00:00Z", "whitelisted": False} for u, n in rows]}))


def test_loop(spark, tmp_path):
    c = commands.Catalog(spark, str(tmp_path / "catalog"))
    (tmp_path / "in").mkdir()
    assert commands.ingest(c, str(tmp_path / "in")) == 0
    _manifest(tmp_path / "in" / "a.json", [(f"u{i}", i + 1) for i in range(6)])
    assert commands.ingest(c, str(tmp_path / "in")) == 1
    assert commands.ingest(c, str(tmp_path / "in")) == 0
    _manifest(tmp_path / "in" / "b.json", [("u0", 10), ("bad", 1)])
    assert commands.ingest(c, str(tmp_path / "in")) == 1
    before = {r.normalized_url: r.seen_count for r in c.read("avatar_urls").collect()}
    assert before["u0"] == 11 and len(before) == 7
    commands.ingest(c, str(tmp_path / "in"), force=True)
    assert {r.normalized_url: r.seen_count for r in c.read("avatar_urls").collect()} == before and c.read("exports").count() == 2

    def get(url):
        if url.startswith("bad"):
            raise OSError("gone")
        return 200, "image/png", url.split("?")[0].encode()

    commands.download_avatars(c, get)
    images = c.read("images")
    assert all(Path(r.local_path).read_bytes().decode() in {f"u{i}" for i in range(6)} for r in images.collect())
    assert images.count() == 6 and {r.download_status for r in c.read("avatar_urls").filter("normalized_url = 'bad'").collect()} == {"failed"}

    shas = sorted(r.sha256 for r in images.collect())
    scored = spark.createDataFrame([(s, i / 5) for i, s in enumerate(shas)], "image_sha256 string, score double")
    commands.score(c, scored, "r1", 0.5)
    with pytest.raises(ValueError):
        commands.score(c, scored, "r1", 0.5, limit=3)
    assert c.read("images").filter("label_source = 'model'").count() == 6 and c.read("model_scores").count() == 6

    r = commands.Review(c, spark.createDataFrame([("r1", 0.5)], "run_id string, threshold double"))
    assert r.summary().first().queue_needs_review == 6
    r.label(shas[0], "positive", "n")
    r.batch_label([(shas[1], "negative"), (shas[2], "unclear")], "b1")
    assert r.history().count() == 3 and r.summary().first().queue_needs_review == 3
    r.undo()
    assert r.history().count() == 1 and r.summary().first().label_positive == 1
    assert r.item(shas[0]).first().label == "positive" and r.queue("model_disagreements").first().sha256 == shas[0]
    assert r.batch("high_impact", 2, 1).count() == 2 and r.labeled_grid()[0] == 6 and r.queue_grid("needs_review", 2)[1].count() == 2

    now = c.read("images")
    prints = now.select(F.col("local_path").alias("path"), F.col("sha256").alias("raw_sha"), F.col("sha256").alias("pixel_digest"), F.lit(True).alias("readable"))
    collections = spark.createDataFrame([], "slug string, token_id long, local_path string")
    given = commands.build_dataset(c, prints, collections, str(tmp_path / "ds"))
    assert given.count() == 6
    entries = manifests.read_jsonl(spark, str(tmp_path / "ds" / "entries"))
    assert entries.count() == 6 and c.read("images").filter("split is null").count() == 0
    errors = entries.withColumn("score", F.lit(0.9))
    assert commands.export_errors(errors, 0.5, "false_positives").count() == entries.filter("label = 'negative'").count()
    assert json.loads(commands.export_model("r1", 0.5))["run_id"] == "r1"


def test_training_and_evaluation(spark):
    rows = [(f"i{i}", "positive" if i % 2 else "negative", "export", ("train", "train", "val", "test")[i // 2 % 4], "manual", 1.0, [float(i % 2) + (i % 5) / 10, 1.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, label string, source string, split string, label_source string, sample_weight double, embedding array<float>")
    entries, embeddings = df.drop("embedding"), df.select("id", "embedding")
    fitted, summary = commands.train(entries, embeddings, "r1")
    assert summary["test"]["recall"] == 1.0 and 0 <= summary["threshold"] <= 1
    one = commands.check_picture(fitted, embeddings.limit(1), 0.5).first()
    assert one.predicted_label == "negative"
    scored = entries.withColumn("run_id", F.lit("a")).withColumn("score", (F.col("label") == "positive").cast("double")).unionByName(entries.withColumn("run_id", F.lit("b")).withColumn("score", F.lit(1.0)))
    got = {r.run_id: r.verdict for r in commands.evaluate(scored, {"a": 0.5, "b": 0.5}, "a").collect()}
    assert got == {"a": "baseline", "b": "worse"}


def test_a_command_that_fails_leaves_the_catalog_as_it_was(spark, tmp_path, monkeypatch):
    from curatrix.sources import sinks

    c = commands.Catalog(spark, str(tmp_path / "catalog"))
    (tmp_path / "in").mkdir()
    _manifest(tmp_path / "in" / "a.json", [("u0", 1)])
    commands.ingest(c, str(tmp_path / "in"))
    before = c.versions()
    _manifest(tmp_path / "in" / "b.json", [("u0", 10)])
    real, calls = sinks.write_version, []

    def second_fails(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("disk full")
        return real(*args)

    monkeypatch.setattr(sinks, "write_version", second_fails)
    with pytest.raises(OSError):
        commands.ingest(c, str(tmp_path / "in"))
    assert c.versions() == before and c.read("exports").count() == 1 and c.read("avatar_urls").first().seen_count == 1
    monkeypatch.setattr(sinks, "write_version", real)
    assert commands.ingest(c, str(tmp_path / "in")) == 1 and c.read("avatar_urls").first().seen_count == 11


def test_training_wants_an_embedding_for_each_entry(spark):
    entries = spark.createDataFrame([("a", "positive", "export", "train", "manual", 1.0), ("b", "negative", "export", "val", "manual", 1.0)], "id string, label string, source string, split string, label_source string, sample_weight double")
    with pytest.raises(ValueError, match="1 entries"):
        commands.train(entries, spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"), "r")


def test_command_line(spark, tmp_path):
    from curatrix.__main__ import run

    root = str(tmp_path / "catalog")
    (tmp_path / "in").mkdir()
    _manifest(tmp_path / "in" / "a.json", [(f"u{i}", i + 1) for i in range(3)])
    assert run(spark, [root, "ingest", str(tmp_path / "in")]) == "1 ingested"
    c = commands.Catalog(spark, root)
    commands.download_avatars(c, lambda url: (200, "image/png", url.split("?")[0].encode()))
    sha = sorted(r.sha256 for r in c.read("images").collect())
    spark.createDataFrame([(s, 0.9) for s in sha], "image_sha256 string, score double").write.parquet(str(tmp_path / "scored"))
    assert run(spark, [root, "score", str(tmp_path / "scored"), "r1", "--threshold", "0.5"]) == "scored"
    assert json.loads(run(spark, [root, "summary"]))["total"] == 3
    run(spark, [root, "label", sha[0], "negative", "--notes", "n"])
    assert json.loads(run(spark, [root, "queue", "hard_negatives"]))["sha256"] == sha[0]
    assert run(spark, [root, "undo"]) == "undone" and run(spark, [root, "queue", "hard_negatives"]) == ""
    assert json.loads(run(spark, [root, "export-model", "r1", "--threshold", "0.5"]))["threshold"] == 0.5
    with pytest.raises(SystemExit):
        run(spark, [root, "nothing"])
    with pytest.raises(SystemExit):
        run(spark, [root, "queue", "high_impact", "--limit", "1001"])
    run(spark, [root, "queue", "high_impact", "--limit", "5000", "--out", str(tmp_path / "queue")])
    assert spark.read.json(str(tmp_path / "queue")).count() == 3 and run(spark, [root, "vacuum"])


def test_command_line_from_pictures_to_a_checked_one(spark, tmp_path):
    """Files to embeddings and fingerprints, a trained run with its threshold, queues that know it, and a picture that is checked."""
    import numpy as np

    from curatrix.__main__ import run
    from test_pictures import written

    pytest.importorskip("onnxruntime")
    root, r = str(tmp_path / "catalog"), np.random.default_rng(3)
    (tmp_path / "files").mkdir()
    entries = []
    for i in range(48):
        pixels = r.integers(0, 100, (5, 5, 3)).astype(np.uint8)
        pixels[:, :, i % 2] += 120
        path = tmp_path / "files" / f"{i}.png"
        path.write_bytes(written(pixels, 2, 8, (i % 5,)))
        entries.append((f"file:{path}", "positive" if i % 2 else "negative", "export", ("train", "train", "val", "test")[i // 2 % 4], "manual", 1.0))
    (tmp_path / "files" / "broken.png").write_bytes(b"no picture")
    spark.createDataFrame(entries, "id string, label string, source string, split string, label_source string, sample_weight double").write.parquet(str(tmp_path / "entries"))
    run(spark, [root, "fingerprint", str(tmp_path / "files"), str(tmp_path / "prints"), "--size", "4"])
    assert spark.read.parquet(str(tmp_path / "prints")).filter("readable").count() == 48
    run(spark, [root, "embed", str(tmp_path / "files"), str(tmp_path / "embeddings"), "--size", "4"])
    summary = json.loads(run(spark, [root, "train", str(tmp_path / "entries"), str(tmp_path / "embeddings"), "r1", "--size", "4"]))
    assert summary["test"]["recall"] >= 0.5 and summary["test"]["precision"] == 1.0
    for i in (0, 1):
        got = json.loads(run(spark, [root, "check-picture", str(tmp_path / "files" / f"{i}.png")]))
        assert got["run_id"] == "r1" and got["threshold"] == summary["threshold"] and (got["probability"] > 0.5) == bool(i) and got["matched"] == (got["probability"] >= got["threshold"])
    c = commands.Catalog(spark, root)
    assert commands.known_thresholds(c).first().threshold == summary["threshold"]
    with pytest.raises(ValueError, match="no run"):
        commands.check_run(commands.Catalog(spark, str(tmp_path / "none")), "x.png")
