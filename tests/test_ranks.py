"""Stored orders, running sums and rows that are matched by their place."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatrix.operators import metrics, samples
from curatrix.operators.rank_index import RankIndex
from curatrix.shared import by_position, running_sums, zipped


def test_a_page_reads_the_ranges_that_hold_it(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 6).select(F.pmod(F.xxhash64("id"), F.lit(500)).alias("score"), "id", F.when(F.col("id") % 3 == 0, "x").alias("text"))
    index = RankIndex.write(rows, [F.desc("score"), F.asc("id")], str(tmp_path / "index"), 400)
    want = sorted(((r.score, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert index.total() == 3000 and index.sizes().count() > 3
    for offset, limit in ((0, 9), (1490, 25), (2995, 9), (9999, 3), (-4, 2)):
        first = max(0, min(offset, 2999))
        got = [(r.position, r.score, r.id) for r in index.page(offset, limit).orderBy("position").collect()]
        assert got == [(first + i, *w) for i, w in enumerate(want[first : first + limit])]
    one = index.item(1_000_000)
    assert (one.first().position, one.first().total, one.first().id) == (2999, 3000, want[-1][1])
    whole = len(list((tmp_path / "index" / "rows").glob("range=*")))
    scan = index.item(1500)._jdf.queryExecution().executedPlan().toString()
    assert whole > 3 and "PartitionFilters: [isnotnull(range" in scan.replace("\n", " ") and len(index.item(1500).select("id", F.input_file_name().alias("f")).select("f").distinct().collect()) == 1
    nothing = RankIndex.write(rows.limit(0), [F.asc("id")], str(tmp_path / "nothing"))
    assert nothing.total() == 0 and nothing.page(0, 9).count() == 0 and nothing.item(3).count() == 0


def test_running_sums_are_those_of_a_sort(spark):
    rows = spark.range(0, 2000, 1, 5).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e9 + 0.999).alias("score"), "id", (F.col("id") % 7).alias("n"))
    got = {r.id: (r.running_n, r.total_n) for r in running_sums(rows, [F.desc("score"), F.asc("id")], ["n"]).collect()}
    sums, want = 0, {}
    for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id)):
        sums += r.n
        want[r.id] = sums
    assert got == {k: (v, sums) for k, v in want.items()}
    # Scores of a trained model, which lie close together, are ranked in many tasks.
    entries = rows.select("score", F.when(F.col("id") % 2 == 0, "positive").otherwise("negative").alias("label"))
    table = metrics.threshold_table(entries).collect()
    assert len(table) == entries.select("score").distinct().count() + 2 and max(r.tp + r.fp for r in table) == 2000


def test_files_are_zipped_by_place(spark, tmp_path):
    for name, n in (("ids", 500), ("scores", 500), ("short", 499)):
        (tmp_path / name).mkdir()
        for part in range(3):
            low, high = part * n // 3, (part + 1) * n // 3
            (tmp_path / name / f"{part}.txt").write_text("".join(f"{name}{i}\n" for i in range(low, high)))
    read = lambda name: by_position(spark.read.option("maxPartitionBytes", 200).text(str(tmp_path / name)).withColumnRenamed("value", name))
    ids = read("ids")
    got = {(r.place, r.ids, r.scores) for r in zipped(ids, read("scores")).collect()}
    assert got == {(i + 1, f"ids{i}", f"scores{i}") for i in range(500)}
    with pytest.raises(ValueError, match="500 rows on the left and 499"):
        zipped(ids, read("short"))


def test_a_missing_file_of_a_collection_stops_the_build(spark):
    from curatrix.schemas import FINGERPRINTS, IMAGES, schema

    images = spark.createDataFrame([], schema(IMAGES))
    prints = spark.createDataFrame([("p", True), ("broken", False)], "path string, readable boolean")
    for c in ("raw_sha", "pixel_digest"):
        prints = prints.withColumn(c, F.lit("x"))
    collection = lambda *paths: spark.createDataFrame([("s", i, p) for i, p in enumerate(paths)], "slug string, token_id long, local_path string")
    assert set(prints.columns) <= set(schema(FINGERPRINTS).names)
    assert [r.path for r in samples.samples(images, prints, collection("p", "broken")).collect()] == ["p"]
    with pytest.raises(Exception, match="missing file of a collection: gone"):
        samples.samples(images, prints, collection("p", "gone")).collect()
