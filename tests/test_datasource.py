"""The catalog as a data source: snapshots, pushed filters, and commits that conflict."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatrix.schemas import IMAGES, conform
from curatrix.sources import datasource
from curatrix.sources.versions import Catalog


def images(spark, n, **more):
    df = spark.range(0, n, 1, 3).select(F.format_string("%04d", "id").alias("sha256"), (F.col("id") % 7).cast("int").alias("width"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("created_at"), F.when(F.col("id") % 2 == 0, "train").alias("split"))
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return conform(df, IMAGES)


def test_snapshots_and_filters(spark, tmp_path):
    datasource.register(spark)
    root = str(tmp_path / "catalog")
    read = lambda **o: spark.read.format("curatrix").options(path=root, relation="images", **o).load()
    assert read().count() == 0 and read().columns == conform(images(spark, 1), IMAGES).columns
    c = Catalog(spark, root)
    c.write(images=images(spark, 100))
    c.write(images=images(spark, 30, label="positive"))
    assert read().count() == 30 and read(commit=1).count() == 100
    got, want = read(), c.read("images")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for where in ("width = 3", "width > 3 and width <= 5", "width >= 3", "width < 2", "split is null", "split is not null and sha256 like '000%'", "width in (1, 2)", "created_at > timestamp_seconds(1700000010)", "width + 1 = 3", "split = 'train' or width = 1"):
        assert sorted(r.sha256 for r in got.filter(where).collect()) == sorted(r.sha256 for r in want.filter(where).collect()), where

    # What is pushed is left out before it reaches Spark.
    reader = datasource.CatalogReader({"path": root, "relation": "images"}, got.schema)
    kept = list(reader.pushFilters([datasource.EqualTo(("width",), 3), datasource.GreaterThan(("nested", "x"), 1)]))
    assert len(kept) == 1 and len(reader.filters) == 1 and len(reader.partitions()) > 1
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == want.filter("width = 3").count()


def test_of_two_writers_one_is_told(spark, tmp_path):
    datasource.register(spark)
    root = str(tmp_path / "catalog")
    write = lambda df, **o: df.write.format("curatrix").options(path=root, relation="images", **o).mode("overwrite").save()
    write(images(spark, 10))
    c = Catalog(spark, root)
    assert c.snapshot().number == 1 and c.read("images").count() == 10
    write(images(spark, 20), commit=1)
    with pytest.raises(Exception, match="is taken"):
        write(images(spark, 99), commit=1)  # worked out from the same commit
    assert c.read("images").count() == 20 and c.snapshot().number == 2
    assert len([p for p in (tmp_path / "catalog" / "images").iterdir() if p.is_dir()]) == 2  # nothing is left of it
    c.write(exports=spark.createDataFrame([("e",)], "export_path string"))
    write(images(spark, 5))
    assert c.read("exports").count() == 1 and c.read("images").count() == 5
    with pytest.raises(Exception, match="overwrite"):
        images(spark, 1).write.format("curatrix").options(path=root, relation="images").mode("append").save()
