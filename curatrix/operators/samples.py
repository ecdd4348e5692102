"""From catalog and collections to samples and dataset entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import label_tier
from curatrix.schemas import MANUAL, MODEL

COLLECTION_WEIGHT = 0.5


def trainable(images: DataFrame) -> DataFrame:
    return images.filter(F.col("label").isin("positive", "negative") & F.col("local_path").isNotNull() & F.col("label_source").isin(MANUAL, MODEL)).orderBy("sha256")


def collection_rows(manifest: DataFrame, specs: DataFrame) -> DataFrame:
    """(slug, token_id, local_path) of the manifest's samples that were fetched; a slug without a spec is an error. specs is
    a fixed list of collections."""
    rows = manifest.select(F.explode("collections").alias("c")).select("c.slug", F.explode("c.samples").alias("s")).filter("s.status = 'ok'").select("slug", "s.token_id", "s.local_path")
    known = specs.select("slug").distinct().withColumn("__known", F.lit(True))
    return rows.join(known, "slug", "left").withColumn("slug", F.when(F.col("__known"), F.col("slug")).otherwise(F.raise_error(F.concat(F.lit("unknown collection: "), F.col("slug"))).cast("string"))).drop("__known")


def samples(images: DataFrame, fingerprints: DataFrame, collections: DataFrame, weight: float = COLLECTION_WEIGHT) -> DataFrame:
    """The union of collection rows (slug, token_id, local_path) and trainable images, with fingerprints by path.

    Unreadable collection files are left out; a collection file without a fingerprint, which is missing then, is an error, and so
    is an unreadable or missing exported file.
    """
    prints = fingerprints.select(F.col("path").alias("__path"), F.col("raw_sha").alias("__raw"), F.col("pixel_digest").alias("__pixels"), "readable")
    there = F.coalesce("readable", F.raise_error(F.concat(F.lit("missing file of a collection: "), F.coalesce("local_path", F.lit("no path")))).cast("boolean"))
    of_collections = collections.join(prints, F.col("local_path") == F.col("__path"), "left").filter(there).select(
        F.concat_ws(":", F.lit("collection"), "slug", F.col("token_id").cast("string")).alias("sample_id"), F.col("local_path").alias("path"), F.lit("positive").alias("label"), F.col("slug").alias("source"),
        F.col("__raw").alias("raw_sha"), F.col("__pixels").alias("pixel_digest"), F.lit("collection").alias("label_source"), F.lit("trusted").alias("label_tier"),
        F.lit(float(weight)).alias("sample_weight"), F.lit(False).alias("blind_eval_eligible"), F.lit(None).cast("string").alias("exported_sha"),
    )
    exported = trainable(images).join(prints, F.col("local_path") == F.col("__path"), "left")
    digest = F.when(F.coalesce("readable", F.lit(False)), F.col("__pixels")).otherwise(F.raise_error(F.concat(F.lit("missing or unreadable: "), F.col("local_path"))).cast("string"))
    tier = label_tier(F.col("label_source"))
    of_exports = exported.select(
        F.concat(F.lit("export:"), F.col("sha256")).alias("sample_id"), F.col("local_path").alias("path"), "label", F.lit("export").alias("source"), F.col("sha256").alias("raw_sha"), digest.alias("pixel_digest"),
        "label_source", tier.alias("label_tier"), F.lit(1.0).alias("sample_weight"), (tier == "gold").alias("blind_eval_eligible"), F.col("sha256").alias("exported_sha"),
    )
    return of_collections.unionByName(of_exports)


def dataset_entries(manifest: DataFrame) -> DataFrame:
    """Entries of the manifest's canonicals with their split, as the dataset files hold them."""
    c = F.col("canonical")
    return manifest.select(c["sample_id"].alias("id"), c["path"].alias("path"), c["label"].alias("label"), c["source"].alias("source"), "split", c["label_source"].alias("label_source"), c["label_tier"].alias("label_tier"), c["sample_weight"].alias("sample_weight"))


def build_summary(samples_: DataFrame, groups: DataFrame) -> DataFrame:
    n = samples_.agg(F.count("*").alias("samples"), F.sum(F.col("blind_eval_eligible").cast("long")).alias("eligible_samples"))
    g = groups.agg(F.count("*").alias("families"), F.sum(F.col("eligible").cast("long")).alias("eligible_families"))
    return n.crossJoin(F.broadcast(g)).select("samples", "families", (F.col("samples") - F.col("families")).alias("duplicates_removed"), "eligible_samples", "eligible_families")


def collection_results(fetched: DataFrame) -> DataFrame:
    """Rows by collection: fetched and failed."""
    return fetched.groupBy("slug").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def in_token_order(fetched: DataFrame) -> DataFrame:
    """A collection's outcomes in the order of its tokens: numbers by size, then names."""
    number = F.col("token_id").try_cast("long")
    return fetched.orderBy("slug", F.asc_nulls_last(number), "token_id")
