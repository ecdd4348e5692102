"""What each export has contributed, so that it can be taken out again.

A contribution is what one export says of one URL, and a catalog's row is the fold of its URL's contributions in the order in
which exports came. An export that comes for the first time is merged into the rows that are there. One that comes again takes its
old contributions out: sums could be lowered, but unions, first and last times and latest values cannot, so the URLs that its old
or new contributions name, and no others, are folded again from what is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.catalog import EXAMPLES, LISTS, merge_sightings, sighting_sums

#: The order of contributions: the commit that brought an export, and its place there.
ORDER = ("commit", "file_rank")


def part_name(export_path: Column) -> Column:
    """The name of an export's part: its path may hold anything, and be long."""
    return F.substring(F.sha2(export_path, 256), 1, 24)


def contributions(rows: DataFrame, commit: int | Column) -> DataFrame:
    """Rows of manifests (export_path, file_rank, position and those of an avatar) as contributions, one a URL of an export."""
    commit = commit if isinstance(commit, Column) else F.lit(commit)
    merged = rows.groupBy("export_path", "file_rank", "normalized_url").agg(*sighting_sums(F.struct("position")))
    return merged.withColumn("commit", commit.cast("long")).withColumn("part", part_name(F.col("export_path")))


def touched_urls(*some: DataFrame) -> DataFrame:
    """The URLs that contributions name."""
    out = some[0].select("normalized_url")
    for df in some[1:]:
        out = out.unionByName(df.select("normalized_url"))
    return out.distinct()


def refold(avatar_urls: DataFrame, live: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """The catalog's rows after the touched URLs are folded again from the live contributions. What was downloaded stays; a URL
    of which no contribution is left is gone, as it would never have come."""
    merged = merge_sightings(live.join(touched, "normalized_url", "left_semi"), list(ORDER)).withColumnRenamed("normalized_url", "__merged")
    again = touched.withColumnRenamed("normalized_url", "__url").join(merged, F.col("__url") == F.col("__merged"), "left")
    old, new = avatar_urls.alias("o"), again.alias("n")
    both = old.join(new, F.col("o.normalized_url") == F.col("n.__url"), "full_outer").filter("n.__url IS NULL OR n.__merged IS NOT NULL")
    hit = F.col("n.__url").isNotNull()
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    either = lambda c, fresh=None: F.when(hit, fresh if fresh is not None else n(c)).otherwise(o(c)).alias(c)
    return both.select(
        F.coalesce(n("__url"), o("normalized_url")).alias("normalized_url"), either("original_url"), *[either(c) for c in LISTS], either("seen_count"),
        either("first_seen_at", F.coalesce(n("first_seen_at"), now)), either("last_seen_at", F.coalesce(n("last_seen_at"), now)), *[either(c) for c in EXAMPLES], either("whitelisted"),
        o("image_sha256").alias("image_sha256"), F.coalesce(o("download_status"), F.lit("pending")).alias("download_status"), o("last_download_error").alias("last_download_error"),
        F.coalesce(o("created_at"), now).alias("created_at"), F.when(hit, now).otherwise(o("updated_at")).alias("updated_at"),
    )
