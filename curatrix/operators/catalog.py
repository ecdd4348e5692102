"""The catalog as pure functions: (state, delta) -> new state. What they return is written as a new version; nothing that
is being read is overwritten. Each upsert is one shuffle on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import earliest_time, latest, latest_time, merge_lists, no_strings

LISTS = ("handles", "display_names", "source_surfaces")
EXAMPLES = ("example_profile_url", "example_notification_url", "example_tweet_url")


def _last_truthy(column: str, order: Column) -> Column:
    """Of a group the last value that is neither null nor empty, in the order given; else null."""
    return F.max_by(column, F.when(F.coalesce(F.col(column), F.lit("")) != "", order))


def sighting_sums(order: Column) -> list[Column]:
    """What a group of manifest rows comes to; lists are collected as sets, so a hot URL costs what it has of different values,
    not its rows."""
    union = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce(F.col(c), no_strings()))), lambda x: x != "")))
    return [
        F.max_by("original_url", order).alias("original_url"),
        *[union(c).alias(c) for c in LISTS],
        F.sum("seen_count").cast("long").alias("seen_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        *[_last_truthy(c, order).alias(c) for c in EXAMPLES],
        F.coalesce(F.bool_or("whitelisted"), F.lit(False)).alias("whitelisted"),
    ]


def merge_sightings(rows: DataFrame, order: list[str]) -> DataFrame:
    """Fold rows of manifests into one row for each normalized_url.

    Lists become sorted distinct unions, counts are summed, times are first and last, whitelisted is true if it ever was;
    original_url is the last one and an example the last that is not empty, in the order of the columns given.
    """
    return rows.groupBy("normalized_url").agg(*sighting_sums(F.struct(*order)))


def merge_into_catalog(catalog: DataFrame, merged: DataFrame, now: Column) -> DataFrame:
    """The avatar_urls that a merged delta leaves: an outer join on the URL. Known rows keep their download state."""
    old, new = catalog.alias("o"), merged.alias("n")
    both = old.join(new, F.col("o.normalized_url") == F.col("n.normalized_url"), "full_outer")
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    touched = n("normalized_url").isNotNull()
    return both.select(
        F.coalesce(n("normalized_url"), o("normalized_url")).alias("normalized_url"),
        F.coalesce(n("original_url"), o("original_url")).alias("original_url"),
        *[F.when(touched, merge_lists(o(c), n(c))).otherwise(o(c)).alias(c) for c in LISTS],
        (F.coalesce(o("seen_count"), F.lit(0)) + F.coalesce(n("seen_count"), F.lit(0))).cast("long").alias("seen_count"),
        F.when(touched, earliest_time(o("first_seen_at"), n("first_seen_at"), now)).otherwise(o("first_seen_at")).alias("first_seen_at"),
        F.when(touched, latest_time(o("last_seen_at"), n("last_seen_at"), now)).otherwise(o("last_seen_at")).alias("last_seen_at"),
        *[latest(n(c), o(c)).alias(c) for c in EXAMPLES],
        (F.coalesce(o("whitelisted"), F.lit(False)) | F.coalesce(n("whitelisted"), F.lit(False))).alias("whitelisted"),
        o("image_sha256").alias("image_sha256"),
        F.coalesce(o("download_status"), F.lit("pending")).alias("download_status"),
        o("last_download_error").alias("last_download_error"),
        F.coalesce(o("created_at"), now).alias("created_at"),
        F.when(touched, now).otherwise(o("updated_at")).alias("updated_at"),
    )


def new_exports(discovered: DataFrame, ledger: DataFrame) -> DataFrame:
    """Exports (source_path, stored_path) that the ledger knows under neither path."""
    known = ledger.select(F.col("export_path").alias("__path"))
    left = discovered.join(known, F.col("source_path") == F.col("__path"), "left_anti")
    return left.join(known, F.col("stored_path") == F.col("__path"), "left_anti")


def rename_archived(ledger: DataFrame, discovered: DataFrame) -> DataFrame:
    """The ledger with the stored path for exports that were ingested from their source and are archived now."""
    moved = discovered.groupBy(F.col("source_path").alias("__source")).agg(F.min("stored_path").alias("__stored"))
    return ledger.join(moved, F.col("export_path") == F.col("__source"), "left").withColumn("export_path", F.coalesce("__stored", "export_path")).drop("__source", "__stored")


def log_exports(ledger: DataFrame, ingested: DataFrame, force: bool = False) -> DataFrame:
    """The ledger after an ingest; with force, rows of the same path are replaced rather than counted again."""
    kept = ledger.join(ingested.select(F.col("export_path").alias("__path")), F.col("export_path") == F.col("__path"), "left_anti") if force else ledger
    return kept.unionByName(ingested)


def pending_downloads(avatar_urls: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    wanted = (F.col("download_status") == "pending") | (F.lit(retry_failed) & (F.col("download_status") == "failed"))
    found = avatar_urls.filter(F.col("image_sha256").isNull() & wanted).orderBy(F.desc("seen_count"), F.desc("updated_at"), "normalized_url")
    return found.limit(limit) if limit is not None else found


def scorable_images(images: DataFrame, limit: int | None = None) -> DataFrame:
    found = images.filter(F.col("local_path").isNotNull()).orderBy(F.desc("updated_at"), "sha256")
    return found.limit(limit) if limit is not None else found


def upsert(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta replace those of state with the same key. delta: one row a key, the columns of state."""
    gone = delta.select(*[F.col(k).alias(f"__{k}") for k in keys])
    match = None
    for k in keys:
        same = F.col(k) == F.col(f"__{k}")
        match = same if match is None else match & same
    return state.join(gone, match, "left_anti").unionByName(delta.select(*state.columns))


def record_images(images: DataFrame, downloads: DataFrame, now: Column) -> DataFrame:
    """Images after downloads (sha256, local_path, mime_type, width, height, byte_size, ord): the same bytes are one row, a
    later download's metadata wins, and labels and splits of known images stay."""
    meta = ("local_path", "mime_type", "width", "height", "byte_size")
    last = downloads.groupBy("sha256").agg(F.max_by(F.struct(*meta), "ord").alias("m")).withColumnRenamed("sha256", "__sha")
    both = images.join(last, F.col("sha256") == F.col("__sha"), "full_outer")
    hit = F.col("__sha").isNotNull()
    out = both.withColumn("sha256", F.coalesce("sha256", "__sha"))
    for c in meta:
        out = out.withColumn(c, F.when(hit, F.col(f"m.{c}")).otherwise(F.col(c)))
    return out.withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(*images.columns)


def record_outcomes(avatar_urls: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """URLs after downloads (normalized_url, sha256, error): downloaded with an image, or failed with an error. Of a URL's
    outcomes one with an image counts, of these the last by hash."""
    best = F.max(F.struct(F.col("sha256").isNotNull().alias("ok"), "sha256", "error")).alias("b")
    done = outcomes.groupBy(F.col("normalized_url").alias("__url")).agg(best).select("__url", F.col("b.sha256").alias("__sha"), F.col("b.error").alias("__error"))
    both = avatar_urls.join(done, F.col("normalized_url") == F.col("__url"), "left")
    hit, ok = F.col("__url").isNotNull(), F.col("__sha").isNotNull()
    return (
        both.withColumn("image_sha256", F.when(ok, F.col("__sha")).otherwise(F.col("image_sha256")))
        .withColumn("download_status", F.when(ok, "downloaded").when(hit, "failed").otherwise(F.col("download_status")))
        .withColumn("last_download_error", F.when(ok, F.lit(None)).when(hit, F.col("__error")).otherwise(F.col("last_download_error")))
        .withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
        .select(*avatar_urls.columns)
    )


def stale_fingerprints(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, file_size, mtime_ns, image_size) whose cached fingerprint is missing or of another size or time."""
    keys = ["path", "file_size", "mtime_ns", "image_size"]
    return files.join(cache.select(*keys).distinct(), keys, "left_anti")


def set_splits(images: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Images with the split of the members (exported_sha, split) that stand for them; these are updated now."""
    given = members.filter("exported_sha is not null").groupBy("exported_sha").agg(F.max("split").alias("__split"))
    return images.join(given, F.col("sha256") == F.col("exported_sha"), "left").withColumn("updated_at", F.when(F.col("__split").isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("split", F.coalesce("__split", "split")).select(*images.columns)
