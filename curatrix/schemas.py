"""Relations of the catalog and their domains, all explicit: nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


POSITIVE, NEGATIVE, UNCLEAR = "positive", "negative", "unclear"
LABELS = (POSITIVE, NEGATIVE, UNCLEAR)
MANUAL, MODEL = "manual", "model"
SPLITS = ("train", "val", "test")
FILTER_MODES = ("off", "hide", "fade", "debug")

AVATAR = (
    "normalized_url STRING, original_url STRING, handles ARRAY<STRING>, display_names ARRAY<STRING>, source_surfaces ARRAY<STRING>, "
    "seen_count BIGINT, first_seen_at STRING, last_seen_at STRING, example_profile_url STRING, example_notification_url STRING, "
    "example_tweet_url STRING, whitelisted BOOLEAN"
)
MANIFEST = f"version INT, exported_at STRING, avatar_count INT, total_sightings BIGINT, avatars ARRAY<STRUCT<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in AVATAR.split(', '))}>>"
COLLECTIONS = "collections ARRAY<STRUCT<slug: STRING, samples: ARRAY<STRUCT<token_id: BIGINT, local_path: STRING, status: STRING, error: STRING>>>>"
DATASET_ENTRY = "id STRING, path STRING, label STRING, source STRING, split STRING, label_source STRING, label_tier STRING, sample_weight DOUBLE"

EXPORTS = "export_path STRING, export_name STRING, exported_at TIMESTAMP, ingested_at TIMESTAMP, version INT, avatar_count BIGINT, total_sightings BIGINT"
AVATAR_URLS = (
    "normalized_url STRING, original_url STRING, handles ARRAY<STRING>, display_names ARRAY<STRING>, source_surfaces ARRAY<STRING>, "
    "seen_count BIGINT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, example_profile_url STRING, example_notification_url STRING, "
    "example_tweet_url STRING, whitelisted BOOLEAN, image_sha256 STRING, download_status STRING, last_download_error STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
IMAGES = (
    "sha256 STRING, local_path STRING, mime_type STRING, width INT, height INT, byte_size BIGINT, split STRING, label STRING, "
    "label_source STRING, labeled_at TIMESTAMP, review_notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
MODEL_SCORES = "run_id STRING, image_sha256 STRING, score DOUBLE, predicted_label STRING, split STRING, created_at TIMESTAMP"
LABEL_EVENTS = (
    "id BIGINT, image_sha256 STRING, previous_label STRING, previous_label_source STRING, previous_labeled_at TIMESTAMP, "
    "previous_review_notes STRING, new_label STRING, new_review_notes STRING, created_at TIMESTAMP, batch_id STRING"
)
FINGERPRINTS = "path STRING, file_size BIGINT, mtime_ns BIGINT, image_size INT, raw_sha STRING, pixel_digest STRING, width INT, height INT, readable BOOLEAN, updated_at TIMESTAMP"
SAMPLES = (
    "sample_id STRING, path STRING, label STRING, source STRING, raw_sha STRING, pixel_digest STRING, label_source STRING, "
    "label_tier STRING, sample_weight DOUBLE, blind_eval_eligible BOOLEAN, exported_sha STRING"
)
RELATIONS = {"exports": EXPORTS, "avatar_urls": AVATAR_URLS, "images": IMAGES, "model_scores": MODEL_SCORES, "label_events": LABEL_EVENTS, "file_fingerprints": FINGERPRINTS}
#: Relations whose versions are parts, one for each export: what it contributed, and its file as it came.
CONTRIBUTIONS = (
    "export_path STRING, commit BIGINT, file_rank INT, normalized_url STRING, original_url STRING, handles ARRAY<STRING>, display_names ARRAY<STRING>, source_surfaces ARRAY<STRING>, "
    "seen_count BIGINT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, example_profile_url STRING, example_notification_url STRING, example_tweet_url STRING, whitelisted BOOLEAN"
)
ARCHIVE = "export_path STRING, source_path STRING, modified TIMESTAMP, byte_size BIGINT, sha256 STRING, content BINARY"
PARTED = {"contributions": CONTRIBUTIONS, "archive": ARCHIVE}
#: Foreign keys: child, its column, parent, its column.
REFERENCES = (("avatar_urls", "image_sha256", "images", "sha256"), ("model_scores", "image_sha256", "images", "sha256"), ("label_events", "image_sha256", "images", "sha256"))


def empty(spark, relation: str) -> DataFrame:
    """An empty relation, as create-if-absent gives it."""
    return spark.createDataFrame([], schema(RELATIONS[relation]))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl: casts, adds what is missing as null, drops the rest (the add-column migration)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl)])


def ensure_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(_parse_datatype_string(kind)))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no parent; a sound catalog has none."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
