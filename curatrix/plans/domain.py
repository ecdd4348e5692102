"""The catalog's relations built from the driver's tables, and the same in SQL.

A document stands for an image, an event for a sighting, a label for one by hand or by the model, and two made-up runs score
all images. Every formula is in integers, so that both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import catalog as catalog_ops
from curatrix.operators import review
from curatrix.schemas import AVATAR_URLS as _AVATAR_URLS
from curatrix.shared import table

T0 = "2024-01-01 00:00:00"
CUT = "2024-01-16 00:00:00"
NOW = "2024-03-01 00:00:00"
RUN = "run-a"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def said(c: str | Column) -> Column:
    """A time as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def sha(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def images(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    i = F.col("doc_id")
    has = F.col("quality").isNotNull()
    return docs.join(labels, "doc_id", "left").select(
        sha(i).alias("sha256"), F.when(i % 29 != 0, F.concat(F.lit("cache/"), i.cast("string"), F.lit(".img"))).alias("local_path"), F.lit("image/png").alias("mime_type"),
        (F.col("n_chars") % 500 + 1).cast("int").alias("width"), (F.col("n_chars") % 300 + 1).cast("int").alias("height"), F.col("n_chars").alias("byte_size"), F.lit(None).cast("string").alias("split"),
        F.when(has, F.when(i % 41 == 0, "unclear").when(F.col("quality") == 1, "positive").otherwise("negative")).alias("label"),
        F.when(has, F.when(i % 3 == 0, "model").otherwise("manual")).alias("label_source"),
        F.when(has, F.timestamp_seconds(F.unix_timestamp(at(T0)) + i)).alias("labeled_at"), F.lit(None).cast("string").alias("review_notes"),
        at(T0).alias("created_at"), F.timestamp_seconds(F.unix_timestamp(at(T0)) + (i * 37 % 1000) * 60).alias("updated_at"),
    )


IMAGES = f"""images AS (SELECT sha256(CAST(d.doc_id AS VARCHAR)) AS sha256, CASE WHEN d.doc_id % 29 <> 0 THEN 'cache/' || d.doc_id || '.img' END AS local_path, 'image/png' AS mime_type,
    CAST(n_chars % 500 + 1 AS INT) AS width, CAST(n_chars % 300 + 1 AS INT) AS height, n_chars AS byte_size, CAST(NULL AS VARCHAR) AS split,
    CASE WHEN quality IS NULL THEN NULL WHEN d.doc_id % 41 = 0 THEN 'unclear' WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
    CASE WHEN quality IS NULL THEN NULL WHEN d.doc_id % 3 = 0 THEN 'model' ELSE 'manual' END AS label_source,
    CASE WHEN quality IS NOT NULL THEN TIMESTAMP '{T0}' + to_seconds(d.doc_id) END AS labeled_at, CAST(NULL AS VARCHAR) AS review_notes,
    TIMESTAMP '{T0}' AS created_at, TIMESTAMP '{T0}' + to_seconds((d.doc_id * 37 % 1000) * 60) AS updated_at
    FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(at(T0)) + 86400 * n)
    a = docs.select(F.lit("run-a").alias("run_id"), sha(i).alias("image_sha256"), (i * 7919 % 1000 / 1000.0).alias("score"), day(F.lit(1)).alias("created_at"))
    b = docs.filter(i % 4 != 0).select(F.lit("run-b").alias("run_id"), sha(i).alias("image_sha256"), (i * 104729 % 1000 / 1000.0).alias("score"), day(F.when(i % 5 == 0, 1).otherwise(2)).alias("created_at"))
    return a.unionByName(b).select("run_id", "image_sha256", "score", F.when(F.col("score") >= 0.5, "positive").otherwise("negative").alias("predicted_label"), F.lit(None).cast("string").alias("split"), "created_at")


SCORES = f"""scores AS (SELECT run_id, image_sha256, score, CASE WHEN score >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted_label, created_at FROM (
    SELECT 'run-a' AS run_id, sha256(CAST(doc_id AS VARCHAR)) AS image_sha256, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score, TIMESTAMP '{T0}' + INTERVAL 1 DAY AS created_at FROM documents
    UNION ALL SELECT 'run-b', sha256(CAST(doc_id AS VARCHAR)), (doc_id * 104729 % 1000) / 1000.0::DOUBLE, TIMESTAMP '{T0}' + to_days(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END) FROM documents WHERE doc_id % 4 <> 0))"""


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("run-a", 0.5)], "run_id string, threshold double")


THRESHOLDS = "thresholds AS (SELECT 'run-a' AS run_id, 0.5::DOUBLE AS threshold)"


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    surface = F.when(F.col("event_type") == "view", "notification-group").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(
        text("https://img.example/", u, "/", F.col("event_type"), "_400x400.jpg").alias("normalized_url"), text("https://img.example/", u, "/", F.col("event_type"), "_normal.jpg?e=", e).alias("original_url"),
        F.array(text("user", e % 7), F.when(e % 11 == 0, "").otherwise(text("alt", u % 5))).alias("handles"), F.array(text("Name ", u % 9)).alias("display_names"), F.array(surface).alias("source_surfaces"),
        (e % 3 + 1).alias("seen_count"), ts.alias("first_seen_at"), (ts + F.expr("INTERVAL 1 MINUTE")).alias("last_seen_at"),
        F.when(e % 4 == 0, "").otherwise(text("https://p.example/", e)).alias("example_profile_url"), F.when(F.col("event_type") == "view", text("https://n.example/", e)).alias("example_notification_url"),
        F.when(e % 5 == 0, text("https://t.example/", e)).alias("example_tweet_url"), (u % 23 == 0).alias("whitelisted"), F.floor(e / 1000).alias("file_rank"), (e % 1000).alias("position"), u.alias("user_id"), e.alias("event_id"), ts.alias("ts"), "event_type",
    )


ROWS = """manifest_rows AS (SELECT 'https://img.example/' || user_id || '/' || event_type || '_400x400.jpg' AS normalized_url, 'https://img.example/' || user_id || '/' || event_type || '_normal.jpg?e=' || event_id AS original_url,
    ['user' || (event_id % 7), CASE WHEN event_id % 11 = 0 THEN '' ELSE 'alt' || (user_id % 5) END] AS handles, ['Name ' || (user_id % 9)] AS display_names, [CASE WHEN event_type = 'view' THEN 'notification-group' ELSE event_type END] AS source_surfaces,
    event_id % 3 + 1 AS seen_count, date_trunc('second', ts) AS first_seen_at, date_trunc('second', ts) + INTERVAL 1 MINUTE AS last_seen_at,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://p.example/' || event_id END AS example_profile_url, CASE WHEN event_type = 'view' THEN 'https://n.example/' || event_id END AS example_notification_url,
    CASE WHEN event_id % 5 = 0 THEN 'https://t.example/' || event_id END AS example_tweet_url, user_id % 23 = 0 AS whitelisted, event_id, user_id, date_trunc('second', ts) AS ts, event_type FROM events)"""


def merged_sql(name: str, where: str = "true") -> str:
    """What A1 makes of the rows, in SQL."""
    union = lambda c: f"list_sort(list_distinct(list_filter(flatten(list({c})), lambda x: x <> ''))) AS {c}"
    last = lambda c: f"arg_max({c}, event_id) FILTER (WHERE coalesce({c}, '') <> '') AS {c}"
    return f"""{name} AS (SELECT normalized_url, arg_max(original_url, event_id) AS original_url, {union('handles')}, {union('display_names')}, {union('source_surfaces')}, sum(seen_count)::BIGINT AS seen_count,
        min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, {last('example_profile_url')}, {last('example_notification_url')}, {last('example_tweet_url')}, bool_or(whitelisted) AS whitelisted, min(user_id) AS user_id
        FROM manifest_rows WHERE {where} GROUP BY normalized_url)"""


def merged(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return catalog_ops.merge_sightings(manifest_rows(spark, d).filter(where), ["file_rank", "position"])


def avatar_urls(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of all rows; a URL's image is the one of its user, but for users that five divides: those are pending or
    failed."""
    rows = catalog_ops.merge_into_catalog(spark.createDataFrame([], _AVATAR_URLS), merged(spark, d), at(NOW))
    user = F.split_part("normalized_url", F.lit("/"), F.lit(4)).cast("long")
    return rows.withColumn("image_sha256", F.when(user % 5 != 0, sha(user))).withColumn("download_status", F.when(user % 5 != 0, "downloaded").when(user % 2 == 0, "failed").otherwise("pending")).withColumn("created_at", at(T0))


AVATAR_URLS = f"avatar_urls AS (SELECT *, CASE WHEN user_id % 5 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END AS image_sha256, CASE WHEN user_id % 5 <> 0 THEN 'downloaded' WHEN user_id % 2 = 0 THEN 'failed' ELSE 'pending' END AS download_status, TIMESTAMP '{T0}' AS created_at, TIMESTAMP '{NOW}' AS updated_at FROM merged)"

def items(spark: SparkSession, d: str, run_id: str | None = RUN) -> DataFrame:
    return review.review_items(images(spark, d), scores(spark, d), avatar_urls(spark, d), thresholds(spark), run_id)


def _rollup() -> str:
    union = lambda c: f"list_sort(list_distinct(list_filter(flatten(list({c})), lambda x: x <> ''))) AS {c}"
    first = lambda c: f"arg_min({c}, normalized_url) FILTER (WHERE coalesce({c}, '') <> '') AS {c}"
    return f"""rollup_ AS (SELECT image_sha256 AS sha256, {union('handles')}, {union('display_names')}, {union('source_surfaces')}, sum(seen_count)::BIGINT AS seen_count, count(*) AS url_count, bool_or(whitelisted) AS whitelisted,
        {first('example_profile_url')}, {first('example_notification_url')}, {first('example_tweet_url')}, max(last_seen_at) AS last_seen_at FROM avatar_urls WHERE image_sha256 IS NOT NULL GROUP BY image_sha256)"""


def items_sql(picked: str = f"SELECT * FROM scores WHERE run_id = '{RUN}'") -> str:
    return ", ".join([IMAGES, SCORES, THRESHOLDS, ROWS, merged_sql("merged"), AVATAR_URLS, _rollup(), f"picked AS ({picked})", """items AS (SELECT i.sha256, local_path, width, height, label, label_source, labeled_at, review_notes, updated_at,
        coalesce(handles, []) AS handles, coalesce(display_names, []) AS display_names, coalesce(source_surfaces, []) AS source_surfaces, coalesce(seen_count, 0) AS seen_count, coalesce(url_count, 0) AS url_count, coalesce(whitelisted, false) AS whitelisted,
        example_profile_url, example_notification_url, example_tweet_url, last_seen_at, p.run_id, score, predicted_label, threshold, abs(score - threshold) AS distance,
        CASE WHEN label IS NOT NULL AND label <> 'unclear' AND predicted_label IS NOT NULL AND label <> predicted_label THEN ['human_vs_model'] ELSE [] END AS flags
        FROM images i LEFT JOIN picked p ON i.sha256 = p.image_sha256 LEFT JOIN rollup_ r ON i.sha256 = r.sha256 LEFT JOIN thresholds t ON p.run_id = t.run_id)"""])  # fmt: skip


def samples(spark: SparkSession, d: str, digits: int = 12) -> DataFrame:
    """Documents as samples: the hash of a short prefix stands for bytes, the hash of a longer run for pixels."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    export = i % 3 != 0
    plain = F.regexp_replace(F.lower(text), "[^a-z]+", "")
    return docs.join(labels, "doc_id", "left").select(
        F.when(export, F.concat(F.lit("export:"), i.cast("string"))).otherwise(F.concat(F.lit("collection:c:"), i.cast("string"))).alias("sample_id"), F.concat(F.lit("cache/"), i.cast("string")).alias("path"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, "positive").otherwise("negative").alias("label"), F.when(export, "export").otherwise("c").alias("source"),
        F.sha2(text, 256).alias("raw_sha"), F.sha2(F.substring(plain, 1, digits), 256).alias("pixel_digest"), F.when(export & (i % 2 == 0), "manual").otherwise("model").alias("label_source"),
        F.when(export & (i % 2 == 0), "gold").otherwise("trusted").alias("label_tier"), F.when(export, 1.0).otherwise(0.5).alias("sample_weight"), (export & (i % 2 == 0)).alias("blind_eval_eligible"), F.when(export, sha(i)).alias("exported_sha"),
    )


SAMPLES = """samples AS (SELECT CASE WHEN d.doc_id % 3 <> 0 THEN 'export:' || d.doc_id ELSE 'collection:c:' || d.doc_id END AS sample_id, CASE WHEN coalesce(quality, 1) = 1 THEN 'positive' ELSE 'negative' END AS label,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'export' ELSE 'c' END AS source, sha256(coalesce(text, '')) AS raw_sha, sha256(substr(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g'), 1, 12)) AS pixel_digest,
    CASE WHEN d.doc_id % 3 <> 0 AND d.doc_id % 2 = 0 THEN 'gold' ELSE 'trusted' END AS label_tier, d.doc_id % 3 <> 0 AND d.doc_id % 2 = 0 AS blind_eval_eligible, d.doc_id,
    CASE WHEN d.doc_id % 3 <> 0 AND d.doc_id % 2 = 0 THEN 'manual' ELSE 'model' END AS label_source, CASE WHEN d.doc_id % 3 <> 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS sample_weight
    FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a split by their number and a score, as the evaluation reads them."""
    i = F.split_part("sample_id", F.lit(":"), F.lit(-1)).cast("long")
    return samples(spark, d).select(F.col("sample_id").alias("id"), "path", "label", "source", F.when(i % 10 < 7, "train").when(i % 10 < 9, "val").otherwise("test").alias("split"), "label_source", "label_tier", "sample_weight", (i * 7919 % 1000 / 1000.0).alias("score"))


ENTRIES = "entries AS (SELECT sample_id AS id, label, source, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, label_source, label_tier, sample_weight, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM samples)"


def label_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of labels by hand; every run of four is a batch, but for every third run."""
    e = F.col("event_id")
    label = F.when(F.col("event_type") == "error", "unclear").when(F.col("event_type").isin("click", "purchase"), "positive").otherwise("negative")
    batch = F.floor(e / 4)
    return table(spark, d, "events").select(
        (e + 1).alias("id"), sha(F.col("user_id")).alias("image_sha256"), F.lit(None).cast("string").alias("previous_label"), F.lit(None).cast("string").alias("previous_label_source"), F.lit(None).cast("timestamp").alias("previous_labeled_at"),
        F.lit(None).cast("string").alias("previous_review_notes"), label.alias("new_label"), F.lit(None).cast("string").alias("new_review_notes"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(batch % 3 != 0, F.concat(F.lit("batch-"), batch.cast("string"))).alias("batch_id"),
    )


LABEL_EVENTS = """label_events AS (SELECT event_id + 1 AS id, sha256(CAST(user_id AS VARCHAR)) AS image_sha256, CASE WHEN event_type = 'error' THEN 'unclear' WHEN event_type IN ('click', 'purchase') THEN 'positive' ELSE 'negative' END AS new_label,
    date_trunc('second', ts) AS created_at, CASE WHEN (event_id // 4) % 3 <> 0 THEN 'batch-' || (event_id // 4) END AS batch_id FROM events)"""


def sighting_events(events: DataFrame) -> DataFrame:
    """The stream's records from rows of events, in a batch or a stream."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), text("https://img.example/", u, "_400x400.jpg").alias("normalized_url"), text("https://img.example/", u, "_normal.jpg?e=", e).alias("original_url"), text("user", u % 97).alias("handle"),
        F.when(e % 5 != 0, text("Name ", e % 13)).alias("display_name"), F.col("event_type").alias("surface"), (u % 25 == 0).alias("whitelisted"), text("https://p.example/", e).alias("profile_url"), F.lit(None).cast("string").alias("notification_url"),
        F.when(e % 3 == 0, text("https://t.example/", e)).otherwise("").alias("tweet_url"), (F.col("event_type") == "click").alias("matched"), F.when(F.col("event_type") == "error", "error").when(e % 2 == 0, "cache").otherwise("model").alias("score_source"),
        text("e", u % 50).alias("element"), text("user", u % 97, ":", F.floor(e / 500)).alias("signature"),
    )


SIGHTINGS = """sightings AS (SELECT ts, event_id, 'https://img.example/' || user_id || '_400x400.jpg' AS normalized_url, 'https://img.example/' || user_id || '_normal.jpg?e=' || event_id AS original_url, 'user' || (user_id % 97) AS handle,
    CASE WHEN event_id % 5 <> 0 THEN 'Name ' || (event_id % 13) END AS display_name, event_type AS surface, user_id % 25 = 0 AS whitelisted, 'https://p.example/' || event_id AS profile_url,
    CASE WHEN event_id % 3 = 0 THEN 'https://t.example/' || event_id ELSE '' END AS tweet_url, event_type = 'click' AS matched, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'cache' ELSE 'model' END AS score_source,
    'e' || (user_id % 50) AS element, 'user' || (user_id % 97) || ':' || (event_id // 500) AS signature FROM events)"""
