"""Queries of items, queues, labels and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.operators import accounts, catalog, labels, review
from curatrix.plans import domain as D
from curatrix.plans.registry import query
from curatrix.schemas import FINGERPRINTS, conform, orphans
from curatrix.shared import materialise, placed, shared_folder, table

LISTS = ("handles", "display_names", "source_surfaces")


def _sql_list(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


MERGED = f"normalized_url, original_url, {', '.join(map(_sql_list, LISTS))}, seen_count, {_stamp('first_seen_at')}, {_stamp('last_seen_at')}, example_profile_url, example_notification_url, example_tweet_url, whitelisted"


def _shown(df, *more):
    return df.select("normalized_url", "original_url", *map(D.joined, LISTS), "seen_count", D.said("first_seen_at").alias("first_seen_at"), D.said("last_seen_at").alias("last_seen_at"), "example_profile_url", "example_notification_url", "example_tweet_url", "whitelisted", *more)


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')} SELECT {MERGED} FROM merged")
def sighting_merge(spark, d):
    return _shown(D.merged(spark, d))


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')}, n AS (SELECT normalized_url AS u, count(*) FILTER (WHERE ts < TIMESTAMP '{D.CUT}') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '{D.CUT}') AS after FROM manifest_rows GROUP BY 1) SELECT {MERGED}, CASE WHEN before > 0 THEN 'old' ELSE 'new' END AS kind, CASE WHEN after > 0 THEN '{D.NOW}' ELSE '{D.CUT}' END AS updated FROM merged JOIN n ON normalized_url = u")
def merge_into_catalog(spark, d):
    """Folding the second half into a catalog of the first equals folding all."""
    old = catalog.merge_into_catalog(spark.createDataFrame([], D._AVATAR_URLS), D.merged(spark, d, f"ts < '{D.CUT}'"), D.at(D.CUT))
    new = catalog.merge_into_catalog(old, D.merged(spark, d, f"ts >= '{D.CUT}'"), D.at(D.NOW))
    return _shown(new, F.when(F.col("created_at") == D.at(D.CUT), "old").otherwise("new").alias("kind"), D.said("updated_at").alias("updated"))


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')}, {D.AVATAR_URLS} SELECT normalized_url, seen_count, download_status FROM avatar_urls WHERE image_sha256 IS NULL AND download_status IN ('pending', 'failed') ORDER BY seen_count DESC, normalized_url LIMIT 50")
def pending_downloads(spark, d):
    return catalog.pending_downloads(D.avatar_urls(spark, d), retry_failed=True, limit=50).select("normalized_url", "seen_count", "download_status")


@query(f"WITH {D.IMAGES} SELECT sha256, local_path FROM images WHERE local_path IS NOT NULL ORDER BY updated_at DESC, sha256 LIMIT 100")
def scorable_images(spark, d):
    return catalog.scorable_images(D.images(spark, d), 100).select("sha256", "local_path")


ITEM = f"sha256, local_path, width, height, label, label_source, {_stamp('labeled_at')}, {', '.join(map(_sql_list, LISTS))}, seen_count, url_count, whitelisted, example_profile_url, example_notification_url, example_tweet_url, {_stamp('last_seen_at')}, run_id, score, predicted_label, threshold, round(distance, 9) AS distance, array_to_string(flags, ',') AS flags"


def _items(df):
    return df.select(
        "sha256", "local_path", "width", "height", "label", "label_source", D.said("labeled_at").alias("labeled_at"), *map(D.joined, LISTS), "seen_count", "url_count", "whitelisted", "example_profile_url", "example_notification_url", "example_tweet_url",
        D.said("last_seen_at").alias("last_seen_at"), "run_id", "score", "predicted_label", "threshold", F.round("distance", 9).alias("distance"), D.joined("flags"),
    )


@query(f"WITH {D.items_sql()} SELECT {ITEM} FROM items")
def review_items(spark, d):
    return _items(D.items(spark, d))


@query(f"WITH {D.items_sql('SELECT s.* FROM scores s JOIN (SELECT image_sha256 AS i, max(created_at) AS c FROM scores GROUP BY 1) m ON s.image_sha256 = m.i AND s.created_at = m.c')} SELECT {ITEM} FROM items")
def latest_score_items(spark, d):
    return _items(D.items(spark, d, None))


@query(f"WITH {D.SCORES} SELECT image_sha256, run_id, score FROM (SELECT *, rank() OVER (PARTITION BY image_sha256 ORDER BY created_at DESC) AS r FROM scores) WHERE r = 1")
def latest_score_per_image(spark, d):
    return review.latest_scores(D.scores(spark, d)).select("image_sha256", "run_id", "score")


TIES = "updated_at DESC NULLS LAST, sha256, run_id NULLS FIRST"
_NEEDS = "label_source IS DISTINCT FROM 'manual'"
QUEUE_SQL = {
    "needs_review": (_NEEDS, "seen_count DESC, last_seen_at DESC NULLS LAST, coalesce(score, -1) DESC"),
    "model_disagreements": ("list_contains(flags, 'human_vs_model')", "coalesce(score, -1) DESC, seen_count DESC, labeled_at DESC NULLS LAST"),
    "exempted": ("whitelisted", "seen_count DESC"),
    "high_impact": ("true", "seen_count DESC"),
    "notifications": ("list_contains(source_surfaces, 'notification-group')", "seen_count DESC"),
    "boundary_review": (f"{_NEEDS} AND score IS NOT NULL AND threshold IS NOT NULL AND distance IS NOT NULL", "distance, seen_count DESC"),
    "model_backlog": (f"{_NEEDS} AND score IS NOT NULL", "score DESC"),
    "hard_negatives": ("label = 'negative' AND score IS NOT NULL", "score DESC"),
}


def _queue(name: str):
    """A whole queue, with each item's place in it."""

    def run(spark, d):
        return placed(D.items(spark, d).filter(review.queue_filter(name)), review._order(name)).select("place", "sha256", "score", "seen_count", "label")

    return run


for _name, (_where, _by) in QUEUE_SQL.items():
    query(f"WITH {D.items_sql()} SELECT row_number() OVER (ORDER BY {_by}, {TIES})::BIGINT AS place, sha256, score, seen_count, label FROM items WHERE {_where}", f"queue_{_name}")(_queue(_name))


@query(f"WITH {D.items_sql()} SELECT row_number() OVER (ORDER BY len(flags) DESC, coalesce(score, -1) DESC, seen_count DESC, labeled_at DESC NULLS LAST, {TIES})::BIGINT AS place, sha256, label, score, len(flags)::BIGINT AS n_flags FROM items WHERE label IS NOT NULL")
def labeled_grid(spark, d):
    found = review.labeled_grid(D.items(spark, d))
    return placed(found, review._order("labeled")).select("place", "sha256", "label", "score", F.size("flags").cast("long").alias("n_flags"))


@query(f"WITH {D.items_sql()} SELECT sha256, label FROM items WHERE label = 'unclear'")
def labeled_grid_unclear(spark, d):
    return review.labeled_grid(D.items(spark, d), "unclear").select("sha256", "label")


@query(f"WITH {D.items_sql()} SELECT sha256, seen_count FROM items ORDER BY seen_count DESC, {TIES} LIMIT 9 OFFSET 18")
def queue_page(spark, d):
    return review.page(D.items(spark, d), "high_impact", 18, 9).select("sha256", "seen_count")


@query(f"WITH {D.items_sql()}, q AS (SELECT *, row_number() OVER (ORDER BY score DESC, {TIES}) - 1 AS p, count(*) OVER () AS n FROM items WHERE label = 'negative' AND score IS NOT NULL) SELECT sha256, score, p::BIGINT AS position, n::BIGINT AS total FROM q WHERE p = least(1000000, n - 1)")
def queue_item_clamped(spark, d):
    return review.item_at(D.items(spark, d), "hard_negatives", 1_000_000).select("sha256", "score", F.col("position").cast("long").alias("position"), "total")


@query(f"WITH {D.items_sql()}, q AS (SELECT *, row_number() OVER (ORDER BY seen_count DESC, {TIES}) AS place, count(*) OVER () AS total FROM items) SELECT place, total, sha256 FROM q WHERE place <= 25")
def queue_grid(spark, d):
    """A grid's first 25 items, in their places, with the queue's total."""
    total, rows = review.grid(review.queue(D.items(spark, d), "high_impact"), 25)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*review._order("high_impact"))).cast("long")).select("place", F.lit(total).cast("long").alias("total"), "sha256")


@query("SELECT doc_id, CASE WHEN (doc_id * 7919 % 1000) / 1000.0::DOUBLE >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted FROM documents")
def predicted_labels(spark, d):
    """A score at the threshold is positive."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i, labels.predicted_label(i * 7919 % 1000 / 1000.0, 0.5).alias("predicted"))


@query("""WITH f AS (SELECT doc_id, 'cache/' || doc_id AS path, n_chars AS file_size, sha256(coalesce(text, '')) AS raw_sha FROM documents)
    SELECT path, file_size + (doc_id % 4 = 0)::INT AS file_size, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE raw_sha END AS raw_sha FROM f WHERE doc_id % 4 = 0 OR doc_id % 5 <> 0""")
def fingerprint_upsert(spark, d):
    """A cache of fingerprints after every fourth file has been read again: known ones are replaced, new ones added."""
    i = F.col("doc_id")
    files = table(spark, d, "documents").select(i, F.concat(F.lit("cache/"), i.cast("string")).alias("path"), F.col("n_chars").alias("file_size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw_sha"))
    known = conform(files.filter(i % 5 != 0), FINGERPRINTS)
    again = conform(files.filter(i % 4 == 0).withColumn("file_size", F.col("file_size") + 1).withColumn("raw_sha", F.lit("changed")), FINGERPRINTS)
    return catalog.upsert(known, again, ["path"]).select("path", "file_size", "raw_sha")


def _index(spark, d, name):
    return review.queue_index(D.items(spark, d), name, f"{shared_folder(spark)}/curatrix/index-{uuid.uuid4().hex}")


@query(f"WITH {D.items_sql()}, q AS (SELECT *, row_number() OVER (ORDER BY seen_count DESC, {TIES}) - 1 AS p FROM items) SELECT sha256, seen_count, p::BIGINT AS position FROM q WHERE p BETWEEN 40 AND 48")
def queue_page_indexed(spark, d):
    """From the stored order: only the ranges that hold the page are read."""
    return _index(spark, d, "high_impact").page(40, 9).select("sha256", "seen_count", "position")


@query(f"WITH {D.items_sql()}, q AS (SELECT *, row_number() OVER (ORDER BY score DESC, {TIES}) - 1 AS p, count(*) OVER () AS n FROM items WHERE label = 'negative' AND score IS NOT NULL) SELECT sha256, score, p::BIGINT AS position, n::BIGINT AS total FROM q WHERE p = least(1000000, n - 1)")
def queue_item_indexed(spark, d):
    return _index(spark, d, "hard_negatives").item(1_000_000).select("sha256", "score", "position", "total")


@query(f"WITH {D.items_sql()} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (WHERE {w}) AS queue_{q}' for q, (w, _) in QUEUE_SQL.items())}, count(*) FILTER (WHERE label_source = 'manual' AND label = 'positive') AS label_positive, count(*) FILTER (WHERE label_source = 'manual' AND label = 'negative') AS label_negative, count(*) FILTER (WHERE label_source = 'manual' AND label = 'unclear') AS label_unclear FROM items")
def review_summary(spark, d):
    return review.summary(D.items(spark, d))


@query(f"WITH {D.items_sql()} SELECT unnest({list(QUEUE_SQL)}) AS queue, unnest([{', '.join(f'count(*) FILTER (WHERE {w})' for w, _ in QUEUE_SQL.values())}]) AS items FROM items")
def queue_counts(spark, d):
    return review.queue_counts(D.items(spark, d))


@query(f"WITH {D.items_sql()}, c AS (SELECT unnest({list(QUEUE_SQL)}) AS queue, unnest([{', '.join(f'count(*) FILTER (WHERE {w})' for w, _ in QUEUE_SQL.values())}]) AS n FROM items) SELECT arg_min(queue, list_position({list(review.PREFERRED)}, queue)) AS queue FROM c WHERE n > 0 AND list_contains({list(review.PREFERRED)}, queue)")
def preferred_queue(spark, d):
    return review.preferred_queue(D.items(spark, d))


@query(f"WITH {D.IMAGES} SELECT l.label, count(i.sha256) AS items FROM (SELECT unnest(['positive', 'negative', 'unclear']) AS label) l LEFT JOIN images i ON i.label = l.label AND i.label_source = 'manual' GROUP BY l.label")
def label_counts(spark, d):
    return review.label_counts(D.items(spark, d))


@query(f"WITH {D.IMAGES} SELECT coalesce(label, 'unlabeled') AS label, list_position(['unlabeled', 'positive', 'negative', 'unclear'], coalesce(label, 'unlabeled'))::BIGINT AS rank, count(*) AS items FROM images GROUP BY 1, 2")
def grid_groups(spark, d):
    return review.grid_groups(D.items(spark, d))


@query(f"WITH {D.SCORES} SELECT row_number() OVER (ORDER BY latest DESC, run_id DESC) AS place, run_id, {_stamp('latest')} FROM (SELECT run_id, max(created_at) AS latest FROM scores GROUP BY run_id)")
def run_list(spark, d):
    return placed(review.runs(D.scores(spark, d)), review.run_order()).select("place", "run_id", D.said("latest").alias("latest"))


@query("SELECT o_orderpriority AS run_id, min(o_orderkey) AS position FROM orders GROUP BY 1")
def run_dedupe(spark, d):
    from curatrix.shared import table

    return review.dedupe_runs(table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("run_id")))


@query(f"WITH {D.items_sql()} SELECT sha256, coalesce(label, predicted_label, 'negative') AS proposed FROM items")
def initial_labels(spark, d):
    return D.items(spark, d).select("sha256", review.batch_label(F.col("label"), F.col("predicted_label")).alias("proposed"))


IMAGE_NOW = f"sha256, label, label_source, {_stamp('labeled_at')}, review_notes, {_stamp('updated_at')}"


def _images(df):
    return df.select("sha256", "label", "label_source", D.said("labeled_at").alias("labeled_at"), "review_notes", D.said("updated_at").alias("updated_at"))


@query(f"""WITH {D.IMAGES}, {D.SCORES}, r AS (SELECT i.*, s.score, s.predicted_label AS p, label IS NULL OR label_source = 'model' AS ours FROM images i LEFT JOIN (SELECT * FROM scores WHERE run_id = 'run-b') s ON s.image_sha256 = i.sha256),
    n AS (SELECT sha256, CASE WHEN ours THEN p ELSE label END AS label, CASE WHEN ours THEN CASE WHEN p IS NOT NULL THEN 'model' END ELSE label_source END AS label_source, CASE WHEN ours THEN CASE WHEN p IS NOT NULL THEN TIMESTAMP '{D.NOW}' END ELSE labeled_at END AS labeled_at,
    CASE WHEN ours AND p IS NOT NULL THEN p || '/' || score::VARCHAR END AS review_notes, CASE WHEN ours AND (p IS NOT NULL OR label_source = 'model') THEN TIMESTAMP '{D.NOW}' ELSE updated_at END AS updated_at FROM r) SELECT {IMAGE_NOW} FROM n""")
def relabel_model(spark, d):
    now = labels.refresh_model_labels(D.images(spark, d), D.scores(spark, d), "run-b", D.at(D.NOW))
    note = F.concat_ws("/", F.get_json_object("review_notes", "$.predicted_label"), F.get_json_object("review_notes", "$.score"))
    return _images(now.withColumn("review_notes", F.when(F.col("review_notes").isNotNull(), note)))


@query(f"WITH {D.IMAGES}, {D.SCORES} SELECT count(*) FILTER (WHERE predicted_label = 'positive') AS positive, count(*) FILTER (WHERE predicted_label = 'negative') AS negative, count(*) AS updated FROM images i JOIN scores s ON s.image_sha256 = i.sha256 AND run_id = 'run-b' WHERE label IS NULL OR label_source = 'model'")
def relabel_counts(spark, d):
    return labels.relabel_counts(D.images(spark, d), D.scores(spark, d), "run-b")


@query(f"WITH {D.SCORES} SELECT run_id, image_sha256, score FROM scores WHERE run_id = 'run-a' AND image_sha256 NOT IN (SELECT image_sha256 FROM scores WHERE run_id = 'run-b') UNION ALL SELECT 'run-a', image_sha256, score FROM scores WHERE run_id = 'run-b'")
def score_upsert(spark, d):
    old = D.scores(spark, d).filter("run_id = 'run-a'")
    new = D.scores(spark, d).filter("run_id = 'run-b'").withColumn("run_id", F.lit("run-a"))
    return catalog.upsert(old, new, ["run_id", "image_sha256"]).select("run_id", "image_sha256", "score")


REQUESTS = "requests AS (SELECT DISTINCT sha256(CAST(user_id AS VARCHAR)) AS s, last_value(CASE WHEN event_type = 'error' THEN 'unclear' WHEN event_type IN ('click', 'purchase') THEN 'positive' ELSE 'negative' END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events)"


def _requests(spark, d):
    events = D.label_events(spark, d)
    return events.select(F.col("image_sha256").alias("sha256"), F.col("new_label").alias("label"), F.lit("n").alias("notes"), F.col("id").alias("ord"))


def _start(spark, d):
    from curatrix.schemas import empty

    return D.images(spark, d), empty(spark, "label_events")


@query(f"WITH {D.IMAGES}, {REQUESTS} SELECT {IMAGE_NOW} FROM (SELECT sha256, coalesce(l, label) AS label, CASE WHEN l IS NOT NULL THEN 'manual' ELSE label_source END AS label_source, CASE WHEN l IS NOT NULL THEN TIMESTAMP '{D.NOW}' ELSE labeled_at END AS labeled_at, CASE WHEN l IS NOT NULL THEN 'n' ELSE review_notes END AS review_notes, CASE WHEN l IS NOT NULL THEN TIMESTAMP '{D.NOW}' ELSE updated_at END AS updated_at FROM images LEFT JOIN requests ON sha256 = s)")
def label_apply(spark, d):
    return _images(labels.apply_labels(*_start(spark, d), _requests(spark, d), D.at(D.NOW))[0])


@query(f"WITH {D.IMAGES}, {REQUESTS} SELECT sha256, label, label_source, {_stamp('labeled_at')}, review_notes FROM images")
def batch_undo(spark, d):
    """A batch and its undo leave labels as they were."""
    images, events = labels.apply_labels(*_start(spark, d), _requests(spark, d), D.at(D.NOW), batch_id="b1")
    return _images(labels.undo(images, events, D.at(D.NOW))[0]).drop("updated_at")


@query(f"WITH {D.LABEL_EVENTS} SELECT id, image_sha256, new_label, {_stamp('created_at')}, batch_id FROM label_events ORDER BY created_at DESC, id DESC LIMIT 200")
def recent_events(spark, d):
    return labels.recent_events(D.label_events(spark, d), 200).select("id", "image_sha256", "new_label", D.said("created_at").alias("created_at"), "batch_id")


@query(f"WITH {D.LABEL_EVENTS}, last AS (SELECT * FROM label_events ORDER BY created_at DESC, id DESC LIMIT 1) SELECT e.id, e.image_sha256 FROM label_events e, last WHERE CASE WHEN last.batch_id IS NOT NULL THEN e.batch_id = last.batch_id ELSE e.id = last.id END")
def undo_selection(spark, d):
    return labels.undone_events(D.label_events(spark, d)).select("id", "image_sha256")


@query(f"WITH {D.LABEL_EVENTS}, {D.items_sql()}, few AS (SELECT * FROM label_events ORDER BY created_at DESC, id DESC LIMIT 24) SELECT id, image_sha256, new_label, label AS current_label, predicted_label, score, seen_count FROM few LEFT JOIN items ON image_sha256 = sha256")
def label_history(spark, d):
    return labels.history(D.label_events(spark, d), D.items(spark, d)).select("id", "image_sha256", "new_label", "current_label", "predicted_label", "score", "seen_count")


@query(f"WITH {D.IMAGES}, {D.SCORES} SELECT 'model_scores' AS child, count(*) AS orphans FROM scores WHERE image_sha256 NOT IN (SELECT sha256 FROM images WHERE width % 7 <> 0)")
def reference_check(spark, d):
    """Some images are taken away first, so that scores are left without theirs."""
    return orphans(D.scores(spark, d), "image_sha256", D.images(spark, d).filter("width % 7 <> 0"), "sha256").agg(F.lit("model_scores").alias("child"), F.count("*").alias("orphans"))


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'raw/' ELSE 'in/' END || o_orderkey || '.json' AS p, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) SELECT 'in/' || o_orderkey || '.json' AS source_path FROM orders WHERE 'in/' || o_orderkey || '.json' NOT IN (SELECT p FROM f) AND 'raw/' || o_orderkey || '.json' NOT IN (SELECT p FROM f)""")
def new_exports(spark, d):
    from curatrix.shared import table

    k = F.col("o_orderkey").cast("string")
    path = lambda x: F.concat(F.lit(x), k, F.lit(".json"))
    orders = table(spark, d, "orders")
    ledger = orders.filter("o_orderkey % 3 <> 0").select(F.when(F.col("o_orderkey") % 2 == 0, path("raw/")).otherwise(path("in/")).alias("export_path"))
    return catalog.new_exports(orders.select(path("in/").alias("source_path"), path("raw/").alias("stored_path")), ledger).select("source_path")


@query(f"WITH {D.IMAGES} SELECT i.sha256, CASE WHEN n IS NOT NULL THEN 'dl/' || n ELSE local_path END AS local_path, label FROM images i LEFT JOIN (SELECT sha256(CAST(user_id AS VARCHAR)) AS s, max(event_id) AS n FROM events GROUP BY 1) x ON s = sha256")
def image_upsert(spark, d):
    """Downloads of known images: the last one's metadata wins, labels stay."""
    ev = D.label_events(spark, d)
    ids = F.col("id") - 1
    downloads = ev.select(F.col("image_sha256").alias("sha256"), F.concat(F.lit("dl/"), ids.cast("string")).alias("local_path"), F.lit("image/png").alias("mime_type"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(1).cast("long").alias("byte_size"), ids.alias("ord"))
    return catalog.record_images(D.images(spark, d), downloads, D.at(D.NOW)).select("sha256", "local_path", "label")


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')}, {D.AVATAR_URLS} SELECT sum(seen_count)::BIGINT AS total_sightings, count(*) AS unique_avatars FROM avatar_urls")
def sighting_totals(spark, d):
    return accounts.totals(D.avatar_urls(spark, d))


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')} SELECT row_number() OVER (ORDER BY seen_count DESC, normalized_url) AS place, {MERGED}, count(*) OVER () AS avatar_count, (sum(seen_count) OVER ())::BIGINT AS total_sightings FROM merged")
def export_payload(spark, d):
    """The export's rows in their order, and its header beside each."""
    merged = materialise(D.merged(spark, d), "merged")
    header = accounts.totals(merged).select(F.col("unique_avatars").alias("avatar_count"), "total_sightings")  # one row
    return _shown(accounts.export_rows(merged).crossJoin(F.broadcast(header)), "place", "avatar_count", "total_sightings")


@query("""SELECT event_id, CASE WHEN m = 'off' THEN 'show' WHEN m = 'debug' AND hit THEN 'mark' WHEN w OR NOT hit OR r THEN 'show' WHEN m IN ('hide', 'fade') THEN m ELSE 'show' END AS decision FROM (SELECT event_id, (['off', 'hide', 'fade', 'debug'])[event_id % 4 + 1] AS m, event_type = 'click' AS hit, user_id % 25 = 0 AS w, event_id % 9 = 0 AS r FROM events)""")
def mode_decisions(spark, d):
    from curatrix.shared import table

    e = F.col("event_id")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("off", "hide", "fade", "debug")]), (e % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", accounts.mode_decision(mode, F.col("event_type") == "click", F.col("user_id") % 25 == 0, e % 9 == 0).alias("decision"))


@query(f"WITH {D.IMAGES}, {D.SCORES} SELECT 'image/' || i.sha256 AS path FROM images i WHERE width % 7 <> 0 OR height % 2 <> 0")
def stale_fingerprints(spark, d):
    files = D.images(spark, d).select(F.concat(F.lit("image/"), "sha256").alias("path"), F.col("byte_size").alias("file_size"), F.col("width").cast("long").alias("mtime_ns"), F.lit(128).alias("image_size"), "height")
    cache = files.filter("mtime_ns % 7 = 0").withColumn("file_size", F.col("file_size") + F.col("height") % 2)
    return catalog.stale_fingerprints(files, cache).select("path")


@query("WITH r AS (SELECT p_partkey AS position, 'v0.' || p_partkey AS name, 'run-' || p_partkey AS run_id FROM part) SELECT * FROM r UNION ALL SELECT max(position) + 1, 'WIP', 'run-wip' FROM r")
def run_presets(spark, d):
    from curatrix.shared import table

    k = F.col("p_partkey")
    text = lambda x: F.concat(F.lit(x), k.cast("string"))
    releases = table(spark, d, "part").select(k.alias("position"), text("v0.").alias("name"), text("run-").alias("run_id"))
    return review.run_presets(releases, spark.createDataFrame([("run-wip",), ("run-3",)], "run_id string"))


@query(f"WITH {D.ROWS}, {D.merged_sql('merged')}, o AS (SELECT normalized_url, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'downloaded' END AS download_status, CASE WHEN user_id % 3 = 0 THEN 'status 404' END AS last_download_error, CASE WHEN user_id % 3 <> 0 THEN sha256(normalized_url) END AS image_sha256 FROM merged WHERE user_id % 2 = 0) SELECT m.normalized_url, coalesce(o.download_status, CASE WHEN user_id % 5 <> 0 THEN 'downloaded' WHEN user_id % 2 = 0 THEN 'failed' ELSE 'pending' END) AS download_status, o.last_download_error, coalesce(o.image_sha256, CASE WHEN user_id % 5 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END) AS image_sha256 FROM merged m LEFT JOIN o ON m.normalized_url = o.normalized_url")
def download_outcomes(spark, d):
    urls = D.avatar_urls(spark, d)
    user = F.split_part("normalized_url", F.lit("/"), F.lit(4)).cast("long")
    bad = user % 3 == 0
    outcomes = urls.filter(user % 2 == 0).select("normalized_url", F.when(~bad, F.sha2("normalized_url", 256)).alias("sha256"), F.when(bad, "status 404").alias("error"))
    outcomes = outcomes.unionByName(urls.filter(user % 4 == 0).select("normalized_url", F.lit(None).cast("string").alias("sha256"), F.lit("status 404").alias("error")))  # tried twice
    return catalog.record_outcomes(urls, outcomes, D.at(D.NOW)).select("normalized_url", "download_status", "last_download_error", "image_sha256")


@query("WITH l AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'raw/' ELSE 'in/' END || o_orderkey || '.json' AS p, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) SELECT 'raw/' || k || '.json' AS export_path FROM l")
def export_rename(spark, d):
    """Exports that were ingested from their source get the archive's path."""
    from curatrix.shared import table

    k = F.col("o_orderkey").cast("string")
    path = lambda x: F.concat(F.lit(x), k, F.lit(".json"))
    orders = table(spark, d, "orders")
    ledger = orders.filter("o_orderkey % 3 <> 0").select(F.when(F.col("o_orderkey") % 2 == 0, path("raw/")).otherwise(path("in/")).alias("export_path"))
    return catalog.rename_archived(ledger, orders.unionByName(orders.filter("o_orderkey % 4 = 0")).select(path("in/").alias("source_path"), path("raw/").alias("stored_path"))).select("export_path")
