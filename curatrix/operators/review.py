"""Review items, ranked queues and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import no_strings
from curatrix.operators.rank_index import RankIndex
from curatrix.schemas import LABELS, MANUAL
from curatrix.shared import small

QUEUES = ("needs_review", "model_disagreements", "exempted", "high_impact", "notifications", "boundary_review", "model_backlog", "hard_negatives")
#: The queue to open is the first of these that has items.
PREFERRED = ("hard_negatives", "model_disagreements", "boundary_review", "notifications", "high_impact", "needs_review", "model_backlog", "exempted")
NOTIFICATION_SURFACE = "notification-group"


def url_rollup(avatar_urls: DataFrame) -> DataFrame:
    """One row for each image_sha256 with what its URLs add up to; firsts go by (created_at, normalized_url)."""
    k = F.struct("created_at", "normalized_url")
    union = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce(F.col(c), no_strings()))), lambda x: x != "")))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", k))
    return avatar_urls.filter("image_sha256 is not null").groupBy(F.col("image_sha256").alias("sha256")).agg(
        union("handles").alias("handles"), union("display_names").alias("display_names"), union("source_surfaces").alias("source_surfaces"),
        F.sum("seen_count").cast("long").alias("seen_count"), F.coalesce(F.bool_or("whitelisted"), F.lit(False)).alias("whitelisted"),
        first("example_profile_url").alias("example_profile_url"), first("example_notification_url").alias("example_notification_url"), first("example_tweet_url").alias("example_tweet_url"),
        F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("url_count"),
    )


def latest_scores(scores: DataFrame) -> DataFrame:
    """Each image's scores of its latest time; ties stay."""
    last = F.max("created_at").over(Window.partitionBy("image_sha256"))
    return scores.withColumn("__last", last).filter(F.col("created_at") == F.col("__last")).drop("__last")


def distance(score: Column, threshold: Column) -> Column:
    return F.abs(score - threshold)


def flags(label: Column, predicted: Column) -> Column:
    """human_vs_model where a label of any source, but unclear, differs from the prediction."""
    return F.when(label.isNotNull() & (label != "unclear") & predicted.isNotNull() & (label != predicted), F.array(F.lit("human_vs_model"))).otherwise(no_strings())


def review_items(images: DataFrame, scores: DataFrame, avatar_urls: DataFrame, thresholds: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row for each image, and for each of tied latest scores if no run is given. Images without a score or URLs stay.

    The run's scores are picked before the join; thresholds (run_id, threshold), one row a run, are matched by run.
    """
    picked = scores.filter(F.col("run_id") == run_id) if run_id is not None else latest_scores(scores)
    picked = picked.select(F.col("image_sha256").alias("sha256"), "run_id", "score", "predicted_label")
    # All rows have one of a few runs, so these must not be shuffled by run.
    known = small(thresholds.select("run_id", "threshold"))
    joined = images.join(picked, "sha256", "left").join(url_rollup(avatar_urls), "sha256", "left").join(known, "run_id", "left")
    empty, none = F.lit(0).cast("long"), F.lit(None)
    return joined.select(
        "sha256", "local_path", "width", "height", "label", "label_source", "labeled_at", "review_notes", "updated_at",
        *[F.coalesce(c, no_strings()).alias(c) for c in ("handles", "display_names", "source_surfaces")],
        F.coalesce("seen_count", empty).alias("seen_count"), F.coalesce("url_count", empty).alias("url_count"), F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"),
        "example_profile_url", "example_notification_url", "example_tweet_url", "last_seen_at", "run_id", "score", "predicted_label", "threshold",
        F.coalesce(distance(F.col("score"), F.col("threshold")), none).alias("distance"), flags(F.col("label"), F.col("predicted_label")).alias("flags"),
    )


def needs_review() -> Column:
    """Not labelled by hand; without any label counts too."""
    return ~F.col("label_source").eqNullSafe(F.lit(MANUAL))




def _order(name: str) -> list[Column]:
    score, seen = F.desc(F.coalesce("score", F.lit(-1.0))), F.desc("seen_count")
    by = {
        "needs_review": [seen, F.desc_nulls_last("last_seen_at"), score],
        "model_disagreements": [score, seen, F.desc_nulls_last("labeled_at")],
        "exempted": [seen],
        "high_impact": [seen],
        "notifications": [seen],
        "boundary_review": [F.asc("distance"), seen],
        "model_backlog": [F.desc("score")],
        "hard_negatives": [F.desc("score")],
        "labeled": [F.desc(F.size("flags")), score, seen, F.desc_nulls_last("labeled_at")],
    }[name]
    return [*by, F.desc_nulls_last("updated_at"), F.asc("sha256"), F.asc_nulls_first("run_id")]


def queue_filter(name: str) -> Column:
    known = {
        "needs_review": needs_review(),
        "model_disagreements": F.array_contains("flags", "human_vs_model"),
        "exempted": F.col("whitelisted"),
        "high_impact": F.lit(True),
        "notifications": F.array_contains("source_surfaces", NOTIFICATION_SURFACE),
        "boundary_review": needs_review() & F.col("score").isNotNull() & F.col("threshold").isNotNull() & F.col("distance").isNotNull(),
        "model_backlog": needs_review() & F.col("score").isNotNull(),
        "hard_negatives": (F.col("label") == "negative") & F.col("score").isNotNull(),
    }
    if name not in known:
        raise ValueError(f"unknown queue: {name}")
    return known[name]


def queue(items: DataFrame, name: str) -> DataFrame:
    """A queue's items in its order, which is total."""
    return items.filter(queue_filter(name)).orderBy(*_order(name))


def queue_index(items: DataFrame, name: str, path: str) -> RankIndex:
    """A queue's order stored under path, for many items and pages of the same state."""
    return RankIndex.write(items.filter(queue_filter(name)), _order(name), path)


def labeled_grid(items: DataFrame, label: str = "all") -> DataFrame:
    if label not in ("all", *LABELS):
        raise ValueError(f"unknown label filter: {label}")
    found = items.filter(F.col("label").isNotNull())
    return (found if label == "all" else found.filter(F.col("label") == label)).orderBy(*_order("labeled"))


def queue_counts(items: DataFrame) -> DataFrame:
    """(queue, items) of all queues, in one pass."""
    sums = items.agg(*[F.coalesce(F.sum(F.when(queue_filter(q), 1).otherwise(0)), F.lit(0)).cast("long").alias(q) for q in QUEUES])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(q).alias("queue"), F.col(q).alias("items")) for q in QUEUES])).alias("x")).select("x.queue", "x.items")


def preferred_queue(items: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(q) for q in PREFERRED]), F.col("queue"))
    return queue_counts(items).filter("items > 0").agg(F.min_by("queue", rank).alias("queue"))


def item_at(items: DataFrame, name: str, index: int) -> DataFrame:
    """The item at index, or the last one, with position and total; nothing if the queue is empty. Only index + 1 rows are
    sorted to the front."""
    total = items.filter(queue_filter(name)).count()
    if not total:
        return queue(items, name).limit(0).withColumn("position", F.lit(0)).withColumn("total", F.lit(0).cast("long"))
    at = max(0, min(index, total - 1))
    return queue(items, name).offset(at).limit(1).withColumn("position", F.lit(at)).withColumn("total", F.lit(total).cast("long"))


def page(items: DataFrame, name: str, offset: int = 0, limit: int = 9) -> DataFrame:
    """limit items (1 to 25) from offset on, which is moved to the last item if it is past it."""
    if not 1 <= limit <= 25:
        raise ValueError("limit must be from 1 to 25")
    total = items.filter(queue_filter(name)).count()
    return queue(items, name).offset(max(0, min(offset, total - 1))).limit(limit)


def grid(ordered: DataFrame, limit: int | None = None) -> tuple[int, DataFrame]:
    return ordered.count(), ordered if limit is None else ordered.limit(limit)


def item(items: DataFrame, sha256: str) -> DataFrame:
    found = items.filter(F.col("sha256") == sha256)
    if found.isEmpty():
        raise KeyError(sha256)
    return found


def label_counts(items: DataFrame) -> DataFrame:
    """Items by label among those labelled by hand, all labels present."""
    counted = items.filter(F.col("label_source") == MANUAL).groupBy("label").agg(F.count("*").alias("items"))
    domain = items.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return domain.join(counted, "label", "left").na.fill(0)


def summary(items: DataFrame) -> DataFrame:
    """One row: total, needs_review, every queue's items, every label's items by hand."""
    of = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    by_hand = F.col("label_source") == MANUAL
    return items.agg(F.count("*").alias("total"), *[of(queue_filter(q)).alias(f"queue_{q}") for q in QUEUES], *[of(by_hand & (F.col("label") == x)).alias(f"label_{x}") for x in LABELS])


def grid_groups(items: DataFrame) -> DataFrame:
    """Items by label, unlabeled first; labels without items are left out."""
    order = ["unlabeled", *LABELS]
    label = F.coalesce("label", F.lit("unlabeled"))
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    return items.groupBy(label.alias("label"), rank.alias("rank")).agg(F.count("*").alias("items")).orderBy("rank").select("label", "rank", "items")


def run_order() -> list[Column]:
    return [F.desc("latest"), F.desc("run_id")]


def runs(scores: DataFrame) -> DataFrame:
    """Runs by their latest score, newest first."""
    return scores.groupBy("run_id").agg(F.max("created_at").alias("latest")).orderBy(*run_order())


def dedupe_runs(selected: DataFrame) -> DataFrame:
    """(position, run_id) without repetitions, in the order they were given."""
    return selected.groupBy("run_id").agg(F.min("position").alias("position")).orderBy("position")


def batch_label(label: Column, predicted: Column) -> Column:
    """What a batch proposes: the label, else the prediction, else negative."""
    return F.coalesce(label, predicted, F.lit("negative"))


def numbered(ordered_by: list[Column], name: str = "number") -> Column:
    return F.row_number().over(Window.orderBy(*ordered_by)).alias(name)


def run_presets(releases: DataFrame, work_in_progress: DataFrame | None = None) -> DataFrame:
    """Releases (position, name, run_id) in their order, and after them a run that is not released yet."""
    if work_in_progress is None:
        return releases.orderBy("position")
    known = releases.select("run_id")
    last = F.broadcast(releases.agg(F.max("position").alias("__last")))
    extra = work_in_progress.join(known, "run_id", "left_anti").crossJoin(last).select((F.col("__last") + 1).alias("position"), F.lit("WIP").alias("name"), "run_id")
    return releases.unionByName(extra).orderBy("position")
