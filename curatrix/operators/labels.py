"""Labels, batches, undo and the model's own labels as state transitions: each returns the next images and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import known_label
from curatrix.schemas import LABELS, MANUAL, MODEL
from curatrix.shared import placed


def predicted_label(score: Column, threshold: float | Column) -> Column:
    return F.when(score >= threshold, F.lit("positive")).otherwise(F.lit("negative"))


def relabel_candidates(images: DataFrame, scores: DataFrame, run_id: str) -> DataFrame:
    """Images without a label or with the model's, that the run has scored."""
    run = scores.filter(F.col("run_id") == run_id).select(F.col("image_sha256").alias("sha256"), "score", "predicted_label")
    return images.filter(F.col("label").isNull() | (F.col("label_source") == MODEL)).join(run, "sha256")


def model_note(run_id: str, score: Column, label: Column) -> Column:
    """JSON with its keys in order."""
    return F.to_json(F.struct(label.alias("predicted_label"), F.lit(run_id).alias("run_id"), score.alias("score"), F.lit("model_label").alias("type")))


def refresh_model_labels(images: DataFrame, scores: DataFrame, run_id: str, now: Column) -> DataFrame:
    """All labels of the model are cleared, and what the run predicts is set where no label by hand stands."""
    run = scores.filter(F.col("run_id") == run_id).select(F.col("image_sha256").alias("__sha"), F.col("score").alias("__score"), F.col("predicted_label").alias("__label"))
    both = images.join(run, F.col("sha256") == F.col("__sha"), "left")
    ours = F.col("label").isNull() | (F.col("label_source") == MODEL)
    set_, clear = ours & F.col("__label").isNotNull(), F.col("label_source").eqNullSafe(F.lit(MODEL))
    put = lambda c, new: F.when(set_, new).when(clear, F.lit(None)).otherwise(F.col(c)).alias(c)
    new = {"label": F.col("__label"), "label_source": F.lit(MODEL), "labeled_at": now, "review_notes": model_note(run_id, F.col("__score"), F.col("__label"))}
    touched = F.when(set_ | clear, now).otherwise(F.col("updated_at")).alias("updated_at")
    return both.select(*[put(c, new[c]) if c in new else touched if c == "updated_at" else F.col(c) for c in images.columns])


def relabel_counts(images: DataFrame, scores: DataFrame, run_id: str) -> DataFrame:
    of = lambda v: F.coalesce(F.sum(F.when(F.col("predicted_label") == v, 1).otherwise(0)), F.lit(0)).cast("long")
    return relabel_candidates(images, scores, run_id).agg(of("positive").alias("positive"), of("negative").alias("negative"), F.count("*").alias("updated"))


def apply_labels(images: DataFrame, events: DataFrame, requests: DataFrame, now: Column, batch_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply requests (sha256, label, notes, ord) by hand, in order: the next images and events.

    A request that changes nothing is none: label, source and note equal, or in a batch label and source alone; batches
    set no notes. An unknown image or label fails before anything is returned. Of an image several requests apply one
    after the other, so each logs what the one before it left.
    """
    notes = F.lit(None).cast("string") if batch_id else F.col("notes")
    asked = requests.select(F.col("sha256").alias("__sha"), F.col("label").alias("__label"), notes.alias("__notes"), F.col("ord").alias("__ord"))
    unknown = asked.filter(known_label(F.col("__label")).isNull()).limit(5).collect()
    unknown += asked.join(images.select("sha256"), F.col("__sha") == F.col("sha256"), "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown image or label: {[tuple(r)[:2] for r in unknown]}; labels are {LABELS}")
    state = F.struct("label", "label_source", "review_notes", "labeled_at")
    joined = asked.join(images.select("sha256", state.alias("__state")), F.col("__sha") == F.col("sha256"))
    order = Window.partitionBy("__sha").orderBy("__ord")
    before = F.lag(F.struct(F.col("__label").alias("label"), F.lit(MANUAL).alias("label_source"), F.col("__notes").alias("review_notes"), now.alias("labeled_at"))).over(order)
    joined = joined.withColumn("__before", F.coalesce(before, F.col("__state")))
    same = F.col("__before.label").eqNullSafe(F.col("__label")) & F.col("__before.label_source").eqNullSafe(F.lit(MANUAL))
    if not batch_id:
        same = same & F.col("__before.review_notes").eqNullSafe(F.col("__notes"))
    # What a request that changes nothing leaves is what it found, with its time and notes.
    moved = F.coalesce(F.max((~same).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    kept = F.struct(F.col("__before.label"), F.col("__before.label_source"), F.col("__state.review_notes"), F.col("__state.labeled_at"))
    done = joined.withColumn("__same", same).withColumn("__before", F.when(moved, F.col("__before")).otherwise(kept)).filter(~F.col("__same"))
    next_id = (events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) if events is not None else 0
    logged = placed(done, [F.col("__ord"), F.col("__sha")], "__number").select(
        (F.col("__number") + F.lit(next_id)).alias("id"), F.col("__sha").alias("image_sha256"), F.col("__before.label").alias("previous_label"), F.col("__before.label_source").alias("previous_label_source"),
        F.col("__before.labeled_at").alias("previous_labeled_at"), F.col("__before.review_notes").alias("previous_review_notes"), F.col("__label").alias("new_label"),
        F.col("__notes").alias("new_review_notes"), now.alias("created_at"), F.lit(batch_id).cast("string").alias("batch_id"),
    )
    last = done.groupBy("__sha").agg(F.max_by(F.struct("__label", "__notes"), "__ord").alias("__last"))
    both = images.join(last, F.col("sha256") == F.col("__sha"), "left")
    hit = F.col("__last").isNotNull()
    new = {"label": F.col("__last.__label"), "label_source": F.lit(MANUAL), "labeled_at": now, "review_notes": F.col("__last.__notes"), "updated_at": now}
    images_now = both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in images.columns])
    return images_now, events.unionByName(logged.select(*events.columns))


def undone_events(events: DataFrame) -> DataFrame:
    """What an undo takes back: the latest event, or all of its batch."""
    last = events.orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(F.col("id").alias("__id"), F.col("batch_id").alias("__batch"))
    return events.join(F.broadcast(last), F.when(F.col("__batch").isNotNull(), F.col("batch_id") == F.col("__batch")).otherwise(F.col("id") == F.col("__id"))).drop("__id", "__batch")


def undo(images: DataFrame, events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The images and events before the latest event or batch; of an image the oldest previous values count."""
    taken = undone_events(events)
    if taken.isEmpty():
        raise LookupError("nothing to undo")
    back = F.struct(*[F.col(f"previous_{c}").alias(c) for c in ("label", "label_source", "labeled_at", "review_notes")])
    oldest = taken.groupBy("image_sha256").agg(F.min_by(back, "id").alias("__back"))
    both = images.join(oldest, F.col("sha256") == F.col("image_sha256"), "left")
    hit = F.col("__back").isNotNull()
    restored = ("label", "label_source", "labeled_at", "review_notes")
    images_now = both.select(*[F.when(hit, F.col(f"__back.{c}")).otherwise(F.col(c)).alias(c) if c in restored else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in images.columns])
    return images_now, events.join(taken.select(F.col("id").alias("__gone")), F.col("id") == F.col("__gone"), "left_anti")


def recent_events(events: DataFrame, limit: int = 24) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def history(events: DataFrame, items: DataFrame, limit: int = 24) -> DataFrame:
    """The latest events with the items they are about; the events are few before the join."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    few = recent_events(events, limit)
    about = items.select(F.col("sha256").alias("image_sha256"), F.col("label").alias("current_label"), "predicted_label", "score", "seen_count")
    return few.join(about, "image_sha256", "left").orderBy(F.desc("created_at"), F.desc("id"))
