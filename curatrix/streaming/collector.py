"""The collector as streams: each function takes a batch or a streaming frame of sightings and gives the same result.

Sightings: ts, normalized_url, original_url, handle, display_name, surface, whitelisted, profile_url, notification_url,
tweet_url, matched, score_source. State grows with the number of keys, as there is no expiry; give a watermark to bound it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix.streaming.deltas import write_delta


def _first(c: str):
    return F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ts")))


def _last(c: str):
    return F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ts")))


def _set(c: str):
    return F.array_sort(F.filter(F.collect_set(F.col(c)), lambda x: x != ""))


def with_watermark(events: DataFrame, delay: str | None) -> DataFrame:
    """Event times without a zone are UTC; a watermark only where a delay is given."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if delay else timed


def sightings_by_url(events: DataFrame) -> DataFrame:
    """One row a URL; an example is the first that is not empty, the original URL the last."""
    return events.groupBy("normalized_url").agg(
        _last("original_url").alias("original_url"), _set("handle").alias("handles"), _set("display_name").alias("display_names"), _set("surface").alias("source_surfaces"),
        F.count("*").alias("seen_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
        _first("profile_url").alias("example_profile_url"), _first("notification_url").alias("example_notification_url"), _first("tweet_url").alias("example_tweet_url"),
        F.coalesce(F.bool_or("whitelisted"), F.lit(False)).alias("whitelisted"),
    )


def matched_accounts(events: DataFrame) -> DataFrame:
    """Matches by handle, with the last name that is not null; whitelisted ones do not count."""
    hits = events.filter(F.col("matched") & ~F.coalesce(F.col("whitelisted"), F.lit(False)))
    return hits.groupBy("handle").agg(F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("ts"))).alias("display_name"), F.count("*").alias("posts_matched"), F.max("ts").alias("last_matched_at"))


def detection_stats(events: DataFrame) -> DataFrame:
    """The counters, over all events."""
    hit = F.col("matched") & ~F.coalesce(F.col("whitelisted"), F.lit(False))
    return events.groupBy().agg(
        F.count("*").alias("tweets_scanned"), F.count_if(F.col("normalized_url").isNotNull()).alias("avatars_checked"), F.count_if(F.col("score_source") == "cache").alias("cache_hits"),
        F.count_if(hit).alias("posts_matched"), F.count_if(hit & (F.col("score_source") == "model")).alias("model_matches"), F.count_if(F.col("score_source") == "error").alias("errors"),
        F.max(F.when(hit, F.col("ts"))).alias("last_match_at"),
    )


def memoised_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Events with the static table's score of their URL (normalized_url, score); a URL without one is an error."""
    known = scores.select("normalized_url", "score")
    return events.join(known, "normalized_url", "left").withColumn("score_error", F.col("score").isNull())


def cache_hits(events: DataFrame) -> DataFrame:
    """Of each URL all sightings but the first are hits."""
    return events.groupBy("normalized_url").agg((F.count("*") - 1).alias("hits"))


def notification_entries(events: DataFrame) -> DataFrame:
    """One entry for each handle and URL, the last; of the same time the one that is greatest in its other columns."""
    rest = [c for c in events.columns if c not in ("handle", "normalized_url", "ts")]
    last = events.groupBy("handle", "normalized_url").agg(F.max(F.struct("ts", *rest)).alias("__last"))
    return last.select("handle", "normalized_url", "__last.*").select(*events.columns)


def changed_elements(events: DataFrame) -> DataFrame:
    """Events (element, signature, ts) that change their element's signature, exactly and over batches: the last signature
    of an element is kept as state, and events of a batch go in the order of ts."""
    import pandas as pd

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        keep = []
        for s in rows["signature"]:
            keep.append(s != last)
            last = s
        state.update((last,))
        yield rows[keep][["element", "signature", "ts"]]

    return events.groupBy("element").applyInPandasWithState(step, "element string, signature string, ts timestamp", "last string", "append", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, in micro-batches, into a table in memory: for tests and small states."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def flush_to(df: DataFrame, path: str, checkpoint: str, interval: str = "350 milliseconds", mode: str = "complete") -> StreamingQuery:
    """A state's versions, one a micro-batch; a batch that is repeated after a failure writes its version again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch:012d}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(write).start()


def apply_settings(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Events of a batch with the settings (mode, whitelist_handles) that are given: one row, broadcast."""
    from curatrix.operators.accounts import mode_decision

    both = events.crossJoin(F.broadcast(settings.limit(1)))
    listed = F.array_contains("whitelist_handles", F.col("handle"))
    return both.withColumn("decision", mode_decision(F.col("mode"), F.col("matched"), listed, F.lit(False)))


def decide(events: DataFrame, read_settings: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch with the settings that are read when it comes, so a change takes effect with the next one."""

    def run(batch: DataFrame, epoch: int) -> None:
        write(apply_settings(batch, read_settings()), epoch)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def keep_latest(changed: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """A keyed table from a stream in update mode: a micro-batch writes the keys that it has changed, and no others; read it with
    deltas.read_latest."""
    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, epoch: write_delta(batch, epoch, path, keys)).start()
