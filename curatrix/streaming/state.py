"""The collector's maps as keyed state with timers: what has changed is written together, a pause after the first change.

A sighting changes up to three maps: the avatar of its URL, the account of its handle if it matches, and the counters, which are
kept in SHARDS parts so that no key holds all rows. Facts are value state, and the different handles, names and surfaces of an
avatar are map state, so a new one does not rewrite the others. State is in RocksDB and grows with the keys, whatever the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from curatrix.streaming.deltas import COMPACT, read_latest, write_delta

AVATAR, ACCOUNT, STATS = "avatar", "account", "stats"
SHARDS = 64
#: Milliseconds from a change to the write of all that has changed by then.
PAUSE = 250
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LISTS = {"handles": "handle", "display_names": "display_name", "source_surfaces": "surface"}
#: Facts that are the first or last text that is not empty, each with its time.
FIRST = {"example_profile_url": "profile_url", "example_notification_url": "notification_url", "example_tweet_url": "tweet_url"}
LAST = {"original_url": "original_url", "display_name": "display_name"}
COUNTS = ("seen_count", "posts_matched", "tweets_scanned", "avatars_checked", "cache_hits", "model_matches", "errors")
TIMES = ("first_at", "last_at", "hit_at")
FACTS = [*COUNTS, *TIMES, *FIRST, *LAST, *[f"{c}_at" for c in (*FIRST, *LAST)], "whitelisted"]
KINDS = {c: "long" for c in (*COUNTS, *TIMES, *[f"{c}_at" for c in (*FIRST, *LAST)])} | {c: "string" for c in (*FIRST, *LAST)} | {"whitelisted": "boolean"}
FACTS_DDL = ", ".join(f"{c} {KINDS[c]}" for c in FACTS)
OUT = ["kind", "key", *COUNTS, *TIMES, *FIRST, *LAST, "whitelisted", *LISTS]
OUT_DDL = ", ".join(f"{c} {'array<string>' if c in LISTS else KINDS.get(c, 'string')}" for c in OUT)


def changes(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each map that a sighting changes: kind, key, at (microseconds), and what it says."""
    hit = F.coalesce(F.col("matched"), F.lit(False)) & ~F.coalesce(F.col("whitelisted"), F.lit(False))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    maps = F.array(
        F.when(F.col("normalized_url").isNotNull(), entry(AVATAR, F.col("normalized_url"))), F.when(hit & F.col("handle").isNotNull(), entry(ACCOUNT, F.col("handle"))), entry(STATS, F.pmod(F.xxhash64("ts", "normalized_url", "handle"), F.lit(shards)))
    )
    rows = events.select(
        F.explode(F.filter(maps, lambda m: m.isNotNull())).alias("m"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "original_url", "handle", "display_name", "surface", "profile_url", "notification_url", "tweet_url",
        F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"), hit.alias("hit"), F.col("normalized_url").isNotNull().alias("has_url"), "score_source",
    )
    return rows.select("m.kind", "m.key", *[c for c in rows.columns if c != "m"])


def _take(facts: dict, name: str, at: int | None, text: str | None, last: bool) -> None:
    """The first or last text that is not empty; of one time the smaller one for the first and the greater for the last."""
    if not text or at is None:
        return
    known = facts[f"{name}_at"]
    if known is None or ((at, text) > (known, facts[name]) if last else (at, text) < (known, facts[name])):
        facts[name], facts[f"{name}_at"] = text, at


def updated(kind: str, facts: dict, row: dict) -> None:
    """Add a row of a key to its facts."""

    def count(name: str, more: bool = True) -> None:
        facts[name] = (facts[name] or 0) + more

    def bound(name: str, f: Callable[[int, int], int]) -> None:
        if row["at"] is not None:
            facts[name] = row["at"] if facts[name] is None else f(facts[name], row["at"])

    if kind == AVATAR:
        count("seen_count")
        bound("first_at", min)
        bound("last_at", max)
        for name, column in FIRST.items():
            _take(facts, name, row["at"], row[column], False)
        _take(facts, "original_url", row["at"], row["original_url"], True)
        facts["whitelisted"] = bool(facts["whitelisted"] or row["whitelisted"])
        return
    count("posts_matched", row["hit"])
    if row["hit"]:
        bound("hit_at", max)
    if kind == ACCOUNT:
        _take(facts, "display_name", row["at"], row["display_name"], True)
    else:
        count("tweets_scanned")
        count("avatars_checked", row["has_url"])
        count("cache_hits", row["score_source"] == "cache")
        count("model_matches", row["hit"] and row["score_source"] == "model")
        count("errors", row["score_source"] == "error")


class Maps(StatefulProcessor):
    """Keeps a key's facts, and gives its row when its timer is due; without a pause with every batch that changes it. Timers
    lie on a grid of pauses, so that what changes within one is given together, of all three maps. A key asks its state once a
    batch for its facts and once for its names, and writes those that are new."""

    def __init__(self, pause: int | None):
        self.pause = pause

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", FACTS_DDL)
        self.seen = handle.getMapState("seen", "field string, value string", "at long")
        self.due = handle.getValueState("due", "at long")

    def _row(self, key: tuple, facts: dict, names: Iterable[tuple[str, str]]) -> Row:
        kind, name = key
        values = {c: facts.get(c) for c in OUT} | {"kind": kind, "key": name}
        if kind == AVATAR:
            values |= {c: sorted(v for f, v in names if f == c) for c in LISTS}
        return Row(*OUT)(*[values[c] for c in OUT])

    def _names(self) -> set[tuple[str, str]]:
        return {(k[0], k[1]) for k in self.seen.keys()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.facts.get()
        facts, names, said = dict(zip(FACTS, before)) if before else dict.fromkeys(FACTS), set(), set()
        avatar = key[0] == AVATAR
        for r in rows:
            row = r.asDict()
            updated(key[0], facts, row)
            if avatar:
                said.update((field, row[column]) for field, column in LISTS.items() if row[column])
        if avatar:
            names = self._names() if before else set()
            for new in sorted(said - names):
                self.seen.updateValue(new, (facts["last_at"],))
            names |= said
        self.facts.update(tuple(facts[c] for c in FACTS))
        if self.pause is None:
            yield self._row(key, facts, names)
        elif not self.due.exists():
            at = (timerValues.getCurrentProcessingTimeInMs() // self.pause + 2) * self.pause
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        yield self._row(key, dict(zip(FACTS, self.facts.get())), self._names() if key[0] == AVATAR else ())

    def close(self) -> None:
        pass


def maps(events: DataFrame, pause: int | None = PAUSE, shards: int = SHARDS) -> DataFrame:
    """The rows of all three maps that have changed, from a stream of sightings."""
    return changes(events, shards).groupBy("kind", "key").transformWithState(Maps(pause), OUT_DDL, "Update", "None" if pause is None else "ProcessingTime")


def with_state_store(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with its state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        return start()
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def flush(changed: DataFrame, path: str, checkpoint: str, interval: str | None = None, compact: int = COMPACT) -> StreamingQuery:
    """Write what has changed of all maps, one delta a micro-batch; without an interval what is there now, and stop."""

    def start() -> StreamingQuery:
        out = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: write_delta(batch, epoch, path, ["kind", "key"], compact))
        return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()

    return with_state_store(changed.sparkSession, start)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, OUT_DDL, ["kind", "key"])


def _time(c: str, name: str):
    return F.timestamp_micros(c).alias(name)


def avatars(state: DataFrame) -> DataFrame:
    return state.filter(F.col("kind") == AVATAR).select(F.col("key").alias("normalized_url"), "original_url", *LISTS, "seen_count", _time("first_at", "first_seen_at"), _time("last_at", "last_seen_at"), *FIRST, "whitelisted")


def accounts(state: DataFrame) -> DataFrame:
    return state.filter(F.col("kind") == ACCOUNT).select(F.col("key").alias("handle"), "display_name", "posts_matched", _time("hit_at", "last_matched_at"))


def stats(state: DataFrame) -> DataFrame:
    """One row: the counters of all shards."""
    names = ("tweets_scanned", "avatars_checked", "cache_hits", "posts_matched", "model_matches", "errors")
    return state.filter(F.col("kind") == STATS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.timestamp_micros(F.max("hit_at")).alias("last_match_at"))


class Reveals(StatefulProcessor):
    """Remembers of each element which URL was revealed, until it shows one that does not match."""

    def init(self, handle) -> None:
        self.revealed = handle.getValueState("revealed", "url string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        url = self.revealed.get()[0] if self.revealed.exists() else None
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e in events.itertuples(index=False):
            if e.reveal:
                url = e.normalized_url
                continue
            if not e.matched:
                url = None
            out.append((key[0], e.event_id, e.normalized_url, bool(e.matched), url is not None and url == e.normalized_url))
        if url is None:
            self.revealed.clear()
        else:
            self.revealed.update((url,))
        yield pd.DataFrame(out, columns=["element", "event_id", "normalized_url", "matched", "revealed"])

    def close(self) -> None:
        pass


def reveals(events: DataFrame) -> DataFrame:
    """Posts of a stream (element, event_id, ts, normalized_url, matched, reveal) with whether a person has revealed them: an event
    with reveal is the click, and gives no row. A batch's events of an element are taken in the order of ts."""
    return events.select("element", "event_id", "ts", "normalized_url", "matched", "reveal").groupBy("element").transformWithStateInPandas(Reveals(), "element string, event_id long, normalized_url string, matched boolean, revealed boolean", "Append", "None")
