"""Keyed state with timers, memory of reveals, and requests that wait for answers."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curatrix.streaming import collector, requests
from curatrix.streaming import state as keyed

EVENT = "ts timestamp, normalized_url string, original_url string, handle string, display_name string, surface string, whitelisted boolean, matched boolean, profile_url string, notification_url string, tweet_url string, score_source string"
T0 = datetime(2024, 1, 1)


def sighting(i, url, handle, matched=True, **more):
    e = {"ts": T0 + timedelta(seconds=i), "normalized_url": url, "original_url": f"{url}?{i}", "handle": handle, "display_name": f"N{i}", "surface": "tweet", "whitelisted": False, "matched": matched, "profile_url": "", "notification_url": None, "tweet_url": f"t{i}", "score_source": "model"} | more
    return tuple(e.values())


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


ROWS = [sighting(0, "u1", "a"), sighting(1, "u1", "b", False, surface=""), sighting(2, None, None), sighting(3, "u2", "a", whitelisted=True, display_name=None)]
LATER = [sighting(4, "u1", "a", display_name=None, tweet_url="earlier", score_source="cache"), sighting(-5, "u1", "a", tweet_url="first"), sighting(5, "u3", "c", None, score_source="error")]


def test_state_is_that_of_a_batch_and_grows_with_keys(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, ROWS)
    arrive(spark, source, LATER)
    for _ in range(3):  # the same keys again
        arrive(spark, source, [sighting(9, "u1", "a")])
    query = keyed.flush(keyed.maps(stream(spark, source), None, 1), out, str(tmp_path / "ck"), compact=2)
    query.awaitTermination()
    batch = spark.read.schema(EVENT).parquet(source)
    names = ["normalized_url", "original_url", "handles", "display_names", "source_surfaces", "seen_count", "first_seen_at", "last_seen_at", "example_tweet_url", "whitelisted"]
    state = keyed.read_maps(spark, out)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(keyed.avatars(state).select(names)) == rows(collector.sightings_by_url(batch.filter("normalized_url is not null")).select(names))
    assert rows(keyed.accounts(state)) == rows(collector.matched_accounts(batch.filter("handle is not null")).select("handle", "display_name", "posts_matched", "last_matched_at"))
    stats = collector.detection_stats(batch).first().asDict()
    assert keyed.stats(state).first().asDict() == {k: stats[k] for k in keyed.stats(state).columns}
    totals = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
    assert totals[-1] == totals[2] > totals[1]  # one new name, and then two more batches and no more state
    # Five deltas, of which two bases were made: the newest base and what came after it are left.
    assert sorted(p.name for p in (tmp_path / "out" / "base").iterdir() if p.is_dir()) == [f"epoch={3:012d}"]
    assert sorted(p.name for p in (tmp_path / "out" / "delta").iterdir() if p.is_dir()) == [f"epoch={4:012d}"]


def test_all_maps_are_written_together_after_a_pause(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, ROWS)
    query = keyed.flush(keyed.maps(stream(spark, source), 3000, 1), out, str(tmp_path / "ck"), "200 milliseconds", compact=1000)
    try:
        written = lambda: [d for d in (spark.read.schema(keyed.OUT_DDL).parquet(str(p)).collect() for p in sorted((tmp_path / "out" / "delta").glob("epoch=*")) if (p / "_SUCCESS").exists()) if d]

        def after(n, seconds=90):
            end = time.time() + seconds
            while len(written()) < n and time.time() < end:
                assert query.exception() is None
                time.sleep(0.5)
            return written()

        first = after(1)
        assert len(first) == 1 and {(r.kind, r.key) for r in first[0]} == {("avatar", "u1"), ("avatar", "u2"), ("account", "a"), ("stats", "0")}
        assert next(r for r in first[0] if r.key == "u1").seen_count == 2
        arrive(spark, source, [sighting(7, "u2", "z", False)])
        second = after(2)
        assert {(r.kind, r.key) for r in second[1]} == {("avatar", "u2"), ("stats", "0")}  # what has not changed is not written
    finally:
        query.stop()
    assert keyed.stats(keyed.read_maps(spark, out)).first().tweets_scanned == 5


def test_reveals_are_remembered_until_a_post_does_not_match(spark, tmp_path):
    kind = "element string, event_id long, ts timestamp, normalized_url string, matched boolean, reveal boolean"
    rows = [("e", 0, "u", True, False), ("e", 1, "u", True, True), ("e", 2, "u", True, False), ("f", 3, "u", True, False), ("e", 4, "v", True, False), ("e", 5, "u", True, False), ("e", 6, "w", False, False), ("e", 7, "u", True, False)]
    frame = spark.createDataFrame([(e, i, T0 + timedelta(seconds=i), u, m, r) for e, i, u, m, r in rows], kind)
    for low in (0, 4):
        frame.filter(F.col("event_id").between(low, low + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    posts = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keyed.with_state_store(spark, lambda: keyed.reveals(posts).writeStream.format("memory").queryName("reveals").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    assert {r.event_id: r.revealed for r in spark.table("reveals").collect()} == {0: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != keyed.PROVIDER


def test_requests_have_one_outcome_each(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    asked = spark.createDataFrame([(i, at(0), f"u{i}") for i in range(6)], "id long, asked_at timestamp, url string")
    answers = [(0, at(60), 0.5, None), (1, at(61), 0.5, None), (2, at(5), None, "bad picture"), (3, at(5), None, None), (4, at(9), 0.9, None), (4, at(8), 0.1, None), (9, at(1), 0.3, None), (3, at(6), 0.7, None)]
    got = requests.outcomes(asked, spark.createDataFrame(answers, "id long, answered_at timestamp, score double, error string"))
    assert {r.id: (r.score, r.error) for r in got.collect()} == {0: (0.5, None), 1: (None, requests.TIMED_OUT), 2: (None, "bad picture"), 3: (None, requests.NO_SCORE), 4: (0.1, None), 5: (None, requests.TIMED_OUT)}
    assert got.columns == ["id", "asked_at", "url", "answered_at", "score", "error"]


class Counted:
    """State of one key in memory, and how often it is asked: facts and due as values, seen as a map."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def _asked(self, out=None):
        self.calls += 1
        return out

    getValueState = getMapState = lambda self, *kind: self
    exists = lambda self: self._asked(self.value is not None)
    get = lambda self: self._asked(self.value)
    keys = lambda self: self._asked(iter(list(self.map)))
    update = lambda self, value: self._asked(setattr(self, "value", value))
    updateValue = lambda self, key, value: self._asked(self.map.__setitem__(key, value))
    containsKey = lambda self, key: self._asked(key in self.map)


def test_a_key_asks_its_state_as_often_whatever_its_names():
    """Some calls a batch and one for each new name, not for each that a batch says; a row without a time says no first or last."""
    from pyspark.sql import Row

    state = Counted()
    processor = keyed.Maps(None)
    processor.init(state)
    row = lambda i, at: Row(at=at, original_url=f"o{i}", handle=f"h{i}", display_name=f"n{i % 7}", surface="", profile_url=None, notification_url="", tweet_url=f"t{i}", whitelisted=i == 3, hit=False, has_url=True, score_source="model")
    for batch, new in ((range(40), 47), (range(20, 60), 20), (range(60), 0)):
        state.calls = 0
        (out,) = processor.handleInputRows(("avatar", "u"), (row(i, None if i == 0 else 1000 - i) for i in batch), None)
        assert state.calls <= 3 + new
    assert out["seen_count"] == 140 and out["handles"] == sorted(f"h{i}" for i in range(60)) and out["display_names"] == sorted(f"n{i}" for i in range(7)) and out["source_surfaces"] == []
    assert (out["first_at"], out["last_at"], out["original_url"], out["example_tweet_url"], out["example_profile_url"], out["whitelisted"]) == (941, 999, "o1", "t59", None, True)
