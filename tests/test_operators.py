"""Edge cases of the operators, each against what its contract says."""

from __future__ import annotations

import itertools
import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.functions import image, text
from curatrix.operators import accounts, catalog, components, families, labels, metrics, model, review, samples, splits
from curatrix.schemas import AVATAR_URLS, IMAGES, LABEL_EVENTS, MODEL_SCORES, SAMPLES, conform, empty, ensure_column, schema
from curatrix.sources import fetch, manifests, sinks
from curatrix.streaming import collector, deltas



def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_url_and_handle_forms(spark):
    u = text.normalize_image_url
    got = one(spark, *[u(F.lit(x)) for x in ("https://a/b_normal.jpg?foo=bar", "https://a/b_BIGGER.PNG", "https://a/b_x96.png", "https://a/b_20x20.gif", "https://a/normal.jpg", "https://a/b_mini.jpg#f")])
    assert got == ["https://a/b_400x400.jpg", "https://a/b_400x400.PNG", "https://a/b_400x400.png", "https://a/b_400x400.gif", "https://a/normal.jpg", "https://a/b_mini.jpg#f"]
    assert one(spark, text.normalize_image_url_keeping_query(F.lit("https://a/b_normal.jpg?x"))) == ["https://a/b_normal.jpg?x"]
    assert one(spark, *[text.normalize_handle(F.lit(x)) for x in ("//@Name ", "  @@A", None, "/@/B")]) == ["name", "a", "", "/b"]


def test_list_and_time_functions(spark):
    assert one(spark, text.merge_lists(F.array(F.lit("b"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b")))) == [["a", "b"]]
    assert one(spark, text.decode_list(F.lit("")), text.decode_list(F.lit('["x"]')), text.encode_list(F.lit(None).cast("array<string>"))) == [[], ["x"], "[]"]
    times = [F.date_format(text.parse_time(F.lit(x)), "HH:mm:ss") for x in ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00", "2024-01-01T12:00:00+02:00", "", "junk")]
    assert one(spark, *times) == ["10:00:00", "10:00:00", "10:00:00", None, None]
    assert one(spark, text.latest(F.lit(""), F.lit("old")), text.latest(F.lit("new"), F.lit("old")), text.known_label(F.lit("x"))) == ["old", "new", None]
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(now()) + s)
    assert one(spark, *[text.relative_time(at(s), now()) for s in (0, -1, -61, 7200, -86400, 86400, -3 * 86400, 400 * 86400)]) == ["now", "1 second ago", "1 minute ago", "in 2 hours", "yesterday", "tomorrow", "3 days ago", "next year"]
    assert one(spark, *[text.format_duration(F.lit(float(s))) for s in (0.5, 1.5, 61, 3723)]) == ["0s", "2s", "1m01s", "1h02m03s"]
    with pytest.raises(Exception, match="unsupported"):
        one(spark, text.label_tier(F.lit("guess")))


def test_crop_and_tensor(spark):
    crop = lambda w, h, v: image.cover_crop(F.lit(float(w)), F.lit(float(h)), F.lit(4.0), F.lit(4.0), F.lit(v))
    got = one(spark, crop(4, 6, "top"), crop(4, 6, "center"), crop(9, 4, "center"))
    assert [tuple(x) for x in got] == [(0, 0, 4, 4), (0, 1, 4, 4), (3, 0, 4, 4)]
    tensor = image.planar_tensor(F.array(*[F.lit(float(x)) for x in (255, 128, 0)]), F.array(*[F.lit(0.5)] * 3), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.5)))
    assert one(spark, tensor)[0] == pytest.approx([1, 0.0078431377, -1], abs=1e-6)
    assert one(spark, image.positive_probability(F.array(F.lit(0.3)))) == [0.3]


def test_probe_marks_broken_files(spark):
    def decode(raw):
        return len(raw), 1, "image/x", raw[:2]

    files = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"")), ("c", None)], "path string, content binary")

    def strict(raw):
        if not raw:
            raise ValueError("empty")
        return decode(raw)

    got = {r.path: r for r in image.probe_images(files, strict).collect()}
    assert got["a"].readable and got["a"].width == 3 and not got["b"].readable and not got["c"].readable


ROW = "normalized_url string, original_url string, handles array<string>, display_names array<string>, source_surfaces array<string>, seen_count long, first_seen_at timestamp, last_seen_at timestamp, example_profile_url string, example_notification_url string, example_tweet_url string, whitelisted boolean, file_rank int, position int"


def fold(rows):
    """What a sequential ingest leaves, with empty strings dropped."""
    state = {}
    for r in sorted(rows, key=lambda r: (r[-2], r[-1])):
        s = state.setdefault(r[0], {"handles": set(), "seen": 0, "first": None, "last": None, "profile": None, "listed": False, "original": None})
        s["handles"] |= {h for h in r[2] or [] if h}
        s["seen"] += r[5]
        s["first"] = min(filter(None, (s["first"], r[6])), default=None)
        s["last"] = max(filter(None, (s["last"], r[7])), default=None)
        s["profile"] = r[8] or s["profile"]
        s["listed"] = s["listed"] or bool(r[11])
        s["original"] = r[1]
    return state


def test_merge_equals_a_sequential_fold(spark):
    from datetime import datetime, timedelta

    r = random.Random(4)
    t0 = datetime(2024, 1, 1)
    rows = [(f"u{r.randint(0, 5)}", f"o{i}", r.choice([None, [], ["", "a"], ["b", "c"]]), ["n"], ["s"], r.randint(1, 4), t0 + timedelta(hours=r.randint(0, 99)), t0 + timedelta(hours=r.randint(0, 99)), r.choice([None, "", f"p{i}"]), None, "", r.choice([None, True, False]), i // 10, i % 10) for i in range(60)]
    df = spark.createDataFrame(rows, ROW)
    order = ["file_rank", "position"]
    start = spark.createDataFrame([], schema(AVATAR_URLS))
    whole = catalog.merge_into_catalog(start, catalog.merge_sightings(df, order), now())
    halves = catalog.merge_into_catalog(catalog.merge_into_catalog(start, catalog.merge_sightings(df.filter("file_rank < 3"), order), now()), catalog.merge_sightings(df.filter("file_rank >= 3"), order), now())
    want = fold(rows)
    for got in (whole, halves):
        found = {x.normalized_url: x for x in got.collect()}
        assert set(found) == set(want)
        for u, s in want.items():
            x = found[u]
            assert (set(x.handles), x.seen_count, x.first_seen_at, x.last_seen_at, x.example_profile_url, x.whitelisted, x.original_url) == (s["handles"], s["seen"], s["first"], s["last"], s["profile"], s["listed"], s["original"])
    assert catalog.merge_into_catalog(start, catalog.merge_sightings(df.limit(0), order), now()).count() == 0


def test_export_ledger(spark):
    ledger = spark.createDataFrame([("in/a.json",), ("raw/b.json",)], "export_path string")
    found = spark.createDataFrame([("in/a.json", "raw/a.json"), ("in/b.json", "raw/b.json"), ("in/c.json", "raw/c.json")], "source_path string, stored_path string")
    assert [r.source_path for r in catalog.new_exports(found, ledger).collect()] == ["in/c.json"]
    assert sorted(r.export_path for r in catalog.rename_archived(ledger, found).collect()) == ["raw/a.json", "raw/b.json"]
    again = ledger.limit(1)
    assert catalog.log_exports(ledger, again, force=True).count() == 2 and catalog.log_exports(ledger, again).count() == 3


def test_downloads(spark):
    urls = conform(spark.createDataFrame([("a", 5, None, "pending"), ("b", 9, None, "failed"), ("c", 1, "s", "downloaded"), ("d", 7, None, "pending")], "normalized_url string, seen_count long, image_sha256 string, download_status string"), AVATAR_URLS)
    assert [r.normalized_url for r in catalog.pending_downloads(urls).collect()] == ["d", "a"]
    assert [r.normalized_url for r in catalog.pending_downloads(urls, retry_failed=True, limit=1).collect()] == ["b"]
    done = spark.createDataFrame([("a", "s1", None), ("b", None, "boom")], "normalized_url string, sha256 string, error string")
    got = {r.normalized_url: r for r in catalog.record_outcomes(urls, done, now()).collect()}
    assert (got["a"].download_status, got["a"].image_sha256, got["b"].download_status, got["b"].last_download_error, got["c"].download_status) == ("downloaded", "s1", "failed", "boom", "downloaded")
    images = conform(spark.createDataFrame([("s", "positive")], "sha256 string, label string"), IMAGES)
    new = spark.createDataFrame([("s", "p1", "m", 1, 1, 1, 1), ("s", "p2", "m", 2, 2, 2, 2), ("t", "q", "m", 3, 3, 3, 1)], "sha256 string, local_path string, mime_type string, width int, height int, byte_size long, ord int")
    got = {r.sha256: r for r in catalog.record_images(images, new, now()).collect()}
    assert got["s"].local_path == "p2" and got["s"].label == "positive" and got["t"].width == 3 and len(got) == 2


def _images(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "sha256 string, label string, label_source string, local_path string"), IMAGES)


def _scores(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "run_id string, image_sha256 string, score double, predicted_label string, created_at timestamp_ntz").withColumn("created_at", F.col("created_at").cast("timestamp")), MODEL_SCORES)


def test_items_and_queues(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    images = _images(spark, ("a", None, None, "p"), ("b", "negative", "manual", "p"), ("c", "unclear", "manual", "p"), ("d", "positive", "model", "p"), ("e", None, None, None))
    scores = _scores(spark, ("r", "a", 0.5, "positive", t), ("r", "b", 0.9, "positive", t), ("r", "c", 0.9, "positive", t), ("q", "d", 0.2, "negative", t), ("r", "d", 0.4, "negative", t))
    urls = conform(spark.createDataFrame([("u1", "a", ["x", ""], ["notification-group"], 3, False, None), ("u2", "a", ["y"], ["tweet"], 4, True, "p2")], "normalized_url string, image_sha256 string, handles array<string>, source_surfaces array<string>, seen_count long, whitelisted boolean, example_profile_url string"), AVATAR_URLS)
    items = review.review_items(images, scores, urls, spark.createDataFrame([("r", 0.5)], "run_id string, threshold double"), "r").cache()
    by = {r.sha256: r for r in items.collect()}
    assert by["a"].seen_count == 7 and by["a"].handles == ["x", "y"] and by["a"].whitelisted and by["a"].example_profile_url == "p2" and by["a"].distance == 0
    assert by["e"].seen_count == 0 and by["e"].handles == [] and by["e"].score is None
    assert by["b"].flags == ["human_vs_model"] and by["c"].flags == [] and by["d"].flags == ["human_vs_model"]
    order = lambda q: [r.sha256 for r in review.queue(items, q).collect()]
    assert order("needs_review") == ["a", "d", "e"] and order("model_disagreements") == ["b", "d"] and order("hard_negatives") == ["b"] and order("exempted") == ["a"] and order("notifications") == ["a"]
    assert order("boundary_review") == ["a", "d"] and order("model_backlog") == ["a", "d"] and len(order("high_impact")) == 5
    with pytest.raises(ValueError):
        review.queue(items, "nope")
    latest = review.review_items(images, scores, urls, spark.createDataFrame([], "run_id string, threshold double")).filter("sha256 = 'd'")
    assert latest.count() == 2  # tied times stay
    assert review.item_at(items, "hard_negatives", 99).first().sha256 == "b" and review.item_at(items.filter("false"), "exempted", 3).count() == 0
    assert review.page(items, "high_impact", 99, 9).count() == 1 and review.page(items, "high_impact", 0, 2).count() == 2
    with pytest.raises(ValueError):
        review.page(items, "high_impact", 0, 26)
    with pytest.raises(KeyError):
        review.item(items, "zz")
    with pytest.raises(ValueError):
        review.labeled_grid(items, "other")
    assert [r.label for r in review.labeled_grid(items).collect()][0] in ("negative", "positive")
    assert review.summary(items.filter("false")).first().total == 0
    assert {r.label: r["items"] for r in review.label_counts(items).collect()} == {"positive": 0, "negative": 1, "unclear": 1}
    assert review.preferred_queue(items).first().queue == "hard_negatives"


def test_relabel(spark):
    from datetime import datetime

    images = _images(spark, ("m1", "positive", "model", "p"), ("m2", "positive", "model", "p"), ("h", "unclear", "manual", "p"), ("n1", None, None, "p"), ("n2", None, None, "p"))
    scores = _scores(spark, ("r", "m1", 0.1, "negative", datetime(2024, 1, 1)), ("r", "h", 0.9, "positive", datetime(2024, 1, 1)), ("r", "n1", 0.8, "positive", datetime(2024, 1, 1)), ("other", "n2", 0.8, "positive", datetime(2024, 1, 1)))
    got = {r.sha256: (r.label, r.label_source) for r in labels.refresh_model_labels(images, scores, "r", now()).collect()}
    assert got == {"m1": ("negative", "model"), "m2": (None, None), "h": ("unclear", "manual"), "n1": ("positive", "model"), "n2": (None, None)}
    note = labels.refresh_model_labels(images, scores, "r", now()).filter("sha256 = 'm1'").first().review_notes
    assert list(json.loads(note)) == ["predicted_label", "run_id", "score", "type"]
    assert tuple(labels.relabel_counts(images, scores, "r").first()) == (1, 1, 2)


def test_labels_and_undo(spark):
    images = _images(spark, ("a", None, None, "p"), ("b", "negative", "manual", "p"))
    events = empty(spark, "label_events")
    ask = lambda *rows: spark.createDataFrame(list(rows), "sha256 string, label string, notes string, ord int")
    i1, e1 = labels.apply_labels(images, events, ask(("a", "positive", "n", 1), ("b", "negative", None, 2)), now())
    assert e1.count() == 1 and {r.sha256: r.label for r in i1.collect()} == {"a": "positive", "b": "negative"}
    i2, e2 = labels.apply_labels(i1, e1, ask(("a", "negative", "x", 1), ("a", "unclear", "y", 2), ("b", "negative", "z", 3)), now(), batch_id="k")
    logged = e2.filter("batch_id = 'k'").orderBy("id").collect()
    assert [(r.image_sha256, r.previous_label, r.new_label, r.new_review_notes) for r in logged] == [("a", "positive", "negative", None), ("a", "negative", "unclear", None)]
    i3, e3 = labels.undo(i2, e2, now())
    assert {r.sha256: (r.label, r.review_notes) for r in i3.collect()} == {"a": ("positive", "n"), "b": ("negative", None)} and e3.count() == 1
    i4, e4 = labels.undo(i3, e3, now())
    assert {r.sha256: r.label for r in i4.collect()} == {"a": None, "b": "negative"} and e4.count() == 0
    with pytest.raises(LookupError):
        labels.undo(i4, e4, now())
    with pytest.raises(ValueError):
        labels.apply_labels(images, events, ask(("zz", "positive", None, 1)), now())
    with pytest.raises(ValueError):
        labels.apply_labels(images, events, ask(("a", "maybe", None, 1)), now())
    same, log = labels.apply_labels(i1, e1, ask(("b", "negative", "note", 1)), now())
    assert log.count() == 2  # a single request with another note is one


def _sample(i, raw, pix, label="positive", tier="gold", source="export", eligible=True):
    return (i, "p", label, source, raw, pix, "manual", tier, 1.0, eligible, None)


def closure(rows):
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in itertools.combinations(rows, 2):
            if a[4] == b[4] or a[5] == b[5]:
                label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
    return {frozenset(k for k in label if label[k] == v) for v in set(label.values())}


@FEW
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=18))
def test_families_are_the_closure(spark, keys):
    rows = [_sample(f"s{i:02}", f"r{a}", f"x{b}") for i, (a, b) in enumerate(keys)]
    got = {}
    for r in families.families(spark.createDataFrame(rows, SAMPLES)).collect():
        got.setdefault(r.group_key, set()).add(r.sample_id)
    assert {frozenset(v) for v in got.values()} == closure(rows)


def test_family_records_and_conflicts(spark):
    rows = [_sample("z", "r1", "x1", tier="trusted"), _sample("b", "r2", "x1"), _sample("a", "r2", "x9", source="c", eligible=False), _sample("solo", "r5", "x5"), _sample("n", "r6", "x6"), _sample("m", "r6", "x7", label="negative")]
    df = spark.createDataFrame(rows, SAMPLES)
    g = {r.canonical.sample_id: r for r in families.group_records(df).collect()}
    assert g["b"].size == 3 and not g["b"].eligible and g["solo"].size == 1
    assert {r.sample_id for r in families.label_conflicts(df).collect()} == {"n", "m"}
    with pytest.raises(ValueError, match="m=negative"):
        families.require_no_conflicts(df)
    families.require_no_conflicts(df.filter("label = 'positive'"))
    assert families.group_records(df.limit(0)).count() == 0
    ids = families.group_records(df).select("group_id", F.lit("train").alias("split"))
    manifest = families.split_manifest(df, ids)
    order = [m.canonical.sample_id for m in manifest.collect()]
    assert order == sorted(order) and samples.dataset_entries(manifest).count() == len(order)


def test_components_of_long_chains_and_hubs(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(80)] + [(5, 5), (300, 299), (299, 300)]
    r.shuffle(edges)
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{101 + i: 100 for i in range(80)}, 300: 299}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _groups(spark, n, **more):
    rows = [(f"g{i:04}", "positive" if i % 3 == 0 else "negative", i % 4 != 0, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "group_id string, label string, eligible boolean, collection_only boolean")


def test_splits(spark):
    g = _groups(spark, 1200)
    assert splits.assign_splits(g.limit(0)).count() == 0
    held = {r.group_id: r.split for r in splits.collection_holdout(g).collect()}
    assert sorted(held.values()).count("test") == 64 and len(held) == 128
    first = {r.group_id: r for r in splits.assign_splits(g).collect()}
    assert len(first) == 1200 and first == {r.group_id: r for r in splits.assign_splits(g.repartition(7)).collect()}
    rows = {r.group_id: r for r in g.collect()}
    assert all(r.split == "train" for r in first.values() if not rows[r.group_id].eligible and r.group_id not in held)
    prior = spark.createDataFrame([(k, r.split) for k, r in first.items() if k < "g1000"], "group_id string, split string")
    second = {r.group_id: r for r in splits.assign_splits(g, prior).collect()}
    assert all(second[k].split == first[k].split for k in second if k < "g1000")
    assert all(second[k].split != "test" for k in second if k >= "g1000" and second[k].reason == "new")
    one_class = g.withColumn("label", F.lit("positive"))
    assert splits.stratified_holdout(one_class, 0.25, 1).filter("held").count() == 300
    single = g.limit(1)
    assert splits.stratified_holdout(single, 0.2, 1).filter("held").count() == 1  # fewer than two folds
    assert splits.stratified_holdout(g, 0, 1).filter("held").count() == 0
    assert (splits.assignment_mode(False, 3), splits.assignment_mode(True, 0), splits.assignment_mode(True, 2)) == ("fresh", "reused", "appended")
    tokens = spark.range(10).withColumnRenamed("id", "token_id")
    assert splits.sample_tokens(tokens, 99, "s").count() == 10 and splits.sample_tokens(tokens, 3, "s").count() == 3
    assert {r.split: r.total for r in splits.split_summary(spark.createDataFrame([("train", "positive", "gold")], "split string, label string, label_tier string")).collect()} == {"train": 1, "val": 0, "test": 0}


def brute_threshold(rows, floor):
    if not rows:
        return 0.995
    best = None
    for t in sorted({0.0, 1.0, *[s for s, _ in rows]}):
        tp = sum(s >= t and p for s, p in rows)
        fp = sum(s >= t and not p for s, p in rows)
        fn = sum(s < t and p for s, p in rows)
        p, r = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        f = 2 * p * r / (p + r) if p + r else 0
        key = (p >= floor, 0 if p >= floor else p, r, f, t)
        best = max(best, key) if best else key
    return best[-1]


@FEW
@given(st.lists(st.tuples(st.integers(0, 8), st.booleans()), max_size=25), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_threshold_is_brute_force(spark, rows, floor):
    rows = [(s / 8, p) for s, p in rows]
    df = spark.createDataFrame([(s, "positive" if p else "negative") for s, p in rows], "score double, label string")
    assert metrics.choose_threshold(df, floor).first().threshold == brute_threshold(rows, floor)


def test_metrics_without_rows_and_comparison(spark):
    none = spark.createDataFrame([], "score double, label string")
    assert tuple(metrics.confusion(none, 0.5).first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    rows = [("base", 0.9, 0.8, 4.0, 5.0), ("same", 0.9, 0.8, 4.0, 5.0), ("better", 0.9, 0.9, 4.0, 4.0), ("worse", 0.8, 0.8, 5.0, 5.0), ("mixed", 0.95, 0.7, 3.0, 9.0), ("close", 0.9 + 1e-10, 0.8, 4.0, 5.0)]
    got = {r.run_id: r for r in metrics.compare_runs(spark.createDataFrame(rows, "run_id string, precision double, recall double, fp double, fn double"), "base").collect()}
    assert {k: r.verdict for k, r in got.items()} == {"base": "baseline", "same": "mixed", "better": "better", "worse": "worse", "mixed": "mixed", "close": "better"}
    assert got["close"].precision_delta == "=" and got["better"].recall_delta == "↑0.1000" and got["mixed"].fn_delta == "↑4"
    assert "run_id" in sinks.comparison_table(spark.createDataFrame(rows, "run_id string, precision double, recall double, fp double, fn double"))
    history = [(1, "head", 0.5, 0.5), (2, "finetune", 0.6, 0.1), (3, "finetune", 0.6, 0.1), (4, "finetune", 0.5, 0.9), (5, "finetune", 0.6, 0.0), (6, "finetune", 0.9, 0.9)]
    best = metrics.best_epoch(spark.createDataFrame([("r", *h) for h in history], "run_id string, epoch int, phase string, recall double, f1 double"), 3).first()
    assert (best.best_epoch, best.stop_epoch) == (2, 5)
    fresh = metrics.freshness(spark.createDataFrame([], "updated_at timestamp"), now(), F.timestamp_seconds(F.unix_timestamp(now()) + 1)).first()
    assert fresh.reasons == ["collections changed after the manifest"] and not fresh.fresh


def test_sources_and_sinks(spark, tmp_path):
    for name, body in {"b.json": {"version": 1, "avatars": [{"normalized_url": "u", "handles": ["a"], "seen_count": 2, "first_seen_at": "2024-01-01T00:00:00Z", "extra": 1}]}, "a.json": {"version": 1, "avatars": []}}.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    paths = manifests.discover_exports(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.json", "b.json"]
    assert manifests.discover_exports(spark, "", [str(tmp_path / "b.json"), str(tmp_path / "none.json")]) == [str(tmp_path / "b.json")]
    rows = manifests.manifest_rows(manifests.read_manifests(spark, paths)).collect()
    assert len(rows) == 1 and rows[0].file_rank == 1 and rows[0].position == 0
    assert manifests.read_manifests(spark, []).count() == 0
    assert manifests.read_jsonl(spark, str(tmp_path / "missing.jsonl")).count() == 0
    entries = spark.createDataFrame([("i", "p", "positive", "s", "train", "manual", "gold", 1.0)], "id string, path string, label string, source string, split string, label_source string, label_tier string, sample_weight double")
    sinks.write_entries(entries, str(tmp_path / "ds"))
    assert spark.read.json(str(tmp_path / "ds")).first().split == "train"
    sinks.write_jsonl(entries, str(tmp_path / "all"))
    assert manifests.read_jsonl(spark, str(tmp_path / "all")).collect() == entries.collect()
    sinks.write_version(entries, str(tmp_path / "state"), "1")
    with pytest.raises(Exception, match="exist"):
        sinks.write_version(entries, str(tmp_path / "state"), "1")
    (tmp_path / "bad.json").write_text('{"version": "x y"}')
    with pytest.raises(Exception):
        manifests.read_manifests(spark, [str(tmp_path / "bad.json")]).collect()
    assert one(spark, manifests.whitelist_import(F.lit('["@B", "a", ""]')), manifests.whitelist_import(F.lit(' {"whitelist_handles": ["C"]}'))) == [["a", "b"], ["c"]]
    with pytest.raises(Exception, match="whitelist"):
        one(spark, manifests.whitelist_import(F.lit("3")))
    stats = one(spark, manifests.client_stats(F.lit('{"tweetsScanned": 3, "errors": "x"}')))[0]
    assert stats.tweetsScanned == 3 and stats.errors == 0 and stats.lastMatchAt is None
    state = spark.createDataFrame([({"k": '{"displayName": "N"}'},)], "accounts map<string,string>")
    assert manifests.matched_accounts(state).first().handle == "k"
    avatars = spark.createDataFrame([({"u": '{"handles": ["b", "a", ""], "seenCount": 2}'},)], "avatars map<string,string>")
    got = manifests.collected_avatars(avatars).first()
    assert got.normalized_url == got.original_url == "u" and got.handles == ["a", "b"] and not got.whitelisted
    assert one(spark, manifests.client_settings(F.lit('{"mode": "nope"}')))[0].mode == "hide"
    thresholds = spark.createDataFrame([("r", '{"threshold": 0.4}'), ("bad", "{"), ("none", "{}")], "run_id string, text string")
    assert [tuple(r) for r in manifests.run_thresholds(thresholds).collect()] == [("r", 0.4)]
    assert ensure_column(entries, "x", "int").columns[-1] == "x" and ensure_column(entries, "id", "int") is entries
    payload = accounts.export_payload(conform(spark.createDataFrame([("u", 3)], "normalized_url string, seen_count long"), AVATAR_URLS), "t").first().payload
    assert json.loads(payload)["total_sightings"] == 3


def test_collections(spark):
    manifest = spark.createDataFrame([([("c", [(1, "p", "ok", None), (2, "q", "failed", "e")]), ("unknown", [])],)], "collections array<struct<slug:string,samples:array<struct<token_id:long,local_path:string,status:string,error:string>>>>")
    specs = spark.createDataFrame([("c",)], "slug string")
    assert [tuple(r) for r in samples.collection_rows(manifest, specs).collect()] == [("c", 1, "p")]
    with pytest.raises(Exception, match="unknown collection"):
        samples.collection_rows(manifest, specs.filter("false")).collect()
    prints = spark.createDataFrame([("p", "r", "x", False)], "path string, raw_sha string, pixel_digest string, readable boolean")
    rows = spark.createDataFrame([("c", 1, "p")], "slug string, token_id long, local_path string")
    images = _images(spark, ("s", "positive", "manual", "gone"))
    with pytest.raises(Exception, match="missing or unreadable"):
        samples.samples(images, prints, rows).collect()


def test_fetching(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return (404, "", b"") if "none" in url else (200, "image/png", url.encode())

    wanted = spark.createDataFrame([("k1", ["bad", "ok1"]), ("k2", ["none"]), ("k3", [])], "key string, urls array<string>")
    got = {r.key: r for r in fetch.fetch_all(wanted, get).collect()}
    assert got["k1"].url == "ok1" and got["k1"].byte_size == 3 and got["k2"].error == "none: status 404" and got["k3"].error == "no url"
    have = spark.createDataFrame([("k1",)], "key string")
    assert fetch.fetch_missing(wanted, have, get).count() == 2 and fetch.fetch_missing(wanted, have, get, force=True).count() == 3
    texts = {r.key: r for r in fetch.fetch_texts(wanted, get).collect()}
    assert texts["k1"].text == "ok1" and texts["k2"].error == "none: status 404"
    urls = spark.createDataFrame([("a", "u"), ("b", "v")], "key string, url string")
    probes = {r.key: (r.ok, r.status) for r in fetch.probe_urls(urls, lambda u: 405, lambda u: 206 if u == "u" else 404).collect()}
    assert probes == {"a": (True, 206), "b": (False, 404)}


def test_a_file_that_cannot_be_stored_is_a_failed_row(spark, tmp_path):
    (tmp_path / "taken").write_text("a file where a folder should be")
    wanted = spark.createDataFrame([("k", ["u"])], "key string, urls array<string>")
    row = fetch.fetch_all(wanted, lambda url: (200, "image/png", b"body"), f"file://{tmp_path}/taken").first()
    assert row.sha256 is None and row.local_path is None and "not stored" in row.error


def test_accounts(spark):
    df = spark.createDataFrame([("b", "Bee", 2), ("a", None, 2), ("c", "x", 9)], "handle string, display_name string, posts_matched long")
    assert [r.handle for r in accounts.ordered_accounts(df).collect()] == ["c", "a", "b"]
    assert [r.handle for r in df.filter(accounts.matches_search("  bE ")).collect()] == ["b"] and df.filter(accounts.matches_search(" ")).count() == 3
    assert one(spark, *[accounts.match_rate(F.lit(a), F.lit(b)) for a, b in ((0, 0), (1, 3), (1, 100))]) == ["0%", "33.3%", "1.00%"]


def test_streams_with_state_over_batches(spark, tmp_path):
    from datetime import datetime

    rows = [("e", s, datetime(2024, 1, 1, 0, i)) for i, s in enumerate(["a", "a", "b", "a", "a", "c"])]
    for k, part in enumerate((rows[:2], rows[2:5], rows[5:])):
        spark.createDataFrame(part, "element string, signature string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("element string, signature string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    collector.run_to_memory(collector.changed_elements(stream), "changed", str(tmp_path / "ck"), "append")
    assert [r.signature for r in spark.table("changed").orderBy("ts").collect()] == ["a", "b", "a", "c"]
    batch = spark.createDataFrame(rows, "element string, signature string, ts timestamp")
    assert manifests.changed_signatures(batch, "element", "ts").count() == 4
    assert collector.with_watermark(batch, "1 minute").count() == 6


def test_scoring_rows_and_settings(spark):
    scored = spark.createDataFrame([("i", 0.5, None)], "image_sha256 string, score double, split string")
    assert model.score_rows(scored, "r", 0.5, now()).first().predicted_label == "positive"
    assert model.onnx_metadata("r", 0.5)["positive_index"] == 1
    events = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "handle string, matched boolean")
    settings_ = spark.createDataFrame([("fade", ["a"])], "mode string, whitelist_handles array<string>")
    assert {r.handle: r.decision for r in collector.apply_settings(events, settings_).collect()} == {"a": "show", "b": "fade", "c": "show"}


def test_attach_gives_hot_and_cold_keys_their_rows(spark):
    from curatrix.shared import attach

    rows = [("hot", i) for i in range(40)] + [(f"k{i}", i) for i in range(10)] + [("none", 1)]
    left = spark.createDataFrame(rows, "key string, i int")
    sizes = left.filter("key <> 'none'").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.upper("key"))
    want = sorted((k, i, None if k == "none" else k.upper()) for k, i in rows)
    for total in (1, 20_000, 10**9):  # all keys hot, one hot, none
        got = attach(left, sizes, "key", "n", total)
        assert sorted(((r.key, r.i, r.v) for r in got.collect()), key=lambda x: (x[0], x[1])) == sorted(want, key=lambda x: (x[0], x[1]))


def test_run_presets_and_training_order(spark):
    from curatrix.operators import review as r

    releases = spark.createDataFrame([(1, "v1", "a"), (2, "v2", "b")], "position int, name string, run_id string")
    wip = lambda x: spark.createDataFrame([(x,)], "run_id string")
    assert [x.run_id for x in r.run_presets(releases).collect()] == ["a", "b"]
    assert [x.name for x in r.run_presets(releases, wip("c")).collect()] == ["v1", "v2", "WIP"] and r.run_presets(releases, wip("a")).count() == 2
    entries = spark.createDataFrame([(str(i),) for i in range(20)], "id string")
    order = lambda df, seed: [x.id for x in splits.training_order(df, seed).orderBy("place").collect()]
    assert order(entries, 1) == order(entries.repartition(3), 1) != order(entries, 2)
    assert [x.place for x in splits.training_order(entries, 1).orderBy("place").collect()] == list(range(1, entries.count() + 1))


def test_manifests_of_equal_names_are_two_files(spark, tmp_path):
    from curatrix.sources import manifests

    for k, folder in enumerate(("a", "b c")):
        (tmp_path / folder).mkdir()
        row = {"normalized_url": f"u{k}", "original_url": "o", "handles": [], "display_names": [], "source_surfaces": [], "seen_count": 1, "first_seen_at": None, "last_seen_at": None, "example_profile_url": None, "example_notification_url": None, "example_tweet_url": None, "whitelisted": False}
        (tmp_path / folder / "x.json").write_text(json.dumps({"version": 1, "exported_at": "2024-01-01T00:00:00Z", "avatar_count": 1, "total_sightings": 1, "avatars": [row]}))
    rows = manifests.manifest_rows(manifests.read_manifests(spark, [str(tmp_path / "b c" / "x.json"), str(tmp_path / "a" / "x.json")]))
    assert sorted((r.file_rank, r.normalized_url) for r in rows.collect()) == [(0, "u1"), (1, "u0")]


def test_documents_of_the_client_and_of_a_model(spark):
    from curatrix.sources import manifests

    meta = {"architecture": "m", "class_names": ["a", "b"], "input_size": 128, "channels": 3, "mean": [0.5, 0.5, 0.5], "std": [0.5, 0.25, 0.5], "positive_index": 1, "generated_at": "t", "threshold": 0.4, "run_id": "r"}
    read = lambda text: spark.createDataFrame([(text,)], "t string").select(manifests.runtime_config(F.col("t")).alias("c")).first().c
    assert read(json.dumps(meta)).asDict() == {"input_size": 128, "channels": 3, "mean": [0.5] * 3, "std": [0.5, 0.25, 0.5], "positive_index": 1}
    for broken in ({**meta, "mean": [0.5]}, {k: v for k, v in meta.items() if k != "positive_index"}):
        with pytest.raises(Exception, match="not whole"):
            read(json.dumps(broken))
    df = spark.createDataFrame([(["@B", "a", "b"],), ([],)], "h array<string>")
    out = [r.t for r in df.select(manifests.whitelist_export(F.col("h"), F.lit("2024-01-01T00:00:00Z")).alias("t")).collect()]
    assert json.loads(out[0]) == {"version": 1, "exported_at": "2024-01-01T00:00:00Z", "whitelist_handles": ["a", "b"]} and out[1] is None
    stored = spark.createDataFrame([("stats", "x"), ("other", "y"), ("settings", "z")], "key string, value string")
    left = {r.key: r.value for r in manifests.reset_client(stored, ("stats", "matchedAccounts")).collect()}
    assert left["other"] == "y" and left["settings"] == "z" and json.loads(left["stats"])["errors"] == 0 and left["matchedAccounts"] == "{}"


def test_picture_headers():
    from curatrix.sources.fetch import picture_header

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (8).to_bytes(4, "big") + (12).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (12).to_bytes(2, "big") + (8).to_bytes(2, "big")
    gif = b"GIF89a" + (8).to_bytes(2, "little") + (12).to_bytes(2, "little")
    webp = b"RIFF....WEBPVP8X" + b"\0" * 8 + (7).to_bytes(3, "little") + (11).to_bytes(3, "little")
    assert [picture_header(x) for x in (png, jpeg, gif, webp, b"<html>", b"")] == [("image/png", 8, 12), ("image/jpeg", 8, 12), ("image/gif", 8, 12), ("image/webp", 8, 12), (None, None, None), (None, None, None)]


def test_places_are_those_of_a_sort(spark):
    from curatrix.shared import placed

    df = spark.range(0, 5000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("k"), "id")
    got = [(r.place, r.k, r.id) for r in placed(df, [F.desc("k"), F.col("id")]).orderBy("place").collect()]
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(((k, i) for _, k, i in got), key=lambda x: (-x[0], x[1]))
    assert placed(df.limit(0), [F.col("id")]).count() == 0


def test_state_by_changed_keys_and_settings_at_each_batch(spark, tmp_path):
    """Three input files, a micro-batch each: the state is that of all, and settings are read when a batch comes."""
    from curatrix.streaming import collector

    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(f"h{i % 4}", i + 10 * k) for i in range(5 * (k + 1))], "handle string, n long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("handle string, n long").option("maxFilesPerTrigger", 1).parquet(source)
    collector.keep_latest(stream.groupBy("handle").agg(F.sum("n").alias("n")), str(tmp_path / "state"), ["handle"], str(tmp_path / "ck")).awaitTermination()
    last = deltas.read_latest(spark, str(tmp_path / "state"), "handle string, n long", ["handle"])
    want = {r.handle: r.n for r in spark.read.parquet(source).groupBy("handle").agg(F.sum("n").alias("n")).collect()}
    assert {r.handle: r.n for r in last.collect()} == want
    modes, seen = iter(["hide", "fade", "off", "off"]), []
    settings = lambda: spark.createDataFrame([(next(modes), [])], "mode string, whitelist_handles array<string>")
    events = stream.withColumn("matched", F.lit(True))
    collector.decide(events, settings, lambda df, epoch: seen.append({r.decision for r in df.select("decision").collect()}), str(tmp_path / "ck2")).awaitTermination()
    assert seen == [{"hide"}, {"fade"}, {"show"}]


def test_an_entry_for_notifications_is_the_last(spark):
    from curatrix.streaming import collector

    rows = [("a", "u", 1, "old"), ("a", "u", 3, "new"), ("a", "v", 2, "x"), ("a", "u", 2, "mid")]
    df = spark.createDataFrame(rows, "handle string, normalized_url string, ts int, name string")
    assert sorted(map(tuple, collector.notification_entries(df).collect())) == [("a", "u", 3, "new"), ("a", "v", 2, "x")]


def _proto(*fields):
    """A protobuf message of (number, value): bytes, text, messages and small integers."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            body = value.encode() if isinstance(value, str) else value
            out += bytes([number << 3 | 2, len(body)]) + body
    return out


def _identity_model(rows):
    """An ONNX model that gives back its input of two columns; rows: a name or a fixed number."""
    dim = _proto((2, rows)) if isinstance(rows, str) else _proto((1, rows))
    kind = _proto((1, _proto((1, 1), (2, _proto((1, dim), (1, _proto((1, 2))))))))
    graph = _proto((1, _proto((1, "x"), (2, "y"), (4, "Identity"))), (2, "g"), (11, _proto((1, "x"), (2, kind))), (12, _proto((1, "y"), (2, kind))))
    return _proto((1, 7), (7, graph), (8, _proto((2, 13))))


@pytest.mark.parametrize("rows", ["n", 1])
def test_onnx_scores_go_together_and_fail_alone(spark, rows):
    pytest.importorskip("onnxruntime")
    from curatrix.operators import model

    data = [(f"k{i}", [0.0, float(i)], [1, 2]) for i in range(5)] + [("short", [1.0], [1, 2]), ("null", None, None), ("other", [1.0, 2.0, 3.0], [1, 3])]
    df = spark.createDataFrame(data, "key string, tensor array<float>, shape array<int>").coalesce(1)
    got = {r.key: (r.score, r.error) for r in model.score_onnx(df, "key", _identity_model(rows), together=3).collect()}
    for i in range(5):
        assert got[f"k{i}"][1] is None and abs(got[f"k{i}"][0] - 1 / (1 + math.exp(-i))) < 1e-6
    assert all(got[k][0] is None and got[k][1] for k in ("short", "null", "other")) and len(got) == 8


def test_training_items_have_their_sources_crop(spark):
    """A file of 4 by 6 pixels, cropped from the top for one source and around the center for the other."""
    import numpy as np

    from curatrix.operators import model

    picture = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(6, 4, 3)

    def decode(content, box, size):
        left, top, width, height = box
        assert (width, height) == (size, size)
        return np.frombuffer(content, np.uint8).reshape(6, 4, 3)[top : top + height, left : left + width].tobytes()

    files = spark.createDataFrame([("p", picture.tobytes(), "tops", 4, 6), ("p", picture.tobytes(), "export", 4, 6), ("bad", b"x", "export", 4, 6)], "path string, content binary, source string, width int, height int")
    variants = model.image_variants(files, decode, 4, ("tops",))
    entries = spark.createDataFrame([("a", "p", "positive", "tops", 0.5), ("b", "p", "negative", "export", 1.0), ("c", "bad", "positive", "export", 1.0)], "id string, path string, label string, source string, sample_weight double")
    got = {r.id: r for r in model.training_items(entries, variants, ("tops",), [0.5] * 3, [0.5] * 3).collect()}
    want = lambda top: ((picture[top : top + 4] / 255.0 - 0.5) / 0.5).transpose(2, 0, 1).ravel()
    assert np.allclose(got["a"].tensor, want(0)) and np.allclose(got["b"].tensor, want(1)) and got["c"].tensor is None
    assert [(got[k].target, got[k].weight) for k in "abc"] == [(1, 0.5), (0, 1.0), (1, 1.0)]


def test_flat_members_are_those_of_the_manifest(spark):
    from curatrix.operators import families
    from curatrix.plans import domain as D

    rows = D.samples(spark, "/root/testdata/sf0.001")
    groups = families.group_records(rows)
    given = groups.select("group_id", F.when(F.crc32("group_id") % 2 == 0, "train").otherwise("val").alias("split")).filter(F.crc32("group_id") % 5 != 0)
    flat = {(r.group_id, r.split, r.sample_id) for r in families.split_members(rows, given).collect()}
    nested = families.split_manifest(rows, given).select("group_id", "split", F.explode("members.sample_id").alias("s"))
    assert flat == {tuple(r) for r in nested.collect()} and len(flat) > 50


def test_an_export_is_a_document_or_lines(spark, tmp_path):
    from curatrix.plans import domain as D
    from curatrix.sources import sinks

    avatars = D.merged(spark, "/root/testdata/sf0.001")
    n = avatars.count()
    assert sinks.write_export(avatars, "t", str(tmp_path / "one"), n) and not sinks.write_export(avatars, "t", str(tmp_path / "lines"), n - 1)
    assert json.loads(spark.read.text(str(tmp_path / "one")).first()[0])["avatar_count"] == n == spark.read.text(str(tmp_path / "lines")).count()
