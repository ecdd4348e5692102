"""The loop's commands, each a function over a catalog of versions, and the views that a review tool asks for.

A command reads one snapshot of the catalog, works out the next versions as DataFrames, writes them beside the old and then one
commit: nothing that is being read is overwritten, and a command that fails leaves the catalog as it was. Where another command
was faster, a command on labels is worked out again, and any other fails with Conflict.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import image
from curatrix.functions.text import normalize_image_url, parse_time
from curatrix.operators import catalog, families, labels, metrics, model, review, samples, splits
from curatrix.operators import ledger as ledger_ops
from curatrix.schemas import RELATIONS, conform
from curatrix.shared import materialise
from curatrix.sources import fetch, manifests, sinks
from curatrix.sources.versions import ATTEMPTS, Catalog, Conflict, Snapshot

__all__ = ["ATTEMPTS", "Catalog", "Conflict", "Snapshot"]


def _now():
    return F.lit(datetime.now(timezone.utc).isoformat()).cast("timestamp")


def ingest(c: Catalog, folder: str, inputs: list[str] | None = None, force: bool = False) -> int:
    """Merge the manifests that the ledger does not know, or all when forced; returns how many.

    A forced manifest takes what it had contributed before out of the catalog and puts what it says now in, as the last that came.
    Of files with one name the first is taken, or the last when forced. Contributions, the files as they are, the ledger and the
    catalog's rows hold by one commit.
    """
    paths = manifests.discover_exports(c.spark, folder, inputs)
    return ingest_files(c, paths, force) if paths else 0


def ingest_files(c: Catalog, paths: list[str], force: bool = False) -> int:
    snap = c.snapshot()
    stored = {p: f"{c.root}/raw/{p.rsplit('/', 1)[1]}" for p in paths}
    found = c.spark.createDataFrame(list(stored.items()), "source_path string, stored_path string")
    ledger = catalog.rename_archived(snap.read("exports"), found)
    new = set(paths) if force else {r["source_path"] for r in catalog.new_exports(found, ledger).collect()}  # a part of the listing
    by_name: dict[str, str] = {}
    for p in paths:
        if p in new and (force or stored[p] not in by_name):
            by_name.pop(stored[p], None)  # the last of a name also takes its place
            by_name[stored[p]] = p
    if not by_name:
        moved = found.join(snap.read("exports"), F.col("source_path") == F.col("export_path"), "left_semi")
        if not moved.isEmpty():
            snap.write(exports=ledger)
        return 0
    take = list(by_name.values())
    read = manifests.read_manifests(c.spark, take)
    at = F.concat(F.lit(f"{c.root}/raw/"), F.element_at(F.split("path", "/"), -1))  # the reader adds the file system's scheme
    rows = manifests.manifest_rows(read).withColumn("export_path", at)
    fresh = materialise(ledger_ops.contributions(rows, snap.number + 1), "contributions")
    names = {r["export_path"]: r["part"] for r in c.spark.createDataFrame([(x,) for x in by_name], "export_path string").select("export_path", ledger_ops.part_name(F.col("export_path")).alias("part")).collect()}
    again = {names[x] for x in by_name if names[x] in snap.live("contributions")}
    old = snap.read("avatar_urls")
    if again:
        live = snap.read_parts("contributions", without=again).unionByName(fresh.drop("part"))
        touched = materialise(ledger_ops.touched_urls(snap.read_parts("contributions", only=again), fresh), "touched")
        merged = ledger_ops.refold(old, live, touched, _now())
    else:
        merged = catalog.merge_into_catalog(old, catalog.merge_sightings(fresh, list(ledger_ops.ORDER)), _now())
    entries = read.select(at.alias("export_path"), F.element_at(F.split("path", "/"), -1).alias("export_name"), parse_time(F.col("exported_at")).alias("exported_at"), _now().alias("ingested_at"), "version", F.col("avatar_count").cast("long").alias("avatar_count"), "total_sightings")
    next_ledger = catalog.log_exports(ledger, conform(entries, RELATIONS["exports"]), force=True)
    files = manifests.file_contents(c.spark, take).withColumn("export_path", F.concat(F.lit(f"{c.root}/raw/"), F.element_at(F.split("source_path", "/"), -1)))
    parts = {"contributions": fresh, "archive": files.withColumn("part", ledger_ops.part_name(F.col("export_path")))}
    snap.write(parts=parts, drop={"contributions": again}, exports=next_ledger, avatar_urls=merged)
    return len(take)


def download_avatars(c: Catalog, get: fetch.Fetcher, retry_failed: bool = False, limit: int | None = None) -> None:
    wanted = catalog.pending_downloads(c.read("avatar_urls"), retry_failed, limit)
    rows = wanted.select(F.col("normalized_url").alias("key"), F.array("normalized_url", "original_url").alias("urls"))
    done = materialise(fetch.fetch_all(rows, get, f"{c.root}/images"), "fetched")  # a fetch is not repeated by the second write
    outcomes = done.select(F.col("key").alias("normalized_url"), "sha256", "error")
    got = done.filter("sha256 is not null").select("sha256", "local_path", "mime_type", "width", "height", "byte_size", F.col("key").alias("ord"))
    # Outcomes go into whatever holds by then, so URLs that came meanwhile are not lost.
    c.update(lambda snap: {"images": catalog.record_images(snap.read("images"), got, _now()), "avatar_urls": catalog.record_outcomes(snap.read("avatar_urls"), outcomes, _now())})


def download_collections(c: Catalog, wanted: DataFrame, existing: DataFrame, get: fetch.Fetcher, force: bool = False) -> DataFrame:
    """Outcomes of tokens (key, urls), whose files are kept by hash; results by collection are samples.collection_results."""
    return materialise(fetch.fetch_missing(wanted, existing, get, force, f"{c.root}/collections"), "fetched")


def build_dataset(c: Catalog, fingerprints: DataFrame, collections: DataFrame, path: str, prior: DataFrame | None = None, weight: float = samples.COLLECTION_WEIGHT, test_ratio: float = 0.15, val_ratio: float = 0.15, seed: int = 7) -> DataFrame:
    """Samples, families and splits; writes entries by split, and the splits of the images. Returns (group_id, split)."""
    snap = c.snapshot()
    rows = materialise(families.families(samples.samples(snap.read("images"), fingerprints, collections, weight)), "families")  # once for all steps
    families.require_no_conflicts(rows)
    given = splits.assign_splits(families.group_records(rows), prior, test_ratio, val_ratio, seed)
    manifest = families.split_manifest(rows, given.select("group_id", "split"))
    sinks.write_entries(samples.dataset_entries(manifest), f"{path}/entries")
    members = families.split_members(rows, given.select("group_id", "split")).select("split", "exported_sha")
    snap.write(images=catalog.set_splits(snap.read("images"), members, _now()))
    return given


def train(entries: DataFrame, embeddings: DataFrame, run_id: str, floor: float = 0.995, epochs: int = 15):
    """Train on the train split and choose the threshold on val. Returns the model and its summary."""
    rows = materialise(entries.join(embeddings, "id", "left"), "training-rows")
    if missing := rows.filter("embedding is null").count():
        raise ValueError(f"{missing} entries have no embedding")
    if surplus := embeddings.select("id").join(entries.select("id"), "id", "left_anti").count():
        raise ValueError(f"{surplus} embeddings have no entry")
    fitted = model.train(rows.filter("split = 'train'"), epochs)
    scored = model.score(fitted, rows, "id").join(entries, "id")
    chosen = metrics.choose_threshold(scored.filter("split = 'val'"), floor).first()
    test = metrics.confusion(scored.filter("split = 'test'"), chosen["threshold"]).first()
    return fitted, {"run_id": run_id, "threshold": chosen["threshold"], "val": chosen.asDict(), "test": test.asDict()}


def picture_config(size: int | None = None) -> dict:
    """How a model of pictures takes them."""
    return {k: v for k, v in model.onnx_metadata("", 0.0, size or 128).items() if k in ("input_size", "mean", "std", "positive_index")}


def train_run(c: Catalog, entries: DataFrame, embeddings: DataFrame, run_id: str, floor: float = 0.995, epochs: int = 15, size: int | None = None):
    """Train, and keep the model as an ONNX graph, its document and its summary as the run's files."""
    fitted, summary = train(entries, embeddings, run_id, floor, epochs)
    root = f"{c.root}/models/{run_id}"
    sinks.write_bytes(c.spark, f"{root}/best.onnx", model.onnx_model(*model.coefficients(fitted)))
    sinks.write_bytes(c.spark, f"{root}/model.json", (json.dumps(model.onnx_metadata(run_id, summary["threshold"], size or 128), indent=2) + "\n").encode())
    sinks.write_bytes(c.spark, f"{root}/summary.json", json.dumps(summary).encode())  # the last, so a run that has one is whole
    return fitted, summary


def known_thresholds(c: Catalog) -> DataFrame:
    """(run_id, threshold) of the runs that have a summary."""
    kind = "run_id string, threshold double"
    if not manifests.exists(c.spark, f"{c.root}/models/*/summary.json"):
        return c.spark.createDataFrame([], kind)
    return c.spark.read.schema(kind).json(f"{c.root}/models/*/summary.json")


def check_run(c: Catalog, path_or_url: str, run_id: str | None = None, threshold: float | None = None, get: fetch.Fetcher | None = None) -> dict:
    """check_input by a run's model and threshold; without a run the newest that has a summary."""
    if run_id is None:
        found = c.spark.read.format("binaryFile").load(f"{c.root}/models/*/summary.json").select("path", "modificationTime") if manifests.exists(c.spark, f"{c.root}/models/*/summary.json") else None
        if found is None:
            raise ValueError("no run has been trained")
        run_id = found.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0].rsplit("/", 2)[1]
    files = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in c.spark.read.format("binaryFile").load(f"{c.root}/models/{run_id}").select("path", "content").collect()}  # three files
    about = json.loads(files["model.json"])
    return {"run_id": run_id} | check_input(c.spark, path_or_url, files["best.onnx"], about["threshold"] if threshold is None else threshold, about, get)


def evaluate(scored: DataFrame, thresholds: dict[str, float], baseline: str, eval_set: str = "blind") -> DataFrame:
    """Runs (run_id in scored) on one evaluation set, compared with the baseline."""
    rows = metrics.evaluation_entries(scored, eval_set)
    known = scored.sparkSession.createDataFrame(list(thresholds.items()), "run_id string, threshold double")
    by_run = metrics.confusion(rows.join(F.broadcast(known), "run_id"), F.col("threshold"), ["run_id"])
    return metrics.compare_runs(by_run, baseline)


def export_errors(scored: DataFrame, threshold: float, category: str) -> DataFrame:
    sides = {"false_positives": ("positive", "negative"), "false_negatives": ("negative", "positive")}
    return metrics.errors(scored, threshold, *sides[category])


def score(c: Catalog, scored: DataFrame, run_id: str, threshold: float, limit: int | None = None, relabel: bool = True) -> None:
    """Record a run's scores (image_sha256, score) and, unless told otherwise, refresh the model's labels."""
    if limit is not None and (limit <= 0 or relabel):
        raise ValueError("a limit is positive, and only for scoring alone")
    snap = c.snapshot()
    images = snap.read("images")
    wanted = catalog.scorable_images(images, limit).select(F.col("sha256").alias("image_sha256"), "split")
    rows = conform(model.score_rows(scored.join(wanted, "image_sha256"), run_id, threshold, _now()), RELATIONS["model_scores"])
    next_scores = catalog.upsert(snap.read("model_scores"), rows, ["run_id", "image_sha256"])
    out = {"model_scores": next_scores}
    if relabel:
        out["images"] = labels.refresh_model_labels(images, next_scores, run_id, _now())
    snap.write(**out)


def export_model(run_id: str, threshold: float) -> str:
    return json.dumps(model.onnx_metadata(run_id, threshold), indent=2) + "\n"


def check_picture(fitted, embedding: DataFrame, threshold: float) -> DataFrame:
    """One row: the score of a picture's embedding, and what it is taken for."""
    return model.score(fitted, embedding, "id").withColumn("predicted_label", labels.predicted_label(F.col("score"), threshold))


def check_input(spark: SparkSession, path_or_url: str, graph: bytes, threshold: float, config: dict, get: fetch.Fetcher | None = None) -> dict:
    """One picture, a PNG file or its address, and an ONNX model's probability for it. config: input_size, mean, std and
    positive_index, as in a model's document. What cannot be read or fetched is an error."""
    found = {"input": path_or_url, "threshold": threshold}
    if not path_or_url.lower().startswith(("http://", "https://")) and manifests.exists(spark, path_or_url):
        files = spark.read.format("binaryFile").load(path_or_url).select("path", "content")
        found["local_path"] = path_or_url
    else:
        url = spark.range(1).select(normalize_image_url(F.lit(path_or_url))).first()[0]
        outcome, body = fetch.fetch_one(get or fetch.http_get, [url])
        if outcome:
            raise ValueError(outcome)
        files = spark.createDataFrame([(url, bytearray(body))], "path string, content binary")
        found |= {"url": path_or_url, "normalized_url": url}
    size = config["input_size"]
    rows = image.pictures(files, size)
    tensor = image.planar_tensor(F.col("rgb"), F.lit(config["mean"]), F.lit(config["std"])).cast("array<float>")
    one = rows.select("path", F.when(F.col("rgb").isNotNull(), tensor).alias("tensor"), F.array(*map(F.lit, (1, 3, size, size))).alias("shape"), F.col("error").alias("unread"))
    scored = model.score_onnx(one, "path", graph, config.get("positive_index", 1)).join(one.select("path", "unread"), "path").first()
    if scored["unread"] or scored["error"]:
        raise ValueError(f"{path_or_url} cannot be read: {scored['unread'] or scored['error']}")
    return found | {"probability": scored["score"], "matched": scored["score"] >= threshold}


@dataclass
class Review:
    """What a review tool asks for; items of a run are worked out once and kept until something is written."""

    catalog: Catalog
    thresholds: DataFrame
    run_id: str | None = None
    _items: DataFrame | None = None

    def items(self) -> DataFrame:
        if self._items is None:
            c = self.catalog.snapshot()
            first = review.runs(c.read("model_scores")).first()
            run = self.run_id or (first["run_id"] if first else None)
            self._items = review.review_items(c.read("images"), c.read("model_scores"), c.read("avatar_urls"), self.thresholds, run).persist()
        return self._items

    def forget(self) -> None:
        if self._items is not None:
            self._items.unpersist()
        self._items = None

    def summary(self) -> DataFrame:
        return review.summary(self.items())

    def queue(self, name: str, index: int = 0) -> DataFrame:
        return review.item_at(self.items(), name, index)

    def batch(self, name: str, limit: int = 9, offset: int = 0) -> DataFrame:
        return review.page(self.items(), name, offset, limit)

    def item(self, sha256: str) -> DataFrame:
        return review.item(self.items(), sha256)

    def history(self, limit: int = 24) -> DataFrame:
        return labels.history(self.catalog.read("label_events"), self.items(), limit)

    def labeled_grid(self, label: str = "all", limit: int | None = None) -> tuple[int, DataFrame]:
        return review.grid(review.labeled_grid(self.items(), label), limit)

    def queue_grid(self, name: str, limit: int | None = None) -> tuple[int, DataFrame]:
        return review.grid(review.queue(self.items(), name), limit)

    def _transition(self, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        def next_(snap: Snapshot) -> dict[str, DataFrame]:
            images, events = change(snap.read("images"), snap.read("label_events"))
            return {"images": images, "label_events": events}

        self.catalog.update(next_)
        self.forget()

    def label(self, sha256: str, label: str, notes: str | None = None) -> None:
        self._apply([(sha256, label, notes, 0)], None)

    def batch_label(self, pairs: list[tuple[str, str]], batch_id: str) -> None:
        self._apply([(s, x, None, i) for i, (s, x) in enumerate(pairs)], batch_id)

    def _apply(self, rows: list[tuple], batch_id: str | None) -> None:
        asked = self.catalog.spark.createDataFrame(rows, "sha256 string, label string, notes string, ord int")
        self._transition(lambda images, events: labels.apply_labels(images, events, asked, _now(), batch_id))

    def undo(self) -> None:
        self._transition(lambda images, events: labels.undo(images, events, _now()))
