"""Reading manifests, datasets, run folders and client state. Schemas are given, never inferred."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions.text import EPOCH, filter_mode, no_strings, parse_time, read_number, unique_strings, whitelist_handles
from curatrix.schemas import COLLECTIONS, DATASET_ENTRY, MANIFEST, schema
from curatrix.shared import listed, small


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file of a pattern, is there; asked of the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def discover_exports(spark: SparkSession, folder: str, inputs: list[str] | None = None) -> list[str]:
    """The given paths that exist, in their order; without any, the folder's JSON files by name."""
    if inputs:
        there = {f: _names(spark, f) for f, n in Counter(_folder(p) for p in inputs).items() if f and n > FEW and not set(f) & set("{}[]*?\\")}
        return [p for p in inputs if p.rsplit("/", 1)[-1] in there.get(_folder(p), ()) or exists(spark, p)]
    pattern = f"{folder.rstrip('/')}/*.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(listed(spark, p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)))


#: A file of a plain name in a folder. Of a folder with more paths than FEW, all are looked up by one listing.
PLAIN = re.compile("(.*[^/:])/+[A-Za-z0-9][A-Za-z0-9._-]*")
FEW = 16


def _folder(path: str) -> str | None:
    """The folder of a file of a plain name, which stands in whole paths as it is; none of another."""
    found = PLAIN.fullmatch(path)
    return found and found[1]


def _names(spark: SparkSession, folder: str) -> set[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.rsplit("/", 1)[1] for x in listed(spark, files.listStatus(p))} if files.exists(p) else set()


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file with its place among the paths; text of a wrong type fails the read."""
    if not paths:
        return spark.createDataFrame([], schema(MANIFEST + ", path STRING, file_rank INT"))
    folders = {f: _whole(spark, f) for f in {_folder(p) for p in paths} if f}
    whole = [f"{folders[_folder(p)]}/{p.rsplit('/', 1)[1]}" if _folder(p) else _whole(spark, p) for p in paths]
    order = spark.createDataFrame([(p, i) for i, p in enumerate(whole)], "name string, file_rank int")
    rows = spark.read.schema(schema(MANIFEST)).option("multiLine", True).option("mode", "FAILFAST").json(paths).withColumn("path", F.input_file_name())
    return rows.join(small(order), F.regexp_replace("path", SCHEME, "$1:/") == F.col("name")).drop("name")


#: A path's scheme, whose slashes differ between what names the same file.
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):/+"


def _whole(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, as a reader names its file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(SCHEME, r"\1:/", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def file_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files as they are: source_path, modified, byte_size, sha256, content. A file is one value, so under 2 GB."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """A row for each avatar, with the file's rank and its position there; times parsed."""
    rows = manifests.select("path", "file_rank", F.posexplode_outer("avatars").alias("position", "a")).filter("a is not null").select("path", "file_rank", "position", "a.*")
    return rows.withColumn("first_seen_at", parse_time(F.col("first_seen_at"))).withColumn("last_seen_at", parse_time(F.col("last_seen_at")))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(COLLECTIONS)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str = DATASET_ENTRY) -> DataFrame:
    """JSON lines; a missing file is empty, blank lines are skipped, a wrong type is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema(ddl))
    return spark.read.schema(schema(ddl)).option("mode", "FAILFAST").json(path)


def index_files(files: DataFrame) -> DataFrame:
    """(number, path) of files (path) whose name is a number; of equal numbers the last path."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(stem.try_cast("long").alias("number"), "path").filter("number is not null").groupBy("number").agg(F.max("path").alias("path"))


def latest_run(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Of files (run_id, name, modified) the newest run that has a summary and a checkpoint."""
    has = files.groupBy("run_id").agg(F.bool_or(F.col("name") == "summary.json").alias("s"), F.bool_or(F.col("name").isin("best.pt", "checkpoint.pt")).alias("c"), F.max("modified").alias("modified"))
    found = has.filter("s and c")
    if exclude:
        found = found.filter(~F.col("run_id").isin(*exclude))
    return found.agg(F.max_by("run_id", F.struct("modified", "run_id")).alias("run_id"))


def latest_comparison(files: DataFrame) -> DataFrame:
    """Of files (folder, name, modified) the newest folder with a summary."""
    return files.filter(F.col("name") == "summary.json").agg(F.max_by("folder", F.struct("modified", "folder")).alias("folder"))


def run_thresholds(summaries: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """(run_id, threshold) of summaries (run_id, text); what cannot be read is skipped."""
    threshold = F.get_json_object("text", "$.threshold").try_cast("double")
    rows = summaries.select("run_id", threshold.alias("threshold")).filter("threshold is not null")
    return rows.filter(F.col("run_id").isin(*run_ids)) if run_ids is not None else rows


def promoted_run(pointer: DataFrame) -> DataFrame:
    """The run that a JSON text (text) names."""
    return pointer.select(F.get_json_object("text", "$.run_id").alias("run_id"))


def whitelist_import(text: Column) -> Column:
    """Handles of a JSON array, or of an object's whitelist_handles; anything else is an error."""
    plain = F.from_json(text, "array<string>")
    inside = F.from_json(F.get_json_object(text, "$.whitelist_handles"), "array<string>")
    first = F.substring(F.ltrim(text), 1, 1)
    found = F.when(first == "[", plain).when(first == "{", inside)
    return F.when(found.isNotNull(), whitelist_handles(found)).otherwise(F.raise_error(F.lit("not a whitelist")).cast("array<string>"))


def whitelist_export(handles: Column, exported_at: Column) -> Column:
    """A whitelist as a document: version, time and handles in their normal form; null for an empty list."""
    known = whitelist_handles(handles)
    text = F.to_json(F.struct(F.lit(1).alias("version"), exported_at.alias("exported_at"), known.alias("whitelist_handles")))
    return F.when(F.size(known) > 0, text)


#: What a reset leaves, as stored.
CLIENT_DEFAULTS = {"settings": '{"mode":"hide","whitelistHandles":[]}', "stats": '{"tweetsScanned":0,"avatarsChecked":0,"cacheHits":0,"postsMatched":0,"modelMatches":0,"errors":0,"lastMatchAt":null}', "matchedAccounts": "{}", "collectedAvatars": "{}"}


def reset_client(stored: DataFrame, keys: tuple[str, ...] = tuple(CLIENT_DEFAULTS)) -> DataFrame:
    """Stored values (key, value) with the defaults for the keys given, whether stored before or not."""
    spark = stored.sparkSession
    defaults = spark.createDataFrame([(k, CLIENT_DEFAULTS[k]) for k in keys], "key string, value string")
    return stored.filter(~F.col("key").isin(*keys)).select("key", "value").unionByName(defaults)


def runtime_config(text: Column) -> Column:
    """What a scorer needs of a model's metadata document: five fields; the document is checked as it is read."""
    kind = "input_size INT, channels INT, mean ARRAY<DOUBLE>, std ARRAY<DOUBLE>, positive_index INT"
    read = F.from_json(text, kind, {"mode": "FAILFAST"})
    whole = (F.size(read["mean"]) == read["channels"]) & (F.size(read["std"]) == read["channels"]) & read["input_size"].isNotNull() & read["positive_index"].isNotNull()
    return F.when(whole, read).otherwise(F.raise_error(F.lit("model metadata is not whole")).cast("struct<" + kind.replace(" INT", ": INT").replace(" ARRAY", ": ARRAY") + ">"))


def client_stats(text: Column) -> Column:
    """Counters with defaults: what is missing or no number is 0."""
    names = ("tweetsScanned", "avatarsChecked", "cacheHits", "postsMatched", "modelMatches", "errors")
    return F.struct(*[read_number(F.get_json_object(text, f"$.{n}")).cast("long").alias(n) for n in names], F.nullif(F.get_json_object(text, "$.lastMatchAt"), F.lit("")).alias("lastMatchAt"))


def client_settings(text: Column) -> Column:
    return F.struct(filter_mode(F.get_json_object(text, "$.mode")).alias("mode"), whitelist_handles(F.from_json(F.get_json_object(text, "$.whitelistHandles"), "array<string>")).alias("whitelist_handles"))


def matched_accounts(state: DataFrame) -> DataFrame:
    """Rows of a stored map (accounts: map<string, json>): the key stands in for a missing handle."""
    rows = state.select(F.explode("accounts").alias("key", "value"))
    read = lambda name: F.get_json_object("value", f"$.{name}")
    return rows.select(F.coalesce(F.nullif(read("handle"), F.lit("")), F.col("key")).alias("handle"), read("displayName").alias("display_name"), read_number(read("postsMatched")).cast("long").alias("posts_matched"), F.coalesce(read("lastMatchedAt"), F.lit(EPOCH)).alias("last_matched_at"))


def collected_avatars(state: DataFrame) -> DataFrame:
    """Rows of a stored map (avatars: map<string, json>), with defaults for what is missing."""
    rows = state.select(F.explode("avatars").alias("key", "value"))
    read = lambda name: F.get_json_object("value", f"$.{name}")
    strings = lambda name: unique_strings(F.from_json(read(name), "array<string>"))
    url = F.coalesce(F.nullif(read("normalizedUrl"), F.lit("")), F.col("key"))
    return rows.select(
        url.alias("normalized_url"), F.coalesce(F.nullif(read("originalUrl"), F.lit("")), url).alias("original_url"), strings("handles").alias("handles"), strings("displayNames").alias("display_names"), strings("sourceSurfaces").alias("source_surfaces"),
        read_number(read("seenCount")).cast("long").alias("seen_count"), F.coalesce(read("firstSeenAt"), F.lit(EPOCH)).alias("first_seen_at"), F.coalesce(read("lastSeenAt"), F.lit(EPOCH)).alias("last_seen_at"), F.coalesce(read("whitelisted").try_cast("boolean"), F.lit(False)).alias("whitelisted"),
    )


def changed_signatures(events: DataFrame, element: str, order: str) -> DataFrame:
    """Events whose signature differs from that of the element's event before."""
    before = F.lag("signature").over(Window.partitionBy(element).orderBy(order))
    return events.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.col("signature"))).drop("__before")


def entry_signature(handles: Column, urls: Column) -> Column:
    """handle:url pairs, sorted and joined."""
    return F.array_join(F.array_sort(F.zip_with(F.coalesce(handles, no_strings()), F.coalesce(urls, no_strings()), lambda h, u: F.concat(h, F.lit(":"), u))), "|")
