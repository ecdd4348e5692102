"""Queries of what comes in more than once: exports that are taken in again, and families that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators import catalog, families, ledger
from curatrix.plans import commands
from curatrix.plans import domain as D
from curatrix.plans.dataset_queries import CLOSURE
from curatrix.plans.registry import query
from curatrix.plans.review_queries import MERGED
from curatrix.plans.review_queries import _shown as shown
from curatrix.schemas import AVATAR
from curatrix.shared import materialise, shared_folder
from curatrix.sources import sinks

#: Every third export comes again: some rows are missing, all counts are others.
AGAIN = "floor(event_id / 1000) % 3 = 0"
#: The exports in their last versions; those that came again are the last.
LAST = f"""manifest_rows AS (SELECT * FROM first_rows WHERE NOT {AGAIN}
    UNION ALL SELECT * REPLACE (original_url || '&v=2' AS original_url, event_id % 5 + 1 AS seen_count, 1000000000 + event_id AS event_id) FROM first_rows WHERE {AGAIN} AND event_id % 4 <> 0 AND user_id % 7 <> 0)"""
FOLDED = f"{D.ROWS.replace('manifest_rows AS', 'first_rows AS', 1)}, {LAST}, {D.merged_sql('merged')}"


def exports(spark, d) -> tuple[DataFrame, DataFrame]:
    """The contributions of all exports as they came first, and of those that come again."""
    rows = D.manifest_rows(spark, d).withColumn("export_path", F.concat(F.lit("raw/"), F.col("file_rank").cast("string"), F.lit(".json"))).withColumn("file_rank", F.col("file_rank").cast("int"))
    again = rows.filter(AGAIN).filter("event_id % 4 <> 0 and user_id % 7 <> 0")
    again = again.withColumn("original_url", F.concat("original_url", F.lit("&v=2"))).withColumn("seen_count", F.col("event_id") % 5 + 1)
    return ledger.contributions(rows, 1), ledger.contributions(again, 2)


@query(f"WITH {FOLDED}, t AS (SELECT DISTINCT normalized_url AS u FROM first_rows WHERE {AGAIN}) SELECT {MERGED}, CASE WHEN u IS NULL THEN '{D.CUT}' ELSE '{D.NOW}' END AS updated FROM merged LEFT JOIN t ON normalized_url = u")
def ledger_forced(spark, d):
    """A catalog of all exports, of which every third is taken in again: what it had contributed goes, and only the URLs that it
    names are folded again. A URL that no export names any more is gone."""
    first, again = exports(spark, d)
    first = materialise(first, "contributions")
    state = catalog.merge_into_catalog(spark.createDataFrame([], D._AVATAR_URLS), catalog.merge_sightings(first, list(ledger.ORDER)), D.at(D.CUT))
    replaced = first.filter("file_rank % 3 = 0")
    live = first.filter("file_rank % 3 <> 0").unionByName(again)
    return shown(ledger.refold(state, live, ledger.touched_urls(replaced, again), D.at(D.NOW)), D.said("updated_at").alias("updated"))


def _manifests(rows: DataFrame) -> DataFrame:
    """(name, payload): rows of manifests as the documents that a collector exports."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    names = [c.split()[0] for c in AVATAR.split(", ")]
    avatar = F.struct(*[time(c) if c.endswith("_seen_at") else F.col(c) for c in names])
    one = rows.groupBy("file_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", avatar.alias("a")))), lambda x: x["a"]).alias("avatars"), F.count("*").alias("avatar_count"), F.sum("seen_count").alias("total_sightings"))
    payload = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("2024-02-01T00:00:00Z").alias("exported_at"), "avatar_count", "total_sightings", "avatars"))
    return one.select(F.format_string("%06d.json", "file_rank").alias("name"), payload.alias("payload"))


@query(f"WITH {FOLDED} SELECT {MERGED}, (SELECT count(DISTINCT event_id // 1000) FROM events) AS exports, (SELECT count(*) + count(*) FILTER (WHERE r % 3 = 0) FROM (SELECT DISTINCT event_id // 1000 AS r FROM events)) AS taken FROM merged")
def ingested_catalog(spark, d):
    """The loop's command over files: events as JSON manifests, taken in, changed and taken in again by force; then what the
    catalog's last snapshot holds, with the ledger's rows and the exports that were taken in."""
    folder = f"{shared_folder(spark)}/curatrix/exports-{uuid.uuid4().hex}"
    rows = D.manifest_rows(spark, d).withColumn("file_rank", F.col("file_rank").cast("int"))
    again = rows.filter(AGAIN).filter("event_id % 4 <> 0 and user_id % 7 <> 0").withColumn("original_url", F.concat("original_url", F.lit("&v=2"))).withColumn("seen_count", F.col("event_id") % 5 + 1)
    c = commands.Catalog(spark, f"{folder}/catalog")
    taken = 0
    for version, force in ((rows, False), (again, True)):
        paths = sorted(r["path"] for r in sinks.write_named(_manifests(version), f"{folder}/in").collect())  # a path for each export
        taken += commands.ingest(c, "", paths, force)
    snap = c.snapshot()
    counts = snap.read("exports").agg(F.count("*").alias("exports")).withColumn("taken", F.lit(taken))  # one row
    return shown(snap.read("avatar_urls").crossJoin(F.broadcast(counts)), "exports", "taken")


@query(f"WITH {D.ROWS}, first_rows AS (SELECT * FROM manifest_rows) SELECT 'raw/' || (event_id // 1000)::BIGINT || '.json' AS export_path, count(DISTINCT normalized_url) AS urls, sum(seen_count)::BIGINT AS seen, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM first_rows GROUP BY 1")
def export_contributions(spark, d):
    """What each export says, URL by URL, summed up."""
    kind = F.split_part("normalized_url", F.lit("/"), F.lit(5))
    first, _ = exports(spark, d)
    return first.groupBy("export_path").agg(F.count("*").alias("urls"), F.sum("seen_count").alias("seen"), F.array_join(F.array_sort(F.collect_set(F.regexp_replace(kind, "_.*", ""))), ",").alias("types"))


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    number = F.split_part("sample_id", F.lit(":"), F.lit(-1)).cast("long")
    samples = D.samples(spark, d)
    return samples.filter(number % 4 != 0), samples.filter(number % 4 == 0)


@query(f"{CLOSURE} SELECT sample_id, group_key FROM f")
def families_grown(spark, d):
    """A quarter of the samples comes later: what the families are is what it is for all at once."""
    old, new = _halves(spark, d)
    grown = families.grow(*families.with_stars(old), new)
    return grown.samples.select("sample_id", "group_key")


def _closure(source: str, n: int) -> str:
    """Families of a relation of samples in SQL, and their ids."""
    return f"""k{n} AS (SELECT DISTINCT 'sha:' || raw_sha AS a, 'pix:' || pixel_digest AS b FROM {source}), e{n} AS (SELECT a AS u, b AS v FROM k{n} UNION SELECT b, a FROM k{n}),
        c{n} AS (SELECT u AS root, u AS v FROM e{n} UNION SELECT c.root, e.v FROM c{n} c JOIN e{n} e ON c.v = e.u), comp{n} AS (SELECT root AS u, min(v) AS group_key FROM c{n} GROUP BY root),
        ids{n} AS (SELECT group_key, sha256(array_to_string(list_sort(list(DISTINCT u)), '|')) AS group_id FROM comp{n} GROUP BY group_key)"""


@query(f"""WITH RECURSIVE {D.SAMPLES}, first_samples AS (SELECT * FROM samples WHERE doc_id % 4 <> 0), {_closure('first_samples', 1)}, {_closure('samples', 2)}
    SELECT n.group_id, (['train', 'val', 'test'])[min(ascii(o.group_id) % 3) + 1] AS split, count(*) AS old_families FROM ids1 o JOIN comp2 c ON c.u = o.group_key JOIN ids2 n ON n.group_key = c.group_key GROUP BY n.group_id""")
def splits_handed_over(spark, d):
    """Families of the first three quarters have a split each; those that grew or met keep it."""
    old, new = _halves(spark, d)
    found, stars = families.with_stars(old)
    before = families.group_records(found)
    prior = before.select("group_id", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.ascii(F.substring("group_id", 1, 1)) % 3 + 1).alias("split"))
    grown = families.grow(found, stars, new)
    return families.hand_over(prior, before, families.group_records(grown.samples), grown.renamed)
