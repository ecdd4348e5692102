"""Queries of the collector: in batches and, through the same functions, as streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatrix.operators import accounts
from curatrix.plans import domain as D
from curatrix.plans.registry import query
from curatrix.shared import placed, shared_folder, table
from curatrix.sources import manifests
from curatrix.sources.manifests import client_settings, client_stats
from curatrix.sources.manifests import matched_accounts as matched_account_rows
from curatrix.sources.manifests import whitelist_import as whitelist_import_

from curatrix.streaming import collector, requests
from curatrix.streaming import state as keyed
from curatrix.streaming.deltas import read_latest


def _source(spark, rows, order, files: int = 4, after: tuple = ()):
    """Rows as a stream of files in an order (a number), one a micro-batch, and a folder of its own; then a file of each of the
    rows that come after all. Files are written one after the other, as a stream takes them by their times."""
    path = f"{shared_folder(spark)}/curatrix/stream-{uuid.uuid4().hex}"
    numbered = rows.withColumn("__order", order.cast("double"))
    bounds = [float("-inf"), *numbered.approxQuantile("__order", [(i + 1) / files for i in range(files - 1)], 0.01), float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        numbered.filter((F.col("__order") > low) & (F.col("__order") <= high)).drop("__order").coalesce(1).write.mode("append").parquet(f"{path}/in")
    for late in after:
        late.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


def _streamed(spark, d, make, keep: list[str], keys: list[str]):
    """The final state of a stream over the events, which arrive in several micro-batches."""
    source = table(spark, d, "events")
    path = f"{shared_folder(spark)}/curatrix/stream-{uuid.uuid4().hex}"
    source.repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = make(D.sighting_events(stream))
    # Only keys that a micro-batch changes leave the aggregation, and only these are written.
    collector.keep_latest(out, f"{path}/out", keys, f"{path}/state").awaitTermination()
    return read_latest(spark, f"{path}/out", out.schema, keys).select(*keep)


URL_STATE = """SELECT normalized_url, arg_max(original_url, ts) AS original_url, array_to_string(list_sort(list(DISTINCT handle)), ',') AS handles, coalesce(array_to_string(list_sort(list(DISTINCT display_name) FILTER (WHERE display_name IS NOT NULL)), ','), '') AS display_names, array_to_string(list_sort(list(DISTINCT surface)), ',') AS source_surfaces, count(*) AS seen_count,
    arg_min(tweet_url, ts) FILTER (WHERE tweet_url <> '') AS example_tweet_url, bool_or(whitelisted) AS whitelisted FROM sightings GROUP BY normalized_url"""


def _urls(events):
    return collector.sightings_by_url(events).select("normalized_url", "original_url", D.joined("handles"), D.joined("display_names"), D.joined("source_surfaces"), "seen_count", "example_tweet_url", "whitelisted")


@query(f"WITH {D.SIGHTINGS} {URL_STATE}")
def sighting_state(spark, d):
    return _urls(D.sighting_events(table(spark, d, "events")))


@query(f"WITH {D.SIGHTINGS} {URL_STATE}")
def sighting_stream(spark, d):
    return _streamed(spark, d, _urls, ["normalized_url", "original_url", "handles", "display_names", "source_surfaces", "seen_count", "example_tweet_url", "whitelisted"], ["normalized_url"])


ACCOUNTS = "SELECT handle, arg_max(display_name, ts) FILTER (WHERE display_name IS NOT NULL) AS display_name, count(*) AS posts_matched FROM sightings WHERE matched AND NOT whitelisted GROUP BY handle"


@query(f"WITH {D.SIGHTINGS} {ACCOUNTS}")
def account_counters(spark, d):
    return collector.matched_accounts(D.sighting_events(table(spark, d, "events"))).select("handle", "display_name", "posts_matched")


@query(f"WITH {D.SIGHTINGS} {ACCOUNTS}")
def account_stream(spark, d):
    return _streamed(spark, d, collector.matched_accounts, ["handle", "display_name", "posts_matched"], ["handle"])


STATS = "SELECT count(*) AS tweets_scanned, count(normalized_url) AS avatars_checked, count(*) FILTER (WHERE score_source = 'cache') AS cache_hits, count(*) FILTER (WHERE matched AND NOT whitelisted) AS posts_matched, count(*) FILTER (WHERE matched AND NOT whitelisted AND score_source = 'model') AS model_matches, count(*) FILTER (WHERE score_source = 'error') AS errors FROM sightings"
STAT_NAMES = ["tweets_scanned", "avatars_checked", "cache_hits", "posts_matched", "model_matches", "errors"]


@query(f"WITH {D.SIGHTINGS} {STATS}")
def detection_stats(spark, d):
    return collector.detection_stats(D.sighting_events(table(spark, d, "events"))).select(*STAT_NAMES)


@query(f"WITH {D.SIGHTINGS} {STATS}")
def detection_stats_stream(spark, d):
    return _streamed(spark, d, collector.detection_stats, STAT_NAMES, [])


@query(f"WITH {D.SIGHTINGS} SELECT normalized_url, count(*) - 1 AS hits FROM sightings GROUP BY 1")
def score_cache_hits(spark, d):
    return collector.cache_hits(D.sighting_events(table(spark, d, "events")))


@query(f"WITH {D.SIGHTINGS} SELECT handle, s.normalized_url, score, score IS NULL AS score_error, count(*) AS n FROM sightings s LEFT JOIN (SELECT DISTINCT 'https://img.example/' || user_id || '_400x400.jpg' AS normalized_url, user_id / 150.0::DOUBLE AS score FROM events WHERE user_id % 3 = 0) x ON s.normalized_url = x.normalized_url GROUP BY ALL")
def memoised_scores(spark, d):
    events = table(spark, d, "events")
    scores = events.filter("user_id % 3 = 0").select(F.concat(F.lit("https://img.example/"), F.col("user_id").cast("string"), F.lit("_400x400.jpg")).alias("normalized_url"), (F.col("user_id") / 150.0).alias("score")).distinct()
    return collector.memoised_scores(D.sighting_events(events), scores).groupBy("handle", "normalized_url", "score", "score_error").agg(F.count("*").alias("n"))


@query(f"WITH {D.SIGHTINGS} SELECT handle, normalized_url, max((ts, original_url))[2] AS original_url FROM sightings GROUP BY 1, 2")
def notification_dedupe(spark, d):
    return collector.notification_entries(D.sighting_events(table(spark, d, "events"))).select("handle", "normalized_url", "original_url")


@query(f"WITH {D.SIGHTINGS} SELECT element, signature, count(*) AS n FROM (SELECT *, lag(signature) OVER (PARTITION BY element ORDER BY ts) AS b FROM sightings) WHERE b IS DISTINCT FROM signature GROUP BY 1, 2")
def changed_elements(spark, d):
    """By the stream that keeps each element's last signature, over two micro-batches."""
    stream, path = _source(spark, table(spark, d, "events"), F.col("event_id"), 2)
    out = collector.changed_elements(D.sighting_events(stream).select("element", "signature", "ts"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").groupBy("element", "signature").agg(F.count("*").alias("n"))


LISTED = "w AS (SELECT 'user' || (c_custkey * 7) AS handle FROM customer WHERE c_custkey < 14)"


def _whitelist(spark, d):
    return table(spark, d, "customer").filter("c_custkey < 14").select(F.concat(F.lit("user"), (F.col("c_custkey") * 7).cast("string")).alias("handle"))


@query(f"WITH {D.SIGHTINGS}, {LISTED}, a AS ({ACCOUNTS}) SELECT handle, posts_matched FROM a WHERE handle IN (SELECT handle FROM w)")
def exempt_accounts(spark, d):
    return accounts.exempt_accounts(collector.matched_accounts(D.sighting_events(table(spark, d, "events"))), _whitelist(spark, d)).select("handle", "posts_matched")


@query(f"WITH {D.SIGHTINGS}, {LISTED}, a AS ({ACCOUNTS}) SELECT handle, posts_matched FROM a WHERE handle NOT IN (SELECT handle FROM w)")
def caught_accounts(spark, d):
    return accounts.caught_accounts(collector.matched_accounts(D.sighting_events(table(spark, d, "events"))), _whitelist(spark, d)).select("handle", "posts_matched")


@query(f"WITH {D.SIGHTINGS}, a AS ({ACCOUNTS}) SELECT row_number() OVER (ORDER BY posts_matched DESC, handle) AS place, handle, display_name, posts_matched FROM a WHERE contains(lower(handle), 'user1') OR contains(lower(display_name), 'user1')")
def account_search(spark, d):
    found = collector.matched_accounts(D.sighting_events(table(spark, d, "events"))).filter(accounts.matches_search(" USER1 "))
    return placed(found, accounts.account_order()).select("place", "handle", "display_name", "posts_matched")


@query(f"WITH {D.SIGHTINGS}, x AS (SELECT surface, count(*) AS seen, count(*) FILTER (WHERE matched AND user_id_ok) AS hit FROM (SELECT *, NOT whitelisted AS user_id_ok FROM sightings) GROUP BY surface) SELECT surface, CASE WHEN 100.0::DOUBLE * hit / seen >= 10 THEN printf('%.1f%%', 100.0::DOUBLE * hit / seen) ELSE printf('%.2f%%', 100.0::DOUBLE * hit / seen) END AS rate FROM x")
def match_rates(spark, d):
    e = D.sighting_events(table(spark, d, "events")).groupBy("surface").agg(F.count("*").alias("seen"), F.count_if(F.col("matched") & ~F.col("whitelisted")).alias("hit"))
    return e.select("surface", accounts.match_rate(F.col("hit"), F.col("seen")).alias("rate"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT lower(c_mktsegment))), ',') AS handles FROM customer GROUP BY c_nationkey")
def whitelist_import(spark, d):
    """Lists as they are imported: an array, or an object for odd nations."""
    handles = F.collect_set(F.concat(F.lit("@"), F.col("c_mktsegment")))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(handles.alias("h"))
    text = F.when(F.col("c_nationkey") % 2 == 0, F.to_json("h")).otherwise(F.to_json(F.struct(F.col("h").alias("whitelist_handles"))))
    return rows.select("c_nationkey", F.array_join(whitelist_import_(text), ",").alias("handles"))


@query("SELECT user_id, 'user' || user_id AS handle, count(*) AS posts_matched, '1970-01-01T00:00:00.000Z' AS last_matched_at FROM events WHERE event_type = 'click' GROUP BY user_id")
def client_state(spark, d):
    """Stored account maps with missing and broken fields."""
    clicks = table(spark, d, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    key = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    value = F.to_json(F.struct(F.lit("").alias("handle"), F.col("n").cast("string").alias("postsMatched")))
    rows = matched_account_rows(clicks.select(F.create_map(key, value).alias("accounts")))
    return rows.select(F.substring("handle", 5, 20).cast("long").alias("user_id"), "handle", "posts_matched", "last_matched_at")


@query("SELECT event_id, greatest(0, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS scanned, CASE WHEN event_id % 5 = 0 THEN 'fade' ELSE 'hide' END AS mode FROM events")
def client_defaults(spark, d):
    e = F.col("event_id")
    stats = F.to_json(F.struct(F.when(e % 3 == 0, e.cast("string")).otherwise("x").alias("tweetsScanned")))
    mode = F.to_json(F.struct(F.when(e % 5 == 0, "fade").otherwise("?").alias("mode")))
    return table(spark, d, "events").select("event_id", client_stats(stats)["tweetsScanned"].alias("scanned"), client_settings(mode)["mode"].alias("mode"))


@query("SELECT p_partkey, (p_partkey % 4 + 1) * 32 AS input_size, 3 AS channels, p_partkey % 2 AS positive_index, p_size / 100.0::DOUBLE AS mean_first FROM part")
def model_runtime_config(spark, d):
    """A model's metadata document for each part, and the fields that a scorer reads of it."""
    k, mean = F.col("p_partkey"), F.array(F.col("p_size") / 100.0, F.lit(0.5), F.lit(0.5))
    text = F.to_json(F.struct(F.lit("net").alias("architecture"), ((k % 4 + 1) * 32).alias("input_size"), F.lit(3).alias("channels"), mean.alias("mean"), F.array(*[F.lit(0.5)] * 3).alias("std"), (k % 2).alias("positive_index"), F.lit(0.5).alias("threshold")))
    rows = table(spark, d, "part").select(k, manifests.runtime_config(text).alias("c"))
    return rows.select("p_partkey", F.col("c.input_size").cast("long").alias("input_size"), "c.channels", F.col("c.positive_index").cast("long").alias("positive_index"), F.element_at("c.mean", 1).alias("mean_first"))


@query("SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN '{\"version\":1,\"exported_at\":\"2024-01-01T00:00:00Z\",\"whitelist_handles\":[\"alt' || (user_id % 5) || '\",\"user' || user_id || '\"]}' END AS payload FROM (SELECT DISTINCT user_id FROM events)")
def whitelist_documents(spark, d):
    u = F.col("user_id")
    handles = F.when(u % 10 != 0, F.array(F.concat(F.lit("@User"), u.cast("string")), F.concat(F.lit("alt"), (u % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("user_id").distinct().select(u, manifests.whitelist_export(handles, F.lit("2024-01-01T00:00:00Z")).alias("payload"))


def _kept(spark, d):
    """The three maps after a stream of all events, from keyed state."""
    stream, path = _source(spark, table(spark, d, "events"), F.col("event_id"), 2)
    keyed.flush(keyed.maps(D.sighting_events(stream), None), f"{path}/out", f"{path}/state").awaitTermination()
    return keyed.read_maps(spark, f"{path}/out")


@query(f"WITH {D.SIGHTINGS}, u AS ({URL_STATE}), a AS ({ACCOUNTS}), s AS ({STATS}) SELECT 'avatar' AS kind, normalized_url AS key, original_url AS text, handles || '|' || display_names || '|' || source_surfaces || '|' || whitelisted || '|' || coalesce(example_tweet_url, '') AS more, seen_count AS n FROM u UNION ALL SELECT 'account', handle, display_name, '', posts_matched FROM a UNION ALL SELECT 'stats', NULL, NULL, concat_ws('|', avatars_checked, cache_hits, posts_matched, model_matches, errors), tweets_scanned FROM s")
def collector_maps(spark, d):
    """All three maps by the stateful processor, in one stream and written together."""
    state = _kept(spark, d)
    more = F.concat_ws("|", *[F.array_join(c, ",") for c in keyed.LISTS], F.col("whitelisted").cast("string"), F.coalesce("example_tweet_url", F.lit("")))
    avatars = keyed.avatars(state).select(F.lit("avatar").alias("kind"), F.col("normalized_url").alias("key"), F.col("original_url").alias("text"), more.alias("more"), F.col("seen_count").alias("n"))
    accounts_ = keyed.accounts(state).select(F.lit("account").alias("kind"), F.col("handle").alias("key"), F.col("display_name").alias("text"), F.lit("").alias("more"), F.col("posts_matched").alias("n"))
    counts = F.concat_ws("|", *[F.col(c).cast("string") for c in STAT_NAMES[1:]])
    stats = keyed.stats(state).select(F.lit("stats").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), counts.alias("more"), F.col("tweets_scanned").alias("n"))
    return avatars.unionByName(accounts_).unionByName(stats)


REVEALED = "SELECT element, event_id, normalized_url, matched, coalesce(matched AND state = normalized_url, false) AS revealed FROM (SELECT *, last_value(change IGNORE NULLS) OVER (PARTITION BY element ORDER BY ts, event_id) AS state FROM (SELECT element, event_id, ts, normalized_url, event_type <> 'view' AS matched, event_type = 'purchase' AS reveal, CASE WHEN event_type = 'purchase' THEN normalized_url WHEN event_type = 'view' THEN '' END AS change FROM (SELECT s.*, surface AS event_type FROM sightings s))) WHERE NOT reveal"


@query(f"WITH {D.SIGHTINGS}, r AS ({REVEALED}) SELECT event_id, revealed, CASE WHEN NOT matched OR revealed THEN 'show' ELSE 'hide' END AS decision FROM r")
def revealed_posts(spark, d):
    """Purchases stand for clicks that reveal an element's post, views for posts that do not match; all others are hidden."""
    stream, path = _source(spark, table(spark, d, "events"), F.col("event_id"), 2)
    kind = F.col("event_type")
    posts = D.sighting_events(stream.withColumn("id", F.col("event_id"))).select("element", "ts", "normalized_url", F.col("surface").alias("event_type"), F.regexp_extract("original_url", "e=(.*)", 1).cast("long").alias("event_id"))
    out = keyed.reveals(posts.withColumn("matched", kind != "view").withColumn("reveal", kind == "purchase"))
    decided = out.select("event_id", "revealed", accounts.mode_decision(F.lit("hide"), F.col("matched"), F.lit(False), F.col("revealed")).alias("decision"))
    keyed.with_state_store(spark, lambda: decided.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()).awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{path}/out")


ASKED = """requests AS (SELECT event_id AS id, ts AS asked_at FROM events), answers AS (SELECT event_id AS id, ts + to_seconds(event_id * 7 % 90) AS answered_at, CASE WHEN event_id % 13 <> 0 THEN user_id / 200.0::DOUBLE END AS score,
    CASE WHEN event_type = 'error' THEN 'model failed' END AS error FROM events WHERE event_id % 5 <> 0)"""


@query(f"""WITH {ASKED} SELECT r.id, CASE WHEN a.error IS NULL THEN score END AS score, CASE WHEN a.id IS NULL THEN '{requests.TIMED_OUT}' ELSE coalesce(a.error, CASE WHEN score IS NULL THEN '{requests.NO_SCORE}' END) END AS error
    FROM requests r LEFT JOIN answers a ON r.id = a.id AND answered_at BETWEEN asked_at AND asked_at + INTERVAL 60 SECONDS""")
def scored_requests(spark, d):
    """Events ask for a score; a fifth gets no answer, a third a late one, some an error, and some two answers."""
    events = table(spark, d, "events")
    # Two rows after all others move both watermarks on, past the last event and then through what comes before the join.
    end = [events.agg((F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {i} HOUR")).alias("end")) for i in (1, 2)]
    asked = events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("asked_at"))
    after = F.make_dt_interval(secs=(F.col("event_id") * 7 % 90).cast("decimal(18,6)"))
    answers = events.filter("event_id % 5 <> 0").select(
        F.col("event_id").alias("id"), (F.col("ts").cast("timestamp") + after).alias("answered_at"), F.when(F.col("event_id") % 13 != 0, F.col("user_id") / 200.0).alias("score"), F.when(F.col("event_type") == "error", "model failed").alias("error")
    )
    answers = answers.unionByName(answers.filter("id % 7 = 0").withColumn("answered_at", F.col("answered_at") + F.expr("INTERVAL 1 SECOND")))
    asked_stream, path = _source(spark, asked, F.unix_micros("asked_at"), after=tuple(e.select(F.lit(-1).cast("long").alias("id"), F.col("end").alias("asked_at")) for e in end))
    last = tuple(e.select(F.lit(-2).cast("long").alias("id"), F.col("end").alias("answered_at"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error")) for e in end)
    answer_stream, _ = _source(spark, answers, F.unix_micros("answered_at"), after=last)
    out = requests.outcomes(asked_stream, answer_stream).select("id", "score", "error")
    running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    running.processAllAvailable()  # with the batches without rows in which time is up
    running.stop()
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("id >= 0")  # a filter before would keep those rows from the watermark
