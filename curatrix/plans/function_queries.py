"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import image, text
from curatrix.plans.registry import query
from curatrix.shared import table

URLS = "['https://pbs.example/' || user_id || '/a_normal.jpg?foo=bar', 'https://pbs.example/' || user_id || '/b_BIGGER.PNG', 'https://pbs.example/' || user_id || '/c_x96.jpeg', 'https://pbs.example/' || user_id || '/d_200x200.webp?x=1', 'https://pbs.example/' || user_id || '/e.jpg']"


@query(f"""SELECT event_id, regexp_replace(regexp_replace(url, '\\?[^#]*', ''), '_(normal|bigger|mini|reasonably_small|[0-9]+x[0-9]+|x[0-9]+)(\\.[A-Za-z0-9]+)$', '_400x400\\2', 'i') AS normalized,
    regexp_replace(url, '_(normal|bigger|mini|reasonably_small|[0-9]+x[0-9]+|x[0-9]+)(\\.[A-Za-z0-9]+)$', '_400x400\\2', 'i') AS kept_query FROM (SELECT event_id, ({URLS})[event_id % 5 + 1] AS url FROM events)""")
def url_normalize(spark, d):
    u = F.concat(F.lit("https://pbs.example/"), F.col("user_id").cast("string"))
    urls = F.array(*[F.concat(u, F.lit(x)) for x in ("/a_normal.jpg?foo=bar", "/b_BIGGER.PNG", "/c_x96.jpeg", "/d_200x200.webp?x=1", "/e.jpg")])
    url = F.element_at(urls, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.normalize_image_url(url).alias("normalized"), text.normalize_image_url_keeping_query(url).alias("kept_query"))


@query("""SELECT c_custkey, lower(regexp_replace(regexp_replace(regexp_replace(h, '^\\s+|\\s+$', '', 'g'), '^/+', ''), '^@+', '')) AS handle FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' @' || c_name || ' ' WHEN 1 THEN '//@' || c_name WHEN 2 THEN c_name ELSE '' END AS h FROM customer)""")
def handle_normalize(spark, d):
    k, n = F.col("c_custkey"), F.col("c_name")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" @"), n, F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("//@"), n)).when(k % 4 == 2, n)
    return table(spark, d, "customer").select("c_custkey", text.normalize_handle(raw).alias("handle"))


@query("""SELECT c_nationkey, array_to_string(list_sort(list_distinct(list_filter(flatten(list([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' || (c_custkey % 4) END])), lambda x: x <> ''))), ',') AS merged FROM customer GROUP BY c_nationkey""")
def merge_string_lists(spark, d):
    lists = F.array("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("x"), (F.col("c_custkey") % 4).cast("string"))))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(text.merge_lists(F.flatten(F.collect_set(lists))), ",").alias("merged"))


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '["' || event_type || '","' || (event_id % 3) || '"]' AS encoded, len([event_type, CAST(event_id % 3 AS VARCHAR)])::BIGINT AS n FROM events""")
def json_lists(spark, d):
    encoded = text.encode_list(F.array("event_type", (F.col("event_id") % 3).cast("string")))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), encoded.alias("encoded"), F.size(text.decode_list(encoded)).cast("long").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS latest, CASE WHEN p_partkey % 5 = 0 THEN 'positive' WHEN p_partkey % 5 = 1 THEN 'unclear' END AS label, sha256(p_name) AS name_sha, substr(sha256(p_name), 1, 2) AS shard FROM part""")
def coalesce_and_domains(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, "positive").when(k % 5 == 1, "unclear").when(k % 5 == 2, "other")
    sha = text.sha256_hex(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.latest(F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, ""), F.col("p_type")).alias("latest"), text.known_label(label).alias("label"), sha.alias("name_sha"), text.cache_shard(sha).alias("shard"))


@query("""SELECT o_orderkey, strftime(a, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(least(a, b), '%Y-%m-%d %H:%M:%S') AS first_, strftime(greatest(a, b), '%Y-%m-%d %H:%M:%S') AS last_, strftime(a, '%Y%m%dT%H%M%SZ') AS stamp, replace(replace(strftime(a, '%Y-%m-%dT%H:%M:%S') || '.000Z', ':', '-'), '.', '-') AS file_stamp
    FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS a, o_orderdate + INTERVAL 1 HOUR AS b FROM orders)""")
def timestamps(spark, d):
    a = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    iso = F.concat(F.date_format(a, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    forms = F.when(F.col("o_orderkey") % 3 == 0, iso).when(F.col("o_orderkey") % 3 == 1, F.date_format(a, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format(a, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    parsed, other, now = text.parse_time(forms), F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR"), F.lit("2020-01-01").cast("timestamp")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", show(parsed).alias("parsed"), show(text.earliest_time(parsed, other, now)).alias("first_"), show(text.latest_time(parsed, other, now)).alias("last_"), text.run_stamp(parsed).alias("stamp"), text.file_stamp(iso).alias("file_stamp"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.webp' WHEN 2 THEN '.png' ELSE '.img' END AS extension FROM part""")
def extension_guess(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "image/jpeg; charset=x").when(k % 4 == 1, "image/webp").when(k % 4 == 2, "application/x-none")
    url = F.when(k % 4 == 2, "https://a.example/x/y.png?z=1").otherwise("https://a.example/x/y")
    return table(spark, d, "part").select("p_partkey", text.guess_extension(kind, url).alias("extension"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://ipfs.io/ipfs/Qm' || p_partkey || '|https://cloudflare-ipfs.com/ipfs/Qm' || p_partkey || '|https://dweb.link/ipfs/Qm' || p_partkey || '|https://nftstorage.link/ipfs/Qm' || p_partkey WHEN p_partkey % 3 = 1 THEN 'https://img.example/' || p_partkey || '.png' ELSE 'https://i2c.seadn.io/ethereum/0xab/' || p_partkey || '.png&x' END AS urls FROM part""")
def url_resolution(spark, d):
    k = F.col("p_partkey")
    s = k.cast("string")
    templates = F.when(k % 3 == 0, F.array(F.lit("ipfs://Qm{token_id}"))).otherwise(F.array().cast("array<string>"))
    metadata = F.when(k % 3 == 1, F.concat(F.lit('{"image": "https://img.example/'), s, F.lit('.png", "attributes": [1]}')))
    page = F.concat(F.lit('<img src="https://i2c.seadn.io/ethereum/0xab/'), s, F.lit('.png&amp;x">'))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.resolve_urls(templates, metadata, page, k, "0xAB"), "|").alias("urls"))


@query("""SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS href, CASE WHEN regexp_extract(html, 'href="([^"]*)"', 1) LIKE '/%' THEN 'https://site.example' || regexp_extract(html, 'href="([^"]*)"', 1) ELSE NULL END AS absolute,
    replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages""")
def href_extract(spark, d):
    href = F.regexp_extract("html", 'href="([^"]*)"', 1)
    absolute = F.when(href.startswith("/"), text.absolute_url(href, "https://site.example/a/b"))
    return table(spark, d, "pages").select("page_id", href.alias("href"), absolute.alias("absolute"), text.unescape_entities(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm' || lpad((n % 60)::VARCHAR, 2, '0') || 's' ELSE (n // 3600) || 'h' || lpad((n % 3600 // 60)::VARCHAR, 2, '0') || 'm' || lpad((n % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM (SELECT o_orderkey, CAST(o_orderkey * 7 % 9000 AS BIGINT) AS n FROM orders)""")
def durations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.format_duration(F.col("o_orderkey") * 7 % 9000 + 0.25).alias("duration"))


@query("""SELECT event_id, CASE WHEN n = 0 THEN 'now' WHEN n = 1 THEN 'in 1 second' WHEN n < 60 THEN 'in ' || n || ' seconds' WHEN n < 3600 THEN 'in ' || floor(n / 60 + 0.5)::BIGINT || CASE WHEN floor(n / 60 + 0.5) = 1 THEN ' minute' ELSE ' minutes' END
    WHEN n < 86400 THEN 'in ' || floor(n / 3600 + 0.5)::BIGINT || CASE WHEN floor(n / 3600 + 0.5) = 1 THEN ' hour' ELSE ' hours' END ELSE CASE WHEN floor(n / 86400 + 0.5) = 1 THEN 'tomorrow' ELSE 'in ' || floor(n / 86400 + 0.5)::BIGINT || ' days' END END AS said FROM (SELECT event_id, event_id * 37 % 300000 AS n FROM events)""")
def relative_times(spark, d):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", text.relative_time(F.timestamp_seconds(F.unix_timestamp(now) + F.col("event_id") * 37 % 300000), now).alias("said"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE printf('%.3f', (doc_id % 1000) / 1000.0::DOUBLE) END AS label, greatest(0, least(100, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id % 1000) / 1000.0::DOUBLE END * 100))::DOUBLE AS percent, 'Name ' || doc_id AS name_, CASE WHEN doc_id % 2 = 0 THEN doc_id::DOUBLE ELSE 0.0 END AS number_,
    CASE WHEN doc_id % 4 = 0 THEN 'fade' ELSE 'hide' END AS mode, CASE WHEN doc_id % 2 = 0 THEN '/abs' ELSE '/root/x/rel' END AS path FROM documents""")
def display_values(spark, d):
    i = F.col("doc_id")
    score = F.when(i % 3 != 0, i % 1000 / 1000.0)
    spans = F.array(F.lit(" "), F.lit("@h"), F.lit("·"), F.concat(F.lit(" Name "), i.cast("string"), F.lit(" ")), F.lit("x"))
    return table(spark, d, "documents").select(
        "doc_id", text.score_label(score).alias("label"), text.score_percent(score).alias("percent"), text.display_name(spans).alias("name_"), text.read_number(F.when(i % 2 == 0, i.cast("string")).otherwise("x")).alias("number_"),
        text.filter_mode(F.when(i % 4 == 0, "fade").otherwise("other")).alias("mode"), text.resolve_path(F.when(i % 2 == 0, "/abs").otherwise("rel"), "/root/x").alias("path"),
    )


@query("""SELECT doc_id, CASE WHEN w / h > 1.0 THEN floor((w - cw) / 2 + 0.5)::INT ELSE 0 END AS left_, CASE WHEN w / h > 1.0 OR variant = 'top' THEN 0 ELSE floor((h - ch) / 2 + 0.5)::INT END AS top_, cw::INT AS width, ch::INT AS height, variant FROM (
    SELECT *, CASE WHEN w / h > 1.0 THEN greatest(1, least(w, floor(h * 1.0 + 0.5))) ELSE w END AS cw, CASE WHEN w / h > 1.0 THEN h ELSE greatest(1, least(h, floor(w / 1.0 + 0.5))) END AS ch FROM (SELECT doc_id, (n_chars % 500 + 1)::DOUBLE AS w, (n_chars % 300 + 1)::DOUBLE AS h, CASE WHEN source IN ('src0', 'src1') THEN 'top' ELSE 'center' END AS variant FROM documents))""")
def cover_crop(spark, d):
    w, h = F.col("n_chars") % 500 + 1, F.col("n_chars") % 300 + 1
    variant = image.crop_variant(F.col("source"), ("src0", "src1"))
    crop = image.cover_crop(w.cast("double"), h.cast("double"), F.lit(128.0), F.lit(128.0), variant)
    return table(spark, d, "documents").select("doc_id", crop.alias("c"), variant.alias("variant")).select("doc_id", F.col("c.left").alias("left_"), F.col("c.top").alias("top_"), "c.width", "c.height", "variant")


@query("""SELECT doc_id, round((doc_id % 256 / 255.0::DOUBLE - 0.5) / 0.5, 6) AS red, round((n_chars % 256 / 255.0::DOUBLE - 0.5) / 0.25, 6) AS green, round((0 / 255.0::DOUBLE - 0.5) / 0.5, 6) AS blue, 6::BIGINT AS n FROM documents""")
def tensor_normalize(spark, d):
    rgb = F.array(*[x.cast("double") for x in (F.col("doc_id") % 256, F.col("n_chars") % 256, F.lit(0))] * 2)
    tensor = image.planar_tensor(rgb, F.array(*[F.lit(0.5)] * 3), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.5)))
    return table(spark, d, "documents").select("doc_id", tensor.alias("t")).select("doc_id", F.round(F.element_at("t", 1), 6).alias("red"), F.round(F.element_at("t", 3), 6).alias("green"), F.round(F.element_at("t", 6), 6).alias("blue"), F.size("t").cast("long").alias("n"))


@query("""SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS probability FROM (SELECT vec_id, embedding[1]::DOUBLE * 4 AS a, embedding[2]::DOUBLE * 4 AS b FROM embeddings)""")
def softmax_score(spark, d):
    logits = F.array(F.element_at("embedding", 1).cast("double") * 4, F.element_at("embedding", 2).cast("double") * 4)
    return table(spark, d, "embeddings").select("vec_id", F.round(image.positive_probability(logits), 6).alias("probability"))
