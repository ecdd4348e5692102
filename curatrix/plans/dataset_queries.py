"""Queries of families, splits, metrics and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.text import error_file_name
from curatrix.operators import families, metrics, samples, splits
from curatrix.plans import domain as D
from curatrix.plans.registry import query
from curatrix.shared import placed, table
from curatrix.sources.manifests import index_files, latest_run

#: Families in SQL: the closure over shared keys, by labels that go down until nothing changes.
CLOSURE = f"""WITH RECURSIVE {D.SAMPLES}, k AS (SELECT DISTINCT 'sha:' || raw_sha AS a, 'pix:' || pixel_digest AS b FROM samples),
    e AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k), c AS (SELECT u AS root, u AS v FROM e UNION SELECT c.root, e.v FROM c JOIN e ON c.v = e.u),
    comp AS (SELECT root AS u, min(v) AS group_key FROM c GROUP BY root), f AS (SELECT s.*, group_key FROM samples s JOIN comp ON comp.u = 'sha:' || raw_sha),
    keys AS (SELECT group_key, list_sort(list(DISTINCT u)) AS ks FROM comp GROUP BY group_key),
    g AS (SELECT sha256(array_to_string(ks, '|')) AS group_id, f.group_key, min(label) AS label, count(*) AS size, count(DISTINCT label) AS n_labels, bool_and(blind_eval_eligible) AS eligible, bool_and(source <> 'export') AS collection_only,
        arg_min(sample_id, (CASE label_tier WHEN 'gold' THEN 0 WHEN 'trusted' THEN 1 ELSE 2 END, CASE source WHEN 'export' THEN 0 ELSE 1 END, sample_id)) AS canonical FROM f JOIN keys ON f.group_key = keys.group_key GROUP BY f.group_key, ks)"""


@query(f"{CLOSURE} SELECT sample_id, group_key FROM f")
def duplicate_families(spark, d):
    return families.families(D.samples(spark, d)).select("sample_id", "group_key")


@query(f"{CLOSURE} SELECT group_id, label, size, n_labels, eligible, collection_only, canonical FROM g")
def family_records(spark, d):
    g = families.group_records(D.samples(spark, d))
    return g.select("group_id", "label", "size", "n_labels", "eligible", "collection_only", F.col("canonical.sample_id").alias("canonical"))


@query(f"{CLOSURE} SELECT f.group_key, sample_id, f.label FROM f JOIN g ON f.group_key = g.group_key WHERE n_labels > 1")
def label_conflicts(spark, d):
    return families.label_conflicts(D.samples(spark, d))


#: Families by number for the splits: a group is a document; collections' are every third.
GROUPS = "groups AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS group_id, CASE WHEN doc_id % 5 < 2 THEN 'positive' ELSE 'negative' END AS label, doc_id % 4 <> 0 AS eligible, doc_id % 3 = 0 AS collection_only, doc_id FROM documents)"


def _groups(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(D.sha(i).alias("group_id"), F.when(i % 5 < 2, "positive").otherwise("negative").alias("label"), (i % 4 != 0).alias("eligible"), (i % 3 == 0).alias("collection_only"), "doc_id")


HELD = "held AS (SELECT group_id, CASE WHEN r <= 64 THEN 'test' ELSE 'val' END AS split FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('collection-holdout:' || group_id), group_id) AS r FROM groups WHERE label = 'positive' AND collection_only) WHERE r <= 128)"


def _stratified(source: str, folds: int, seed: int, out: str) -> str:
    return f"{out} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('{seed}:' || group_id), group_id) <= ceil(count(*) OVER (PARTITION BY label) / least({folds}, (SELECT min(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY label)))) AS held_ FROM {source})"


@query(f"WITH {GROUPS}, {HELD} SELECT * FROM held")
def collection_holdout(spark, d):
    return splits.collection_holdout(_groups(spark, d))


@query(f"WITH {GROUPS}, {_stratified('groups', 7, 7, 's')} SELECT group_id, label, held_ AS held FROM s")
def stratified_holdout(spark, d):
    return splits.stratified_holdout(_groups(spark, d), 0.15, 7).select("group_id", "label", "held")


_REST = "rest AS (SELECT * FROM groups WHERE group_id NOT IN (SELECT group_id FROM held)), blocked AS (SELECT group_id FROM rest WHERE NOT eligible), open_ AS (SELECT * FROM rest WHERE eligible)"


@query(f"WITH {GROUPS}, {HELD}, {_REST}, {_stratified('open_', 7, 7, 'a')}, left_ AS (SELECT group_id, label FROM a WHERE NOT held_), {_stratified('left_', 6, 8, 'b')} SELECT group_id, split, 'holdout' AS reason FROM held UNION ALL SELECT group_id, 'train', 'train_only' FROM blocked UNION ALL SELECT group_id, 'test', 'new' FROM a WHERE held_ UNION ALL SELECT group_id, CASE WHEN held_ THEN 'val' ELSE 'train' END, 'new' FROM b")
def split_fresh(spark, d):
    return splits.assign_splits(_groups(spark, d))


@query(f"WITH {GROUPS}, {HELD}, {_REST}, prior AS (SELECT group_id, (['train', 'val', 'test'])[doc_id % 3 + 1] AS split FROM groups WHERE doc_id % 10 < 7), new_ AS (SELECT group_id, label FROM open_ WHERE group_id NOT IN (SELECT group_id FROM prior)), {_stratified('new_', 6, 8, 'b')} SELECT group_id, split, 'holdout' AS reason FROM held UNION ALL SELECT group_id, 'train', 'train_only' FROM blocked UNION ALL SELECT o.group_id, p.split, 'prior' FROM open_ o JOIN prior p ON o.group_id = p.group_id UNION ALL SELECT group_id, CASE WHEN held_ THEN 'val' ELSE 'train' END, 'new' FROM b")
def split_appended(spark, d):
    g = _groups(spark, d)
    prior = g.filter("doc_id % 10 < 7").select("group_id", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"))
    return splits.assign_splits(g, prior)


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 'positive') AS positives, count(*) FILTER (WHERE label = 'negative') AS negatives, count(*) FILTER (WHERE label_tier = 'gold') AS gold, count(*) FILTER (WHERE label_tier = 'trusted') AS trusted FROM entries GROUP BY split")
def split_summary(spark, d):
    return splits.split_summary(D.entries(spark, d))


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT id, 'train' AS split FROM entries WHERE split <> 'test' UNION ALL SELECT id, 'val' FROM entries WHERE split = 'test' UNION ALL SELECT id, 'test' FROM entries WHERE split = 'test'")
def refit_entries(spark, d):
    return splits.refit(D.entries(spark, d)).select("id", "split")


@query("SELECT p_partkey AS token_id FROM part ORDER BY sha256('s:' || p_partkey), p_partkey LIMIT 64")
def token_sample(spark, d):
    return splits.sample_tokens(table(spark, d, "part").select(F.col("p_partkey").alias("token_id")), 64, "s")


@query(f"WITH {D.IMAGES}, {GROUPS} SELECT i.sha256, CASE WHEN doc_id % 2 = 0 THEN 'val' END AS split, strftime(CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{D.NOW}' ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM images i JOIN groups ON group_id = sha256")
def split_write_back(spark, d):
    from curatrix.operators.catalog import set_splits

    members = _groups(spark, d).filter("doc_id % 2 = 0").select(F.col("group_id").alias("exported_sha"), F.lit("val").alias("split"))
    return set_splits(D.images(spark, d), members, D.at(D.NOW)).select("sha256", "split", D.said("updated_at").alias("updated_at"))


@query(f"WITH {D.IMAGES} SELECT sha256, label FROM images WHERE label IN ('positive', 'negative') AND local_path IS NOT NULL AND label_source IN ('manual', 'model')")
def trainable_labels(spark, d):
    return samples.trainable(D.images(spark, d)).select("sha256", "label")


@query(f"WITH {D.IMAGES} SELECT 'export:' || sha256 AS sample_id, label, 'export' AS source, CASE label_source WHEN 'manual' THEN 'gold' ELSE 'trusted' END AS label_tier, 1.0::DOUBLE AS sample_weight, label_source = 'manual' AS blind_eval_eligible FROM images WHERE label IN ('positive', 'negative') AND local_path IS NOT NULL UNION ALL SELECT 'collection:' || lower(p_brand) || ':' || p_partkey, 'positive', lower(p_brand), 'trusted', 0.5, false FROM part WHERE p_partkey % 7 <> 0")
def sample_projection(spark, d):
    images = D.images(spark, d)
    parts = table(spark, d, "part").select(F.lower("p_brand").alias("slug"), F.col("p_partkey").alias("token_id"), F.concat(F.lit("c/"), F.col("p_partkey").cast("string")).alias("local_path"))
    prints = images.select(F.col("local_path").alias("path"), F.col("sha256").alias("raw_sha"), F.col("sha256").alias("pixel_digest"), F.lit(True).alias("readable")).filter("path is not null")
    prints = prints.unionByName(parts.select(F.col("local_path").alias("path"), F.sha2("local_path", 256).alias("raw_sha"), F.sha2("local_path", 256).alias("pixel_digest"), (F.col("token_id") % 7 != 0).alias("readable")))
    return samples.samples(images, prints, parts).select("sample_id", "label", "source", "label_tier", "sample_weight", "blind_eval_eligible")


@query(f"{CLOSURE} SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM g) AS families, (SELECT count(*) FROM samples) - (SELECT count(*) FROM g) AS duplicates_removed, (SELECT count(*) FROM samples WHERE blind_eval_eligible) AS eligible_samples, (SELECT count(*) FROM g WHERE eligible) AS eligible_families")
def build_summary(spark, d):
    s = D.samples(spark, d)
    return samples.build_summary(s, families.group_records(s))


_CONFUSION = "sum((hit AND pos)::INT)::DOUBLE AS tp, sum((hit AND NOT pos)::INT)::DOUBLE AS fp, sum((NOT hit AND NOT pos)::INT)::DOUBLE AS tn, sum((NOT hit AND pos)::INT)::DOUBLE AS fn"
_P, _R = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
_RATES = f"round({_P}, 9) AS precision, round({_R}, 9) AS recall, round(CASE WHEN ({_P}) + ({_R}) > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0 END, 9) AS f1, round((tp + tn) / greatest(1, tp + fp + tn + fn), 9) AS accuracy"
_HITS = "h AS (SELECT *, score >= 0.6 AS hit, label = 'positive' AS pos FROM entries)"


def _rounded(df, keep):
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"WITH {D.SAMPLES}, {D.ENTRIES}, {_HITS}, c AS (SELECT {_CONFUSION} FROM h) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def confusion_metrics(spark, d):
    return _rounded(metrics.confusion(D.entries(spark, d), 0.6), ["tp", "fp", "tn", "fn"])


_CANDIDATES = "cand AS (SELECT DISTINCT score AS t FROM entries UNION SELECT 0.0 UNION SELECT 1.0), tab AS (SELECT t, count(*) FILTER (WHERE score >= t AND label = 'positive')::DOUBLE AS tp, count(*) FILTER (WHERE score >= t AND label <> 'positive')::DOUBLE AS fp, count(*) FILTER (WHERE score < t AND label <> 'positive')::DOUBLE AS tn, count(*) FILTER (WHERE score < t AND label = 'positive')::DOUBLE AS fn FROM cand, entries GROUP BY t)"


@query(f"WITH {D.SAMPLES}, {D.ENTRIES}, {_CANDIDATES} SELECT t AS threshold, tp, fp, tn, fn, {_RATES} FROM tab")
def threshold_table(spark, d):
    return _rounded(metrics.threshold_table(D.entries(spark, d)), ["threshold", "tp", "fp", "tn", "fn"])


def _choice(floor: float) -> str:
    f1 = f"CASE WHEN ({_P}) + ({_R}) > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0 END"
    return f"WITH {D.SAMPLES}, {D.ENTRIES}, {_CANDIDATES}, r AS (SELECT t, {_P} AS p, {_R} AS r, {f1} AS f FROM tab) SELECT t AS threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM r ORDER BY p >= {floor} DESC, CASE WHEN p >= {floor} THEN 0 ELSE p END DESC, r DESC, f DESC, t DESC LIMIT 1"


def _chosen(floor: float):
    def run(spark, d):
        best = metrics.choose_threshold(D.entries(spark, d), floor)
        return best.select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])

    return run


query(_choice(0.9), "threshold_choice")(_chosen(0.9))
query(_choice(0.999999), "threshold_choice_strict")(_chosen(0.999999))


@query(f"WITH {D.SAMPLES}, {D.ENTRIES}, {_HITS}, g AS (SELECT 'source' AS grouping_, source AS value_, * FROM h UNION ALL SELECT 'label_source', label_source, * FROM h UNION ALL SELECT 'label_tier', label_tier, * FROM h), c AS (SELECT grouping_, value_, count(*) AS count, {_CONFUSION} FROM g GROUP BY 1, 2) SELECT grouping_ AS grouping, value_ AS value, count, tp, fp, tn, fn, {_RATES} FROM c")
def diagnostics_by_group(spark, d):
    return _rounded(metrics.diagnostics(D.entries(spark, d), 0.6), ["grouping", "value", "count", "tp", "fp", "tn", "fn"])


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT source, count(*) AS count FROM entries GROUP BY source")
def count_by_source(spark, d):
    return metrics.count_by(D.entries(spark, d), "source")


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT round(sum(sample_weight) FILTER (WHERE label = 'negative') / greatest(1e-8, sum(sample_weight) FILTER (WHERE label = 'positive')), 9) AS positive_weight FROM entries")
def class_weights(spark, d):
    return metrics.class_weight(D.entries(spark, d)).select(F.round("positive_weight", 9).alias("positive_weight"))


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT split, round(sum(score * sample_weight) / greatest(1e-8, sum(sample_weight)), 9) AS loss FROM entries GROUP BY split")
def weighted_loss(spark, d):
    losses = metrics.weighted_loss(D.entries(spark, d).withColumn("loss", F.col("score")), ["split"])
    return losses.select("split", F.round("loss", 9).alias("loss"))


@query("SELECT l_shipdate_m AS epoch, round(sum(l_discount * l_quantity) / greatest(1, sum(l_quantity)), 9) AS loss FROM (SELECT *, month(l_shipdate)::BIGINT AS l_shipdate_m FROM lineitem) GROUP BY 1")
def epoch_loss(spark, d):
    batches = table(spark, d, "lineitem").select(F.month("l_shipdate").cast("long").alias("epoch"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("size"))
    return metrics.epoch_loss(batches).select("epoch", F.round("loss", 9).alias("loss"))


HISTORY = "h AS (SELECT p_partkey // 15 AS run_id, p_partkey % 15 + 1 AS epoch, CASE WHEN p_partkey % 15 < 3 THEN 'head' ELSE 'finetune' END AS phase, (p_partkey * 7 % 11) / 11.0::DOUBLE AS recall, (p_partkey * 5 % 13) / 13.0::DOUBLE AS f1 FROM part)"


@query(f"WITH {HISTORY}, b AS (SELECT *, coalesce((recall, f1) > max((recall, f1)) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM h), r AS (SELECT *, sum(better::INT) OVER (PARTITION BY run_id ORDER BY epoch) AS run_ FROM b), s AS (SELECT *, sum((phase = 'finetune' AND NOT better)::INT) OVER (PARTITION BY run_id, run_ ORDER BY epoch) AS stale FROM r), x AS (SELECT run_id, min(epoch) AS stop FROM s WHERE stale >= 3 GROUP BY run_id) SELECT s.run_id, arg_max(epoch, (recall, f1, -epoch)) AS best_epoch, max(stop) AS stop_epoch FROM s LEFT JOIN x ON s.run_id = x.run_id WHERE stop IS NULL OR epoch <= stop GROUP BY s.run_id")
def best_epoch(spark, d):
    k = F.col("p_partkey")
    history = table(spark, d, "part").select(F.floor(k / 15).alias("run_id"), (k % 15 + 1).alias("epoch"), F.when(k % 15 < 3, "head").otherwise("finetune").alias("phase"), (k * 7 % 11 / 11.0).alias("recall"), (k * 5 % 13 / 13.0).alias("f1"))
    return metrics.best_epoch(history)


def _run_rows(spark, d):
    l = table(spark, d, "lineitem")
    run = F.concat(F.lit("run-"), (F.col("l_orderkey") % 4).cast("string"))
    entries = l.select(run.alias("run_id"), (F.col("l_partkey") * 31 % 1000 / 1000.0).alias("score"), F.when(F.col("l_returnflag") == "R", "positive").otherwise("negative").alias("label"))
    return metrics.confusion(entries, 0.5, ["run_id"])


def _arrow(x: str, base: str) -> str:
    return f"CASE WHEN abs({x} - {base}) < 1e-9 THEN '=' WHEN {x} > {base} THEN '↑' || printf('%.4f', {x} - {base}) ELSE '↓' || printf('%.4f', {base} - {x}) END"


@query(f"""WITH h AS (SELECT 'run-' || (l_orderkey % 4) AS run_id, (l_partkey * 31 % 1000) / 1000.0::DOUBLE >= 0.5 AS hit, l_returnflag = 'R' AS pos FROM lineitem), c AS (SELECT run_id, {_CONFUSION} FROM h GROUP BY run_id), r AS (SELECT run_id, {_P} AS p, {_R} AS r, fp, fn FROM c), b AS (SELECT p AS bp, r AS br, fp AS bfp, fn AS bfn FROM r WHERE run_id = 'run-0')
    SELECT run_id, round(p, 9) AS precision, round(r, 9) AS recall, fp, fn, CASE WHEN fp = bfp THEN '=' WHEN fp > bfp THEN '↑' || (fp - bfp)::BIGINT ELSE '↓' || (bfp - fp)::BIGINT END AS fp_delta, CASE WHEN fn = bfn THEN '=' WHEN fn > bfn THEN '↑' || (fn - bfn)::BIGINT ELSE '↓' || (bfn - fn)::BIGINT END AS fn_delta,
    {_arrow('p', 'bp')} AS precision_delta, {_arrow('r', 'br')} AS recall_delta,
    CASE WHEN run_id = 'run-0' THEN 'baseline' WHEN p >= bp AND r >= br AND fp <= bfp AND fn <= bfn AND (p > bp OR r > br OR fp < bfp OR fn < bfn) THEN 'better' WHEN p <= bp AND r <= br AND fp >= bfp AND fn >= bfn AND (p < bp OR r < br OR fp > bfp OR fn > bfn) THEN 'worse' ELSE 'mixed' END AS verdict FROM r, b""")
def compare_runs(spark, d):
    c = metrics.compare_runs(_run_rows(spark, d), "run-0")
    return c.select("run_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "fp", "fn", "precision_delta", "recall_delta", "fp_delta", "fn_delta", "verdict")


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT row_number() OVER (ORDER BY score DESC, id) AS place, id, score, label, 'positive' AS predicted FROM entries WHERE score >= 0.6 AND label = 'negative'")
def false_positives(spark, d):
    found = metrics.errors(D.entries(spark, d), 0.6, "positive", "negative")
    return placed(found, metrics.error_order("positive")).select("place", "id", "score", "label", "predicted")


@query(f"WITH {D.SAMPLES}, {D.ENTRIES}, e AS (SELECT *, row_number() OVER (ORDER BY score, id) AS n FROM entries WHERE score < 0.6 AND label = 'positive') SELECT id, printf('%03d', n) || '__p' || printf('%.3f', score) || '__' || replace(id, ':', '__') || '.png' AS file_name FROM e")
def error_file_names(spark, d):
    """All false negatives as they are named in a report, the most certain first."""
    found = placed(metrics.errors(D.entries(spark, d), 0.6, "negative", "positive"), metrics.error_order("negative"))
    return found.select("id", error_file_name(F.col("place"), F.col("score"), F.col("id"), F.concat("path", F.lit(".PNG"))).alias("file_name"))


@query(f"WITH {D.SAMPLES}, {D.ENTRIES} SELECT 'blind' AS eval_set, id FROM entries WHERE split IN ('val', 'test') UNION ALL SELECT 'all-manual', id FROM entries WHERE source = 'export' AND label_source = 'manual' UNION ALL SELECT 'all-exported', id FROM entries WHERE source = 'export'")
def evaluation_sets(spark, d):
    e = D.entries(spark, d)
    out = None
    for name in ("blind", "all-manual", "all-exported"):
        rows = metrics.evaluation_entries(e, name).select(F.lit(name).alias("eval_set"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {D.IMAGES} SELECT strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS newest, CASE WHEN max(updated_at) > TIMESTAMP '2024-01-01 12:00:00' THEN 'labels changed after the manifest' ELSE '' END AS reasons, max(updated_at) <= TIMESTAMP '2024-01-01 12:00:00' AS fresh FROM images WHERE label IN ('positive', 'negative') AND local_path IS NOT NULL")
def freshness_check(spark, d):
    f = metrics.freshness(samples.trainable(D.images(spark, d)), D.at("2024-01-01 12:00:00"))
    return f.select(D.said("newest").alias("newest"), F.array_join("reasons", ",").alias("reasons"), "fresh")


@query("SELECT lower(p_brand) AS slug, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS ok, count(*) FILTER (WHERE p_partkey % 7 = 0) AS failed FROM part GROUP BY 1")
def collection_results(spark, d):
    k = F.col("p_partkey")
    return samples.collection_results(table(spark, d, "part").select(F.lower("p_brand").alias("slug"), F.when(k % 7 == 0, "status 404").alias("error")))


@query("SELECT p_size::BIGINT AS number, max('dir' || (p_partkey % 3) || '/' || p_size || '.png') AS path FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def file_index(spark, d):
    k = F.col("p_partkey")
    stem = F.when(k % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    return index_files(table(spark, d, "part").select(F.concat(F.lit("dir"), (k % 3).cast("string"), F.lit("/"), stem, F.lit(".png")).alias("path")))


@query("WITH f AS (SELECT 'run-' || o_custkey AS run_id, o_orderkey % 2 = 0 AS s, o_orderkey % 3 = 0 AS c, o_orderkey AS m FROM orders), r AS (SELECT run_id, max(m) AS m FROM f GROUP BY run_id HAVING bool_or(s) AND bool_or(c AND NOT s)) SELECT arg_max(run_id, (m, run_id)) AS run_id FROM r WHERE run_id <> 'run-1'")
def latest_run_id(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, "summary.json").when(k % 3 == 0, "best.pt").otherwise("x")
    files = table(spark, d, "orders").select(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"), name.alias("name"), k.alias("modified"))
    return latest_run(files, ["run-1"])


@query()
def embedding_scores(spark, d):
    """A model of the embeddings, scored on its own rows: no SQL, its quality is tested."""
    from curatrix.operators import model

    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, "positive").otherwise("negative").alias("label"), F.lit(1.0).alias("sample_weight"))
    return model.score(model.train(rows), rows, "vec_id")


@query("SELECT row_number() OVER (ORDER BY sha256('3:export:' || doc_id), doc_id)::BIGINT AS place, 'export:' || doc_id AS id FROM documents")
def training_order(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("export:"), F.col("doc_id").cast("string")).alias("id"))
    return splits.training_order(rows, 3).select("place", "id")
