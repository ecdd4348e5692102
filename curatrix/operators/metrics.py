"""Confusion metrics, threshold choice, diagnostics and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.shared import running_sums

NO_ROWS_THRESHOLD = 0.995


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), ((tp + tn) / F.greatest(F.lit(1.0), tp + fp + tn + fn)).alias("accuracy")]


def _sums(threshold: Column) -> list[Column]:
    hit, true = F.col("score") >= threshold, F.col("label") == "positive"
    of = lambda c: F.coalesce(F.sum(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return [of(hit & true).alias("tp"), of(hit & ~true).alias("fp"), of(~hit & ~true).alias("tn"), of(~hit & true).alias("fn")]


def confusion(entries: DataFrame, threshold: float | Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn (as doubles) and the rates of entries (score, label), in all or by columns. 0 / 0 is 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    sums = (entries.groupBy(*by) if by else entries.groupBy()).agg(*_sums(t))
    return sums.select(*(by or []), "tp", "fp", "tn", "fn", *rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def threshold_table(entries: DataFrame) -> DataFrame:
    """For each candidate (0, 1 and every score) the counts and rates of score >= candidate, in one pass: equal scores are
    added up before the running sums, so what is sorted is distinct scores."""
    spark = entries.sparkSession
    by_score = entries.groupBy(F.col("score").alias("threshold")).agg(F.sum(F.when(F.col("label") == "positive", 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == "positive", 0).otherwise(1)).alias("n"))
    ends = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, p long, n long")
    merged = by_score.unionByName(ends).groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = running_sums(merged, [F.desc("threshold")], ["p", "n"])
    c = sums.select("threshold", F.col("running_p").cast("double").alias("tp"), F.col("running_n").cast("double").alias("fp"), F.col("total_p").alias("all_p"), F.col("total_n").alias("all_n"))
    c = c.select("threshold", "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn"))
    return c.select("threshold", "tp", "fp", "tn", "fn", *rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def choose_threshold(entries: DataFrame, floor: float = 0.995) -> DataFrame:
    """One row, threshold and its rates: the best recall, then F1, then threshold among candidates with enough precision;
    without any the best precision, recall, F1 and threshold. Without entries NO_ROWS_THRESHOLD."""
    table = threshold_table(entries).withColumn("meets", F.col("precision") >= floor)
    key = F.struct("meets", F.when(F.col("meets"), F.lit(0.0)).otherwise(F.col("precision")), "recall", "f1", "threshold")
    best = table.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), key).alias("b"), F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("rows"))
    some = F.col("rows") > 0
    return best.select(F.when(some, F.col("b.threshold")).otherwise(F.lit(NO_ROWS_THRESHOLD)).alias("threshold"), *[F.when(some, F.col(f"b.{c}")).otherwise(F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


GROUPINGS = ("source", "label_source", "label_tier")


def diagnostics(entries: DataFrame, threshold: float) -> DataFrame:
    """Count and metrics by source, by label_source and by label_tier, in one pass over grouping sets."""
    sets = entries.groupingSets([[c] for c in GROUPINGS], *GROUPINGS).agg(F.grouping_id().alias("__g"), F.count("*").alias("count"), *_sums(F.lit(threshold)))
    # The columns that are not grouped set their bits, the first column the highest.
    name = F.when(F.col("__g") == 3, "source").when(F.col("__g") == 5, "label_source").otherwise("label_tier")
    value = F.when(F.col("__g") == 3, F.col("source")).when(F.col("__g") == 5, F.col("label_source")).otherwise(F.col("label_tier"))
    return sets.select(name.alias("grouping"), value.alias("value"), "count", "tp", "fp", "tn", "fn", *rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def diagnostics_maps(entries: DataFrame, threshold: float) -> DataFrame:
    """The same as one map for each grouping, as a run summary holds it."""
    row = F.struct("value", F.struct("count", "precision", "recall", "f1"))
    return diagnostics(entries, threshold).groupBy("grouping").agg(F.map_from_entries(F.sort_array(F.collect_list(row))).alias("metrics"))


def count_by(entries: DataFrame, column: str) -> DataFrame:
    return entries.groupBy(column).agg(F.count("*").alias("count")).orderBy(column)


def class_weight(entries: DataFrame) -> DataFrame:
    """The positives' weight: the weight of negatives over that of positives."""
    of = lambda v: F.coalesce(F.sum(F.when(F.col("label") == v, F.col("sample_weight"))), F.lit(0.0))
    return entries.agg((of("negative") / F.greatest(F.lit(1e-8), of("positive"))).alias("positive_weight"))


def weighted_loss(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = F.sum(F.col("loss") * F.col("sample_weight")) / F.greatest(F.lit(1e-8), F.sum("sample_weight"))
    return (entries.groupBy(*by) if by else entries.groupBy()).agg(F.coalesce(mean, F.lit(0.0)).alias("loss"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """The mean of batches (epoch, loss, size), weighted by their size."""
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("size")) / F.greatest(F.lit(1), F.sum("size"))).alias("loss"))


def best_epoch(history: DataFrame, patience: int = 3, run: str = "run_id") -> DataFrame:
    """Of each run's history (epoch, phase, recall, f1) up to the stop: the first epoch with the best (recall, f1), and where it
    stops: after patience finetune epochs in a row without an improvement."""
    order = Window.partitionBy(run).orderBy("epoch")
    key = F.struct("recall", "f1")
    seen = F.max(key).over(order.rowsBetween(Window.unboundedPreceding, -1))
    improves = history.withColumn("better", seen.isNull() | (key > seen))
    runs = improves.withColumn("__run", F.sum(F.col("better").cast("int")).over(order))
    stale = F.sum(F.when((F.col("phase") == "finetune") & ~F.col("better"), 1).otherwise(0)).over(Window.partitionBy(run, "__run").orderBy("epoch"))
    marked = runs.withColumn("stale", stale)
    marked = marked.withColumn("stop_epoch", F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).over(Window.partitionBy(run)))
    kept = marked.filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(F.max_by("epoch", F.struct("recall", "f1", -F.col("epoch"))).alias("best_epoch"), F.max("stop_epoch").alias("stop_epoch"))


def error_order(predicted: str) -> list[Column]:
    return [F.desc("score") if predicted == "positive" else F.asc("score"), F.asc("id")]


def errors(entries: DataFrame, threshold: float, predicted: str, label: str) -> DataFrame:
    """False positives or negatives: entries predicted one way and labelled the other, the most certain first."""
    hit = F.when(F.col("score") >= threshold, "positive").otherwise("negative")
    return entries.withColumn("predicted", hit).filter((F.col("predicted") == predicted) & (F.col("label") == label)).orderBy(*error_order(predicted))


def delta_arrow(current: Column, baseline: Column, digits: int = 4) -> Column:
    """= within 1e-9, else an arrow and the difference."""
    delta = current - baseline
    return F.when(F.abs(delta) < 1e-9, "=").otherwise(F.concat(F.when(delta > 0, "↑").otherwise("↓"), F.format_string(f"%.{digits}f", F.abs(delta))))


def count_arrow(current: Column, baseline: Column) -> Column:
    delta = current - baseline
    return F.when(delta == 0, "=").otherwise(F.concat(F.when(delta > 0, "↑").otherwise("↓"), F.abs(delta).cast("long").cast("string")))


def compare_runs(runs: DataFrame, baseline: str) -> DataFrame:
    """runs (run_id, precision, recall, fp, fn) against the baseline's row: arrows and a verdict. Better: no worse in any of
    the four and better in one."""
    base = runs.filter(F.col("run_id") == baseline).limit(1).select(*[F.col(c).alias(f"base_{c}") for c in ("precision", "recall", "fp", "fn")])
    both = runs.crossJoin(F.broadcast(base))  # one row
    gains = [F.col("precision") - F.col("base_precision"), F.col("recall") - F.col("base_recall"), F.col("base_fp") - F.col("fp"), F.col("base_fn") - F.col("fn")]
    least, most = F.least(*gains), F.greatest(*gains)
    verdict = F.when(F.col("run_id") == baseline, "baseline").when((least >= 0) & (most > 0), "better").when((most <= 0) & (least < 0), "worse").otherwise("mixed")
    return both.select(
        "run_id", "precision", "recall", "fp", "fn", delta_arrow(F.col("precision"), F.col("base_precision")).alias("precision_delta"), delta_arrow(F.col("recall"), F.col("base_recall")).alias("recall_delta"),
        count_arrow(F.col("fp"), F.col("base_fp")).alias("fp_delta"), count_arrow(F.col("fn"), F.col("base_fn")).alias("fn_delta"), verdict.alias("verdict"),
    )


def freshness(labels: DataFrame, manifest_time: Column, collections_time: Column | None = None) -> DataFrame:
    """Whether the dataset is older than its labels (updated_at) or its collections, with the reasons."""
    newest = labels.agg(F.max("updated_at").alias("newest"))
    late = F.when(F.col("newest") > manifest_time, F.lit("labels changed after the manifest"))
    moved = F.when(collections_time > manifest_time, F.lit("collections changed after the manifest")) if collections_time is not None else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(late, moved))
    return newest.select("newest", reasons.alias("reasons"), (F.size(reasons) == 0).alias("fresh"))


def evaluation_entries(canonicals: DataFrame, eval_set: str) -> DataFrame:
    """blind: what was split into val and test, of exports and of the collections' hold-out; all-manual and all-exported:
    exports of all splits, by label source."""
    exported = canonicals.filter(F.col("source") == "export")
    if eval_set == "blind":
        return canonicals.filter(F.col("split").isin("val", "test"))
    if eval_set == "all-manual":
        return exported.filter(F.col("label_source") == "manual")
    if eval_set == "all-exported":
        return exported
    raise ValueError(f"unknown evaluation set: {eval_set}")
