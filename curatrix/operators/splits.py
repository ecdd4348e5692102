"""Leakage-free, sticky splits of families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.shared import materialise, placed

HOLDOUT_TEST = HOLDOUT_VAL = 64


def ranked(df: DataFrame, key: Column, partition: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(key)))


def collection_holdout(groups: DataFrame, test: int = HOLDOUT_TEST, val: int = HOLDOUT_VAL) -> DataFrame:
    """(group_id, split) of the families that are set aside: positive and of collections only, in the order of a salted
    hash; the first go to test, the next to val. Only the head of the order is kept, so no task sorts all families."""
    order = F.sha2(F.concat(F.lit("collection-holdout:"), F.col("group_id")), 256)
    head = groups.filter((F.col("label") == "positive") & F.col("collection_only")).select("group_id", order.alias("__order")).orderBy("__order", "group_id").limit(test + val)
    place = F.row_number().over(Window.orderBy("__order", "group_id"))
    return head.select("group_id", F.when(place <= test, "test").otherwise("val").alias("split"))


def seeded_order(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_id")), 256)


def stratified_holdout(groups: DataFrame, ratio: float, seed: int) -> DataFrame:
    """groups with held (boolean): of each label the first ceil(n / folds) in a seeded order.

    folds = round(1 / ratio), 2 at least, and no more than the smallest label has families. If that leaves fewer than two
    folds, the first max(1, round(n * ratio)) of all by id are held; with ratio 0 none. Ranks come from counts of hash
    prefixes and a rank within each, so that a label of any size is spread over many tasks.
    """
    if ratio <= 0:
        return groups.withColumn("held", F.lit(False))
    sizes = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a label
    total = sum(sizes.values())
    if not total:
        return groups.withColumn("held", F.lit(False))
    folds = min(max(2, round(1 / ratio)), min(sizes.values()), total)
    keyed = groups.withColumn("__order", seeded_order(seed) if folds >= 2 else F.col("group_id"))
    partition = F.coalesce("label", F.lit("")) if folds >= 2 else F.lit("")
    keyed = keyed.withColumn("__of", partition).withColumn("__prefix", F.substring("__order", 1, 3))
    counts = keyed.groupBy("__of", "__prefix").agg(F.count("*").alias("__n"))
    before = counts.select("__of", "__prefix", (F.sum("__n").over(Window.partitionBy("__of").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"), F.sum("__n").over(Window.partitionBy("__of")).alias("__all"))
    # 4,096 prefixes for each label at most, so groups are shuffled once, to be ranked within a prefix.
    placed = keyed.join(F.broadcast(before), ["__of", "__prefix"]).withColumn("__place", F.coalesce("__before", F.lit(0)) + F.row_number().over(Window.partitionBy("__of", "__prefix").orderBy("__order", "group_id")))
    limit = F.ceil(F.col("__all") / folds) if folds >= 2 else F.lit(max(1, round(total * ratio)))
    return placed.withColumn("held", F.col("__place") <= limit).select(*groups.columns, "held")


def initial_splits(groups: DataFrame, test_ratio: float, val_ratio: float, seed: int = 7) -> DataFrame:
    """(group_id, split): a stratified share for test, then of the rest val / (train + val) for val."""
    first = materialise(stratified_holdout(groups, test_ratio, seed).select("group_id", "label", "held"), "held")
    test = first.filter("held").select("group_id", F.lit("test").alias("split"))
    return test.unionByName(train_val_splits(first.filter("not held").drop("held"), val_ratio / max(1e-12, 1 - test_ratio), seed))


def train_val_splits(groups: DataFrame, val_share: float, seed: int = 7) -> DataFrame:
    """(group_id, split) of families that may not go to test."""
    held = stratified_holdout(groups, val_share, seed + 1)
    return held.select("group_id", F.when(F.col("held"), "val").otherwise("train").alias("split"))


def assign_splits(groups: DataFrame, prior: DataFrame | None = None, test_ratio: float = 0.15, val_ratio: float = 0.15, seed: int = 7) -> DataFrame:
    """(group_id, split, reason) of every family.

    What is set aside comes first, then families that may not be judged blind (train), then what a prior manifest
    (group_id, split) says, then new families: split afresh without a prior, else dealt to train and val only.
    """
    groups = materialise(groups.select("group_id", "label", "eligible", "collection_only"), "groups")
    held = materialise(collection_holdout(groups).withColumn("reason", F.lit("holdout")), "holdout")
    rest = groups.join(F.broadcast(held.select("group_id")), "group_id", "left_anti")  # HOLDOUT_TEST + HOLDOUT_VAL rows
    blocked = rest.filter("not eligible").select("group_id", F.lit("train").alias("split"), F.lit("train_only").alias("reason"))
    open_ = rest.filter("eligible")
    if prior is None:
        return held.unionByName(blocked).unionByName(initial_splits(open_, test_ratio, val_ratio, seed).withColumn("reason", F.lit("new")))
    kept = open_.join(prior.select("group_id", "split"), "group_id").select("group_id", "split", F.lit("prior").alias("reason"))
    new = open_.join(prior.select("group_id"), "group_id", "left_anti")
    added = train_val_splits(new, val_ratio / max(1e-12, 1 - test_ratio), seed).withColumn("reason", F.lit("new"))
    return held.unionByName(blocked).unionByName(kept).unionByName(added)


def assignment_mode(had_prior: bool, new_families: int) -> str:
    return "fresh" if not had_prior else "appended" if new_families else "reused"


def split_summary(members: DataFrame) -> DataFrame:
    """Rows by split, all splits present: total, positives, negatives, gold, trusted."""
    of = lambda c, v: F.sum(F.when(F.col(c) == v, 1).otherwise(0)).cast("long")
    counted = members.groupBy("split").agg(F.count("*").alias("total"), of("label", "positive").alias("positives"), of("label", "negative").alias("negatives"), of("label_tier", "gold").alias("gold"), of("label_tier", "trusted").alias("trusted"))
    domain = members.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return domain.join(counted, "split", "left").na.fill(0)


def sample_tokens(tokens: DataFrame, target: int, seed: str) -> DataFrame:
    """target of the tokens (token_id) in the order of a seeded hash, or all, by id."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col("token_id").cast("string")), 256)
    return tokens.select("token_id").orderBy(order, "token_id").limit(target).orderBy("token_id")


def refit(entries: DataFrame) -> DataFrame:
    """train takes val in, and val is a copy of test."""
    train = entries.filter(F.col("split").isin("train", "val")).withColumn("split", F.lit("train"))
    test = entries.filter(F.col("split") == "test")
    return train.unionByName(test.withColumn("split", F.lit("val"))).unionByName(test)


def training_order(entries: DataFrame, seed: int) -> DataFrame:
    """Entries (id) with their place in a seeded order, which ranges of the order spread over many tasks."""
    return placed(entries, [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256), F.col("id")])
