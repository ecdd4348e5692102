"""Duplicate families: samples with equal bytes or equal pixels, transitively."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.components import connected_components
from curatrix.shared import attach, materialise, small

MEMBER = ("sample_id", "path", "label", "source", "raw_sha", "pixel_digest", "label_source", "label_tier", "sample_weight", "blind_eval_eligible", "exported_sha")


def canonical_order() -> Column:
    """gold before trusted before others, exports before collections, then the id."""
    tier = F.when(F.col("label_tier") == "gold", 0).when(F.col("label_tier") == "trusted", 1).otherwise(2)
    return F.struct(tier, F.when(F.col("source") == "export", 0).otherwise(1), F.col("sample_id"))


class Grown(NamedTuple):
    """samples: with their families; stars: (key, component) of every content key; renamed: (id, component) of the families that
    have met others and go by their name now."""

    samples: DataFrame
    stars: DataFrame
    renamed: DataFrame


def _keyed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("__a", F.concat(F.lit("sha:"), F.coalesce("raw_sha", F.lit("")))).withColumn("__b", F.concat(F.lit("pix:"), F.coalesce("pixel_digest", F.lit(""))))


def with_stars(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples with group_key, the smallest content key that links reach; and (key, component) of every content key, to be
    stored for samples that come later.

    The graph's vertices are content keys, not samples: a sample is an edge between its hash and its digest, so a family
    of any number of equal samples is one edge, and no group of samples meets in a task.
    """
    rows = materialise(_keyed(samples), "samples")
    edges = rows.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()
    parts = connected_components(edges)
    vertices = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
    stars = vertices.join(parts, F.col("key") == F.col("id"), "left").select("key", F.coalesce("component", "key").alias("component"))
    return _named(rows, stars), stars


def _named(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """Keyed samples, materialised, with the component of their hash."""
    sizes = rows.groupBy("__a").agg(F.count("*").alias("__n"))
    named = materialise(sizes.join(stars, F.col("__a") == F.col("key")).select("__a", "__n", F.col("component").alias("group_key")), "family-keys")
    return attach(rows, named, "__a", "__n", rows.count()).drop("__n")


def families(samples: DataFrame) -> DataFrame:
    """samples with group_key."""
    return with_stars(samples)[0]


def grow(found: DataFrame, stars: DataFrame, new: DataFrame) -> Grown:
    """What the families of found and new samples are, as if all had come at once.

    A component stands for all its content keys, so the graph has an edge only where a new sample links two components or keys
    that were apart: what is iterated on grows with the new samples, whatever there was. Old samples are not read for that; they
    only get another name where their family has met one with a smaller key.
    """
    rows = materialise(_keyed(new), "new-samples")
    edges = materialise(rows.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct(), "new-edges")
    ends = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))
    known = materialise(ends.join(stars, "key", "left").select("key", "n", "component", F.coalesce("component", "key").alias("now")), "new-keys")
    n = edges.count()
    side = lambda df, c: attach(df, known.select(F.col("key").alias(c), "n", F.col("now").alias(f"{c}_now")), c, "n", n).drop("n")
    joined = materialise(side(edges, "a"), "new-edges-a")
    contracted = side(joined, "b").select(F.col("a_now").alias("a"), F.col("b_now").alias("b")).filter("a <> b").distinct()
    renamed = materialise(connected_components(contracted), "renamed")
    over = small(renamed)

    def now(df: DataFrame, column: str) -> DataFrame:
        return df.join(over, F.col(column) == F.col("id"), "left").withColumn(column, F.coalesce("component_", column)).drop("id", "component_")

    over = over.withColumnRenamed("component", "component_")
    added = known.filter("component IS NULL").select("key", F.col("now").alias("component"))
    later = materialise(now(stars.unionByName(added), "component"), "stars")
    samples = now(found, "group_key").unionByName(_named(rows, later), allowMissingColumns=True)
    return Grown(samples, later, renamed)


def hand_over(prior: DataFrame, before: DataFrame, after: DataFrame, renamed: DataFrame) -> DataFrame:
    """(group_id, split, old_families): the splits of a prior manifest (group_id, split) under the ids that families have after
    they have grown. Where families of different splits have met, the one that was learned from decides, so that nothing that a
    model has seen is judged blind: train before val before test."""
    moved = before.select("group_id", "group_key").join(prior.select("group_id", "split"), "group_id").join(renamed, F.col("group_key") == F.col("id"), "left")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    kept = moved.groupBy(F.coalesce("component", "group_key").alias("group_key")).agg(F.min_by("split", rank).alias("split"), F.count("*").alias("old_families"))
    return after.select("group_id", "group_key").join(kept, "group_key").select("group_id", "split", "old_families")


def _found(samples: DataFrame) -> DataFrame:
    """Samples that have their families already are taken as they are."""
    return samples if "group_key" in samples.columns else families(samples)


def group_records(samples: DataFrame) -> DataFrame:
    """One row a family: group_id, label, size, n_labels, eligible (all members are), collection_only, canonical.

    group_id is the SHA-256 of the family's sorted content keys. A family with more than one label is a conflict.
    """
    found = _found(samples)
    one = found.groupBy("group_key").agg(
        F.collect_set("__a").alias("__as"), F.collect_set("__b").alias("__bs"), F.count("*").alias("size"), F.min("label").alias("label"),
        F.count_distinct("label").alias("n_labels"), F.bool_and("blind_eval_eligible").alias("eligible"), F.bool_and(F.col("source") != "export").alias("collection_only"),
        F.min_by(F.struct(*MEMBER), canonical_order()).alias("canonical"),
    )
    keys = F.array_sort(F.array_union(F.col("__as"), F.col("__bs")))
    return one.select(F.sha2(F.array_join(keys, "|"), 256).alias("group_id"), "group_key", "label", "size", "n_labels", "eligible", "collection_only", "canonical")


def label_conflicts(samples: DataFrame) -> DataFrame:
    """Members of families with more than one label; a dataset is only built when there are none."""
    found = _found(samples)
    bad = found.groupBy("group_key").agg(F.count_distinct("label").alias("n_labels")).filter("n_labels > 1").select("group_key")
    return found.join(bad, "group_key", "left_semi").select("group_key", "sample_id", "label")


def require_no_conflicts(samples: DataFrame) -> None:
    if some := label_conflicts(samples).orderBy("group_key", "sample_id").limit(20).collect():
        raise ValueError("conflicting labels in a family: " + ", ".join(f"{r['sample_id']}={r['label']}" for r in some))


def split_members(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """One row a sample: group_id, split and the columns of MEMBER. Families of any size stay spread, as a family's record goes
    to where its samples are; splits: (group_id, split)."""
    found = materialise(_found(samples), "found")
    groups = group_records(found).join(splits, "group_id").select("group_key", "group_id", "split", F.col("size").alias("__size"))
    return attach(found, materialise(groups, "family-splits"), "group_key", "__size", found.count()).filter("group_id is not null").select("group_id", "split", *MEMBER)


def split_manifest(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Nested rows (group_id, label, split, canonical, members) in order of the canonical's id; splits: (group_id, split).
    Members are collected by family, so this is for families that fit a row."""
    found = _found(samples)
    members = found.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members"))
    groups = group_records(found).join(members, "group_key").join(splits, "group_id")
    return groups.select("group_id", "label", "split", "canonical", "members").orderBy("canonical.sample_id")
