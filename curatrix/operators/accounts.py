"""Accounts, whitelist and export payloads of the collector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.shared import placed


def matches_search(query: str) -> Column:
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else F.lower("handle").contains(wanted) | F.coalesce(F.lower("display_name").contains(wanted), F.lit(False))


def account_order() -> list[Column]:
    return [F.desc("posts_matched"), F.asc("handle")]


def ordered_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(*account_order())


def exempt_accounts(accounts: DataFrame, whitelist: DataFrame) -> DataFrame:
    return ordered_accounts(accounts.join(whitelist.select("handle").distinct(), "handle", "left_semi"))


def caught_accounts(accounts: DataFrame, whitelist: DataFrame) -> DataFrame:
    return ordered_accounts(accounts.join(whitelist.select("handle").distinct(), "handle", "left_anti"))


def avatar_order() -> list[Column]:
    return [F.desc("seen_count"), F.asc("normalized_url")]


def ordered_avatars(avatars: DataFrame) -> DataFrame:
    return avatars.orderBy(*avatar_order())


def export_rows(avatars: DataFrame) -> DataFrame:
    """An export of any size as rows with their place; its header is totals()."""
    return placed(avatars, avatar_order())


def totals(avatars: DataFrame) -> DataFrame:
    return avatars.agg(F.coalesce(F.sum("seen_count"), F.lit(0)).cast("long").alias("total_sightings"), F.count("*").alias("unique_avatars"))


def match_rate(matched: Column, seen: Column) -> Column:
    """In percent, with one digit from 10 on and else two; 0% if nothing was seen."""
    rate = 100 * matched / F.greatest(seen, F.lit(1))
    return F.when(seen == 0, "0%").when(rate >= 10, F.format_string("%.1f%%", rate)).otherwise(F.format_string("%.2f%%", rate))


def export_payload(avatars: DataFrame, exported_at: str, version: int = 1) -> DataFrame:
    """The export as one row of JSON. It is one document by contract; use the rows themselves for what does not fit one."""
    fields = ["normalized_url", "original_url", "handles", "display_names", "source_surfaces", "seen_count", "first_seen_at", "last_seen_at", "example_profile_url", "example_notification_url", "example_tweet_url", "whitelisted"]
    one = avatars.agg(F.count("*").alias("avatar_count"), F.coalesce(F.sum("seen_count"), F.lit(0)).cast("long").alias("total_sightings"), F.sort_array(F.collect_list(F.struct((-F.col("seen_count")).alias("__o"), *fields))).alias("rows"))
    rows = F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return one.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(exported_at).alias("exported_at"), "avatar_count", "total_sightings", rows.alias("avatars"))).alias("payload"))


def mode_decision(mode: Column, matched: Column, whitelisted: Column, revealed: Column) -> Column:
    """What becomes of a post: debug marks every match; else whitelisted, unmatched and revealed posts are shown."""
    shown = F.lit("show")
    return F.when(mode == "off", shown).when((mode == "debug") & matched, "mark").when(whitelisted | ~matched | revealed, shown).when(mode == "hide", "hide").when(mode == "fade", "fade").otherwise(shown)
