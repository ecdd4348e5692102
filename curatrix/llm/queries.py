"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import oracles
from curatrix.llm.common import table


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op4_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.language_model import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.html_text import extracted_text

    return extracted_text(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.llm.repair import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_perspectives, op2_decontamination, op3_exact_dedup, op4_language_scores, op5_licenses, op6_simhash, op7_html_text, op8_quality, op9_packing, op10_secrets, op11_merkle, op12_token_counts, op13_repair)}

#: DuckDB's text of what a query returns, where SQL can say it.
ORACLES: dict[str, str] = {
    "op1_perspectives": r"""
        WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS turns FROM t),
        s AS (SELECT n.conv_id, place // 64 AS part, (turns + 63) // 64 AS n_parts, speaker, turn, role, text, role = speaker AS own,
            CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS header,
            text || chr(10) || '<|end|>' AS body FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
        o AS (SELECT *, sum(length(header) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, text) - 1 AS till FROM s)
        SELECT conv_id, speaker, part, n_parts, count(*) AS n_turns, CAST(min(till - length(header) - length(body)) AS BIGINT) AS start,
            CAST(sum(length(header) + length(body) + 1) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_learned,
            coalesce(string_agg(CASE WHEN own THEN CAST(till - length(body) AS BIGINT) || '-' || CAST(till AS BIGINT) END, ',' ORDER BY turn, role, text), '') AS mask,
            string_agg(header || body, chr(10) ORDER BY turn, role, text) || chr(10) AS text
        FROM o GROUP BY conv_id, part, n_parts, speaker""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
        w AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
    "op11_merkle": oracles.merkle(),
    "op13_repair": oracles.repair(),
}
