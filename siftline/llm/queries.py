"""The queries of this subpackage, by name, over a folder of tables, and their statements in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import canonical, components, credentials, incremental, mixture, oracle, packing, representative, stuffing, tokens
from siftline.session import written
from siftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    best = representative.defects(table(spark, folder, "findings"), table(spark, folder, "detectors"), prefer="lead")
    return best.select("group_key", "severity", "confidence", "cwe", "detector_ids")


def p1_votes(spark: SparkSession, folder: str) -> DataFrame:
    return representative.defects(table(spark, folder, "findings"), table(spark, folder, "detectors"), prefer="votes")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.repeats(table(spark, folder, "findings"), table(spark, folder, "incoming_findings"), table(spark, folder, "suppressions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.vulnerability_groups(table(spark, folder, "advisories"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.members(table(spark, folder, "findings"), "finding_key", *canonical.finding_forms())


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.collapse(table(spark, folder, "findings"), "finding_key", *canonical.finding_forms())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.credential_lines(table(spark, folder, "findings"), table(spark, folder, "source_files"))


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    findings, files = table(spark, folder, "findings"), table(spark, folder, "source_files")
    return credentials.redact(credentials.texts(findings, files), credentials.credentials(findings, files))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.sized(table(spark, folder, "documents")), table(spark, folder, "pack_limits"))


def p7_fills(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fills(p7_packed(spark, folder), table(spark, folder, "pack_limits"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.sized(table(spark, folder, "documents"), keep=("source",)).withColumn("source", mixture.clean_source("source"))
    return mixture.blend(written(sizes, "sizes"), table(spark, folder, "mix_targets"))


def p8_blend(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, folder, "documents")).select("doc_id")


def p9_curves(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.page_curves(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_votes": p1_votes,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p5_found": p5_found,
        "p5_copies": p5_copies,
        "p6_found": p6_found,
        "p6_redacted": p6_redacted,
        "p7_packed": p7_packed,
        "p7_fills": p7_fills,
        "p8_blend": p8_blend,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_curves": p9_curves,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": oracle.P1_FOUND,
        "p1_votes": oracle.P1_VOTES,
        "p2_found": oracle.P2_FOUND,
        "p3_found": oracle.P3_FOUND,
        "p5_found": oracle.P5_FOUND,
        "p5_copies": oracle.P5_COPIES,
    }
