"""Records that differ only in white space, case, punctuation or the order of parts, collapsed and counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import digest, run_key, run_multiset
from siftline.session import written


def survivors(df: DataFrame, key: str, equal: Sequence[str], canonical: Mapping[str, Column]) -> DataFrame:
    """The byte-identical rows collapsed: raw (digest of the values), n, first_key, the full canonical text and its digest.

    `equal` are columns compared as they are, `canonical` maps columns to their canonical form, which is
    computed once for each distinct raw row.
    """
    cols = [*equal, *canonical]
    raw = df.where(F.col(key).isNotNull()).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    full = F.struct(*(F.col(c).alias(f"e{i}") for i, c in enumerate(equal)), *(v.alias(f"c{i}") for i, v in enumerate(canonical.values())))
    x = raw.select(digest(*cols).alias("raw"), full.alias("text"), "n", "first_key")
    return x.select("raw", digest(*(F.col(f"text.{f}") for f in x.schema["text"].dataType.names)).alias("canon"), "text", "n", "first_key")


def collapse(df: DataFrame, key: str, equal: Sequence[str], canonical: Mapping[str, Column]) -> DataFrame:
    """One row for each canonical record: group_key (the smallest key), n_raw (distinct ways of writing) and n_rows.

    Nulls are values of their own in `equal`; in `canonical` what the given expression makes of them. Rows
    with a null key are left out. Other columns of `df` don't matter. Empty tables give an empty result.
    """
    return survivors(df, key, equal, canonical).groupBy("canon", "text").agg(F.min("first_key").alias("group_key"), F.count(F.lit(1)).alias("n_raw"), F.sum("n").alias("n_rows")).drop("canon", "text")


def members(df: DataFrame, key: str, equal: Sequence[str], canonical: Mapping[str, Column], least: int = 2) -> DataFrame:
    """(group_key, key) for every row in a group of at least `least` rows, by the same steps as collapse().

    Groups are formed on the full canonical text; its digest only leads the key. They find their survivors
    by that text, and a survivor its byte-identical rows by a digest of 16 bytes. Both joins are between one
    row per group and the rest, which adaptive execution splits where a group is large.
    """
    raw = written(survivors(df, key, equal, canonical), "survivors")
    groups = raw.groupBy("canon", "text").agg(F.min("first_key").alias("group_key"), F.sum("n").alias("n_rows")).where(F.col("n_rows") >= least)
    kept = raw.join(groups, ["canon", "text"]).select("raw", "group_key")
    rows = df.where(F.col(key).isNotNull()).select(digest(*equal, *canonical).alias("raw"), F.col(key))
    return rows.join(kept, "raw").select("group_key", key)


def finding_forms() -> tuple[list[str], dict[str, Column]]:
    """What makes two findings the same record: equal project and line, agreeing rule_id and file, evidence with the same runs."""
    return ["project", "line"], {"rule_id": run_key("rule_id"), "file": run_key("file"), "evidence": run_multiset("evidence")}
