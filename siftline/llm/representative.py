"""One surviving record for each group of records that describe the same thing, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import blank, digest, run_key

# What counts as a value of the fields.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")

#: Half-lives beyond which a vote isn't halved any more.
HALVINGS = 80

_ROW = ""  # the long rows of this "field" stand for the records themselves


def usable_severity(c: Column | str) -> Column:
    """One of SEVERITIES, case and outer blanks aside; null for anything else."""
    v = F.upper(blank(c))
    return F.when(v.isin(*SEVERITIES), v)


def usable_confidence(c: Column | str) -> Column:
    """One of CONFIDENCES, also with a number in brackets after it, which is dropped; else null."""
    v = F.regexp_extract(F.upper(blank(c)), rf"^({'|'.join(CONFIDENCES)})\s*(?:\(\s*[0-9]+(?:\.[0-9]+)?\s*\))?$", 1)
    return F.when(v != "", v)


def usable_cwe(c: Column | str) -> Column:
    """CWE-<n> without leading zeros from a positive number, alone or after CWE and one separator; else null."""
    n = F.regexp_extract(F.upper(blank(c)), r"^(?:CWE[ _-]?)?0*([1-9][0-9]*)$", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def with_trust(df: DataFrame, detectors: DataFrame, key: str, ids: str = "detector_ids", to: str = "trust", most: int = 1_000) -> DataFrame:
    """`df` with the highest trust among its detector ids, 0 where none is listed.

    A list of up to `most` detectors travels as a literal map; a longer one is joined on the exploded ids of the
    rows, which `key` has to tell apart.
    """
    known = detectors.where(F.col("detector_id").isNotNull() & F.col("trust").isNotNull()).groupBy("detector_id").agg(F.max("trust").cast("int").alias("trust"))
    head = known.limit(most + 1).collect()
    if len(head) <= most:
        trusts = F.create_map(*(F.lit(x) for r in head for x in r)) if head else F.create_map().cast("map<string,int>")
        return df.withColumn(to, F.coalesce(F.array_max(F.transform(ids, lambda d: F.try_element_at(trusts, d))), F.lit(0)))
    best = df.select(key, F.explode(ids).alias("detector_id")).join(known, "detector_id").groupBy(key).agg(F.max("trust").alias(to))
    return df.join(best, key, "left").withColumn(to, F.coalesce(to, F.lit(0)))


def _items(field: str, array: Column) -> Column:
    return F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))


def represent(
    df: DataFrame,
    group: Sequence[Column],
    key: str,
    trust: str,
    at: str,
    fields: Mapping[str, Column],
    sets: Mapping[str, str] | None = None,
    prefer: str = "votes",
    as_of: Column | str | None = None,
    half_life_days: int = 30,
    least: int = 2,
) -> DataFrame:
    """One row for each group of at least `least` rows: group_key (the smallest key), n_rows, and each field's best value.

    The fields are unpivoted to long rows (group, field, value). A value's votes are the sum, over the rows
    that give it, of trust halved once for each whole half-life of its age at `as_of`, by default the latest
    time of the table. The sums are whole numbers of 38 digits, so their order is the same in every run; a
    row of HALVINGS half-lives or more counts as one of HALVINGS, where no number of old rows outweighs a
    recent one. The winner of a field is taken by max_by and the winners are pivoted back. `prefer` says what
    max_by goes by: "votes" (then the leading row), or "lead": the leading row alone, rows ordered by trust,
    time and key. That order is the limit of ever steeper votes, in which each row outweighs all rows below
    it; such weights need as many digits as there are rows, so the limit is taken as a maximum and not as a
    sum. Where a result is defined by the first usable row, use "lead".

    `fields` maps an output name to the normalised value (null: unusable). `sets` maps an output name to an
    array column whose distinct non-null items come out sorted and joined by ','. Missing values come out as
    ''. Null trust counts as 0 and null time as the oldest. Rows whose key is null are left out; other
    columns of `df` don't matter. Every aggregate combines before the shuffle, so that one group may hold
    any part of the rows.
    """
    sets = dict(sets or {})
    if as_of is None and prefer == "votes":
        as_of = F.lit(df.agg(F.max(F.col(at).cast("date"))).first()[0]).cast("date")
    now = F.lit(as_of) if isinstance(as_of, str) else as_of if as_of is not None else F.lit(None).cast("date")
    age = F.least(F.lit(HALVINGS), F.greatest(F.lit(0), F.floor(F.datediff(now, F.col(at).cast("date")) / half_life_days))).cast("int")
    powers = F.array(*(F.lit(Decimal(2**k)).cast("decimal(25,0)") for k in range(HALVINGS + 1)))
    weight = F.get(powers, F.lit(HALVINGS) - F.coalesce(age, F.lit(HALVINGS)))
    vote = (F.coalesce(F.col(trust), F.lit(0)).cast("decimal(10,0)") * weight if prefer == "votes" else F.lit(0)).cast("decimal(38,0)")
    long = [F.struct(F.lit(_ROW).alias("field"), F.lit("").alias("value"))]
    long += [F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()]
    items = [_items(f, F.col(c)) for f, c in sets.items()]
    rows = (
        df.where(F.col(key).isNotNull())
        .select(
            digest(*group).alias("g"),
            F.col(key).alias("k"),
            F.coalesce(F.col(trust), F.lit(0)).cast("bigint").alias("t"),
            F.col(at).alias("at"),
            vote.alias("vote"),
            F.explode(F.concat(F.array(*long), *items)).alias("x"),
        )
        .select("g", "k", "t", "at", "vote", "x.field", "x.value")
        .where(F.col("value").isNotNull())
    )
    summed = [F.sum("vote").alias("votes")] if prefer == "votes" else []
    votes = rows.groupBy("g", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), *summed, F.max(F.struct("t", "at", "k")).alias("lead"))
    order = F.struct("votes", "lead") if summed else F.col("lead")
    of = lambda f, x: F.when(F.col("field") == f, x)
    out = votes.groupBy("g").agg(
        F.max(of(_ROW, F.col("first_key"))).alias("group_key"),
        F.max(of(_ROW, F.col("n"))).alias("n_rows"),
        *(F.coalesce(F.max_by(of(f, F.col("value")), of(f, order)), F.lit("")).alias(f) for f in fields),
        *(F.array_join(F.array_sort(F.collect_set(of(f, F.col("value")))), ",").alias(f) for f in sets),
    )
    return out.where(F.col("n_rows") >= least).select("group_key", "n_rows", *fields, *sets)


def defects(findings: DataFrame, detectors: DataFrame, prefer: str = "votes", **options: object) -> DataFrame:
    """represent() over findings: one row per defect that several rows report.

    A defect is an equal project, canonical_rule and line (above 0) and agreeing files. Rows with a null
    project, canonical_rule or line are in no group. An empty table gives an empty result.
    """
    f = findings.select("finding_key", "project", "canonical_rule", "line", "file", "severity", "confidence", "cwe", "detector_ids", "scanned_at")
    f = f.where((F.col("line") > 0) & F.col("canonical_rule").isNotNull() & F.col("project").isNotNull())
    fields = {"severity": usable_severity("severity"), "confidence": usable_confidence("confidence"), "cwe": usable_cwe("cwe")}
    group = [F.col("project"), F.col("canonical_rule"), F.col("line"), run_key("file")]
    return represent(with_trust(f, detectors, "finding_key"), group, "finding_key", "trust", "scanned_at", fields, {"detector_ids": "detector_ids"}, prefer, **options)
