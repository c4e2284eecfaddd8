"""Versions compared inside the plan: cut into parts, numbers by value, anything else by its characters.

A missing part is the empty string, so 1.0 comes before 1.0.0 and a pre-release after its release.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import let

#: Fixed value: prefixes that are dropped once each, in this order.
PREFIXES = ("v", "V", "==", "=", r"\^", "~")


def clean_version(c: Column | str) -> Column:
    """Without outer blanks and the prefixes of PREFIXES; null stays null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    for p in PREFIXES:
        c = F.regexp_replace(c, f"^{p}", "")
    return F.trim(c)


def version_parts(c: Column) -> Column:
    """The parts between dots, hyphens and underscores, build metadata after '+' dropped."""
    return F.filter(F.split(F.split_part(c, F.lit("+"), F.lit(1)), r"[.\-_]"), lambda p: F.trim(p) != "")


def _number(x: Column) -> Column:
    """The value of a part that is a whole number of 64 bits; else null."""
    return F.when(x.rlike("^[+-]?[0-9]{1,19}$"), x.try_cast("bigint"))


def compare_parts(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two arrays of parts."""
    longest = F.greatest(F.size(a), F.size(b))

    def part(i: Column) -> Column:
        x, y = F.coalesce(F.get(a, i), F.lit("")), F.coalesce(F.get(b, i), F.lit(""))
        m, n = _number(x), _number(y)
        return F.when(m.isNotNull() & n.isNotNull(), F.when(m < n, -1).when(m > n, 1).otherwise(0)).otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0))

    each = F.transform(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), part)
    return F.coalesce(F.get(F.filter(each, lambda d: d != 0), 0), F.lit(0))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is null."""
    pair = F.struct(version_parts(clean_version(a)).alias("a"), version_parts(clean_version(b)).alias("b"))
    return F.when(a.isNotNull() & b.isNotNull(), let(pair, lambda p: compare_parts(p["a"], p["b"])))


def meets(version: Column, constraint: Column) -> Column:
    """Whether a version meets a constraint: < <= > >= == = != or a bare version, several joined by commas; '' and * hold for all."""

    def one(c: Column) -> Column:
        op, target = F.regexp_extract(c, r"^\s*(<=|<|>=|>|==|=|!=)?", 1), F.regexp_replace(c, r"^\s*(?:<=|<|>=|>|==|=|!=)?", "")
        d = compare_versions(version, target)
        holds = F.when(op == "<=", d <= 0).when(op == "<", d < 0).when(op == ">=", d >= 0).when(op == ">", d > 0).when(op == "!=", d != 0).otherwise(d == 0)
        return F.when(F.trim(c).isin("", "*"), True).otherwise(holds)

    return F.forall(F.split(constraint, ","), one)


def in_ranges(version: Column, ranges: Column) -> Column:
    """Whether a version lies in any range that isn't of type GIT; the events of a range are walked in order.

    introduced opens an interval ('0' and nothing: from the beginning), fixed closes it before, last_affected
    after its version; an interval that stays open goes on for ever.
    """
    given = lambda c: c.isNotNull() & (c != "")
    start = F.struct(F.lit("").alias("from"), F.lit(False).alias("hit"))

    def step(acc: Column, e: Column) -> Column:
        low = F.when(given(e["introduced"]), e["introduced"]).otherwise(acc["from"])
        above = F.when(low.isin("", "0"), True).otherwise(compare_versions(version, low) >= 0)
        fixed, last = given(e["fixed"]), given(e["last_affected"])
        hit = F.when(fixed, above & (compare_versions(version, e["fixed"]) < 0)).when(last, above & (compare_versions(version, e["last_affected"]) <= 0)).otherwise(False)
        return F.struct(F.when(fixed | last, F.lit("")).otherwise(low).alias("from"), (acc["hit"] | F.coalesce(hit, F.lit(False))).alias("hit"))

    def end(acc: Column) -> Column:
        open_ = F.when(acc["from"] == "", False).when(acc["from"] == "0", True).otherwise(compare_versions(version, acc["from"]) >= 0)
        return acc["hit"] | F.coalesce(open_, F.lit(False))

    walk = lambda r: F.when(F.coalesce(r["range_type"], F.lit("")) == "GIT", False).otherwise(F.aggregate(F.coalesce(r["events"], _no_events()), start, step, end))
    return F.coalesce(F.exists(ranges, walk), F.lit(False))


def _no_events() -> Column:
    return F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>")


def is_vulnerable(version: Column, ranges: Column, affected: Column, fixed: Column) -> Column:
    """Whether a known version is affected: by a range, else by a constraint, else by a fixed version above it."""
    below = F.exists(fixed, lambda x: (x != "") & (compare_versions(version, x) < 0))
    hit = in_ranges(version, ranges) | F.coalesce(F.exists(affected, lambda c: meets(version, c)), F.lit(False)) | F.coalesce(below, F.lit(False))
    return F.when(clean_version(version).isin("", "unknown"), False).otherwise(hit)
