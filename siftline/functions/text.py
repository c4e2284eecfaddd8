"""Column functions on strings: runs of letters and digits, keys built from them, multisets, digests."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def runs(c: Column | str) -> Column:
    """The maximal runs of ASCII letters and digits, in lower case; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), 0)
    return F.transform(found, F.lower)


def run_key(c: Column | str) -> Column:
    """The sequence of runs as one string with single blanks; '' for null. Two values agree when their keys are equal."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z0-9]+", " ")))


def run_multiset(c: Column | str) -> Column:
    """The runs in sorted order as one string: equal for two texts with the same multiset of runs."""
    return F.array_join(F.array_sort(runs(c)), " ")


def digest(*cols: Column | str) -> Column:
    """16 bytes that stand for the given values; null and '' differ. The lengths keep neighbours apart."""
    parts = []
    for c in cols:
        s = _col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def counted_vector(c: Column | str) -> Column:
    """The multiset of runs as a sorted array of distinct 64-bit numbers, one for each (run, occurrence).

    The size of two vectors' intersection is then the size of the multisets' intersection. Linear in the
    text after the sort: the sorted runs are cut where the value changes, no element is searched for.
    """
    numbered = lambda s: F.flatten(F.transform(spans(s), lambda z: F.transform(F.sequence(F.lit(0), z["n"] - 1), lambda k: F.xxhash64(z["v"], k))))
    return F.array_sort(let(F.array_sort(runs(c)), numbered))


def spans(s: Column) -> Column:
    """The distinct values of the sorted array `s`, in order, as structs of the value v and its number n."""
    at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return let(starts, lambda b: F.transform(b, lambda i, j: F.struct(F.get(s, i).alias("v"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("n"))))


def blank(c: Column | str) -> Column:
    """Without outer white space."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def mask(c: Column | str, keep: int = 8) -> Column:
    """The first `keep` characters and '****'; only '****' where there are not more."""
    c = _col(c)
    return F.when(F.length(c) > keep, F.concat(F.substring(c, 1, keep), F.lit("****"))).when(c.isNotNull(), F.lit("****"))


def literal_map(pairs: Mapping[str, object]) -> Column:
    """A map of literal texts to literal texts or whole numbers, made in one expression."""
    of = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{of(k)}, {of(v)}" for k, v in pairs.items()) + ")")
