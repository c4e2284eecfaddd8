"""Pairwise links consolidated into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import cut, written


def hash_to_min(pairs: DataFrame, left: str = "v", right: str = "u", rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of `pairs`; root is the smallest vertex of its component.

    Each vertex holds its cluster as rows (v, u). In a round it sends the cluster to the smallest member and
    that member to all others. Rows, not arrays, so that a cluster may be any part of all vertices: the
    smallest member is an aggregate that combines before the shuffle, distinct rows spread by both ends,
    and the join of a large cluster with its one minimum is split by adaptive execution.

    Both directions are always kept, so the rounds are over exactly when every vertex but the smallest has
    a single neighbour: a neighbour that weren't the smallest would have two. Each round is written with
    checkpoint(). Pairs with a null end are left out, equal pairs count once, a pair of equal ends is a
    component of one. A graph that isn't settled after `rounds` raises.
    """
    p = pairs.select(F.col(left).alias("v"), F.col(right).alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    alone = p.select("v").unionAll(p.select(F.col("u").alias("v"))).distinct()
    p = cut(both_ways(p.where("v <> u")))
    for _ in range(rounds):
        least = p.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        if least.where("m < v AND n > 1").isEmpty():
            roots = least.select("v", F.least("v", "m").alias("root"))
            return alone.join(roots, "v", "left").select(F.col("v").alias("vertex"), F.coalesce("root", "v").alias("root"))
        held = p.join(least.select("v", F.least("v", "m").alias("m")), "v")
        sent = held.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))).alias("x"))
        p = cut(both_ways(sent.select("x.v", "x.u").where("v <> u")))
    raise RuntimeError(f"not settled after {rounds} rounds")


def both_ways(p: DataFrame) -> DataFrame:
    """The distinct pairs in both directions."""
    one = p.select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).distinct()
    return one.unionAll(one.select(F.col("u").alias("v"), F.col("v").alias("u")))


def identifiers(advisories: DataFrame) -> DataFrame:
    """(adv_key, ident) for every identifier of a row, in id or aliases, without case and punctuation.

    An alias entry may hold several, separated by comma, semicolon, bar or blanks. What has no digit from 1
    to 9 is no identifier.
    """
    said = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.split(F.coalesce(a, F.lit("")), r"[,;|\s]+")))
    clean = F.transform(F.concat(F.array(F.coalesce("id", F.lit(""))), said), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")))
    return advisories.where("adv_key IS NOT NULL").select("adv_key", F.explode(F.array_distinct(F.filter(clean, lambda x: x.rlike("[1-9]")))).alias("ident"))


def vulnerability_groups(advisories: DataFrame, least: int = 2) -> DataFrame:
    """(group_key, adv_key) for every row in a group of at least `least` rows that identifiers tie together.

    The rows that share an identifier are linked to the smallest of them, never to each other: as many
    links as identifiers are mentioned. Rows without an identifier are alone.
    """
    said = written(identifiers(advisories), "identifiers")
    first = said.groupBy("ident").agg(F.min("adv_key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = cut(said.join(first, "ident").select("adv_key", "first"))
    of = cut(hash_to_min(links, "adv_key", "first"))
    sizes = of.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return of.join(sizes, "root").select(F.col("root").alias("group_key"), F.col("vertex").alias("adv_key"))
