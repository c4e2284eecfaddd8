"""Texts put into containers of fixed capacity by swap-based local search, in shards of bounded size."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import written

#: Items that one task packs together, about.
SHARD_ITEMS = 4096
#: Containers filled less than this are taken apart and packed again with those of other shards.
FULL = 0.97


def parts(sizes: DataFrame, limits: DataFrame, most_limits: int = 1000) -> DataFrame:
    """(limit_name, capacity, doc_id, part_no, tokens, row): each text once for each limit, cut only if it alone exceeds the capacity.

    row tells equal rows apart; it is fixed once the result is written.

    A cut text gives full parts and one rest. Limits with a null name or without a positive capacity are left
    out; of several rows with one name the smallest capacity counts. There are few limits: at most `most_limits`.
    """
    known = limits.where("limit_name IS NOT NULL AND capacity_tokens > 0").groupBy("limit_name").agg(F.min("capacity_tokens").cast("int").alias("c")).limit(most_limits + 1).collect()
    if len(known) > most_limits:
        raise ValueError(f"more than {most_limits} limits")
    if not known:
        return sizes.select(F.lit("").alias("limit_name"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("part_no"), "tokens", F.lit(0).cast("bigint").alias("row")).where("false")
    each = F.explode(F.array(*(F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(r["c"]).alias("capacity")) for r in sorted(known)))).alias("l")
    x = sizes.select("doc_id", "tokens", F.monotonically_increasing_id().alias("row")).select("doc_id", "tokens", "row", each).select("l.*", "doc_id", "tokens", "row")
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)
    x = x.withColumn("part_no", F.explode(F.sequence(F.lit(0), last)))
    return x.select("limit_name", "capacity", "doc_id", "part_no", F.least(F.col("capacity"), F.col("tokens") - F.col("part_no") * F.col("capacity")).cast("int").alias("tokens"), "row")


def fill_bins(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item: best fit in falling order, then local search until no exchange helps."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (free, container), sorted
    n = 0
    for i in order.tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b, n = capacity, n, n + 1
        where[i] = b
        if free - s > 0:
            insort(room, (free - s, b))
        elif s == 0:
            insort(room, (free, b))
    return improve(sizes, where, capacity)


def improve(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Empties underfull containers, the emptiest first, by moves and exchanges that raise the sum of squared fills.

    With x in the container to be emptied and y in a fuller one, tried in this order: x moves; x goes and y
    comes back (one for one); two of x go and y comes back, x goes and two of y come back (two for one). What
    comes back is always less than what goes, so the fuller one gains and each step raises the sum of squares.
    """
    n = int(where.max()) + 1 if len(where) else 0
    fill = np.bincount(where, weights=sizes, minlength=n).astype(np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    for b in np.argsort(fill, kind="stable"):
        if n <= least or fill[b] >= capacity:
            break
        while fill[b] > 0 and _step(sizes, where, fill, capacity, int(b)):
            pass
        if fill[b] == 0:
            n -= 1
            left = np.flatnonzero(where == b)  # items without size
            if len(left):
                where[left] = int(np.argmax(fill))
    return where


def _step(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int, b: int) -> bool:
    gap = capacity - fill
    inside = np.flatnonzero((where == b) & (sizes > 0))
    inside = inside[np.argsort(-sizes[inside], kind="stable")]
    open_ = (fill >= fill[b]) & (gap > 0)
    open_[b] = False
    for x in inside:
        fits = np.flatnonzero(open_ & (gap >= sizes[x]))
        if len(fits):
            return _go(sizes, where, fill, [int(x)], [], int(fits[np.argmin(gap[fits])]), b)
    other = np.flatnonzero(open_[where] & (sizes > 0))
    if not len(other):
        return False
    y, g = sizes[other], gap[where[other]]
    for x in inside:
        k = _best(int(sizes[x]) - y, g)
        if k >= 0:
            return _go(sizes, where, fill, [int(x)], [int(other[k])], int(where[other[k]]), b)
    return _two_go(sizes, where, fill, gap, inside, other, b) or _two_back(sizes, where, fill, gap, inside, other, b)


def _two_go(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, gap: np.ndarray, inside: np.ndarray, other: np.ndarray, b: int) -> bool:
    """Any two of `inside` go and one of `other` comes back: the exchange of largest gain."""
    if len(inside) < 2:
        return False
    s = sizes[inside]  # falling
    i, j = np.triu_indices(len(s), 1) if len(s) <= 2048 else _distinct_pairs(s)
    sums, at = np.unique(s[i] + s[j], return_index=True)
    y, g = sizes[other], gap[where[other]]
    k = np.searchsorted(sums, y + g, "right") - 1  # for each y, the largest sum that fits
    gain = np.where(k >= 0, sums[np.maximum(k, 0)] - y, 0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return False
    p = at[k[best]]
    return _go(sizes, where, fill, [int(inside[i[p]]), int(inside[j[p]])], [int(other[best])], int(where[other[best]]), b)


def _distinct_pairs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that give every sum of two of `s`, sorted: each size once, or twice where it occurs twice."""
    keep = np.flatnonzero(np.r_[True, True, s[2:] != s[:-2]])
    i, j = np.triu_indices(len(keep), 1)
    return keep[i], keep[j]


def _two_back(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, gap: np.ndarray, inside: np.ndarray, other: np.ndarray, b: int) -> bool:
    """One of `inside` goes and any two of one container come back: for the largest x that can, the exchange of largest gain."""
    o = other[np.lexsort((sizes[other], where[other]))]
    y, home = sizes[o], where[o]
    wide = int(sizes.max()) + 1
    keys = home * wide + y
    for x in dict.fromkeys(sizes[inside].tolist()):  # each size once
        least = np.maximum(x - gap[home] - y, 0)  # the other of the two has at least this size, and less than x - y
        at = np.searchsorted(keys, home * wide + np.minimum(least, wide - 1))
        at += at == np.arange(len(o))  # not the item itself
        ok = at < len(o)
        at = np.minimum(at, len(o) - 1)
        gain = np.where(ok & (home[at] == home) & (at != np.arange(len(o))) & (y[at] >= least), x - y - y[at], 0)
        k = int(np.argmax(gain))
        if gain[k] > 0:
            first = int(inside[np.flatnonzero(sizes[inside] == x)[0]])
            return _go(sizes, where, fill, [first], [int(o[k]), int(o[at[k]])], int(home[k]), b)
    return False


def _best(gain: np.ndarray, gap: np.ndarray) -> int:
    """The place of the largest gain that is positive and fits, or -1."""
    ok = np.where((gain > 0) & (gain <= gap), gain, 0)
    k = int(np.argmax(ok))
    return k if ok[k] > 0 else -1


def _go(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, out: list[int], back: list[int], a: int, b: int) -> bool:
    where[out], where[back] = a, b
    d = int(sizes[out].sum() - sizes[back].sum())
    fill[a] += d
    fill[b] -= d
    return True


_PACKED = "limit_name string, capacity int, doc_id bigint, part_no int, tokens int, bin string, fill int"


def _round(items: DataFrame, no: int, shard_items: int) -> DataFrame:
    """The items packed in shards that a hash fills evenly; every shard holds about `shard_items`."""
    counts = {r["limit_name"]: r["n"] for r in items.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, -(-n // shard_items)))) if counts else F.create_map(F.lit(""), F.lit(1))
    salted = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(no)), F.element_at(shards, F.col("limit_name"))).cast("int"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tokens", "doc_id", "part_no"], ascending=[False, True, True], ignore_index=True)
        where = fill_bins(g["tokens"].to_numpy(np.int64), int(g["capacity"].iloc[0]))
        fill = np.bincount(where, weights=g["tokens"])
        return g.assign(bin=[f"{no}-{key[1]}-{w}" for w in where], fill=fill[where].astype(int))[["limit_name", "capacity", "doc_id", "part_no", "tokens", "bin", "fill"]]

    return salted.groupBy("limit_name", "shard").applyInPandas(run, _PACKED)


def pack(sizes: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS, full: float = FULL) -> DataFrame:
    """(limit_name, bin, doc_id, part_no, tokens): every text in a container of each limit.

    Parts as large as the container fill one alone and aren't searched. The rest are packed in shards; the
    containers that stay underfull, a few in each shard, are taken apart and packed with those of other
    shards, in rounds that have ever fewer items, until they fit one shard or nothing is gained. Null sizes
    are left out, texts without tokens lie in any container, equal rows are items of their own.
    """
    items = written(parts(sizes.where("tokens IS NOT NULL"), limits), "parts")
    whole = items.where("tokens = capacity").select("limit_name", F.concat_ws("-", F.lit("w"), F.col("row").cast("string"), F.col("part_no").cast("string")).alias("bin"), "doc_id", "part_no", "tokens")
    rest, done, before = items.where("tokens < capacity"), [whole], None
    for no in count():
        packed = written(_round(rest, no, shard_items), f"packed{no}")
        loose = packed.where(F.col("fill") < F.col("capacity") * full)
        n = loose.count()
        last = n == 0 or (before is not None and n >= before) or n <= shard_items and no > 0 and before is not None and before <= shard_items
        out = packed if last else packed.where(F.col("fill") >= F.col("capacity") * full)
        done.append(out.select("limit_name", "bin", "doc_id", "part_no", "tokens"))
        if last:
            break
        rest, before = loose.select("limit_name", "capacity", "doc_id", "part_no", "tokens"), n
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def fills(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, capacity_tokens, n_bins, n_parts, tokens, least_bins, fill_percent): how well each limit's containers are filled."""
    known = limits.groupBy("limit_name").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    t = packed.groupBy("limit_name", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    t = t.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_parts"), F.sum("tokens").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return t.join(known, "limit_name").select("limit_name", "capacity_tokens", "n_bins", "n_parts", "tokens", least.alias("least_bins"), F.round(100 * F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 3).alias("fill_percent"))
