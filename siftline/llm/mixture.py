"""Sources blended to target shares by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import written

#: Tokens of a block.
BLOCK_TOKENS = 64
#: Rows that one window of a running total holds, about.
CHUNK = 8192
#: Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def clean_source(c: Column | str) -> Column:
    """A source's name in lower case, without outer blanks, with '_' for hyphens and blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-\s]+", "_")


def running_total(df: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str], value: str, to: str) -> DataFrame:
    """`df` with the sum of `value` over the rows before each one, within `by`, ordered by chunk and `order`.

    Chunks are summed first, then the few sums are added up, then each chunk's own rows: no window holds more
    than one chunk or one row per chunk.
    """
    sums = df.groupBy(*by, chunk).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(ahead, [*by, chunk]).withColumn(to, F.col("_ahead") + F.col("_own")).drop("_ahead", "_own")


def tape(sizes: DataFrame, seed: int = 17) -> DataFrame:
    """(source, doc_id, tokens, begins): each source's texts in shuffled order, laid end to end; `begins` counts tokens.

    Texts without tokens or source are left out; equal rows are texts of their own.
    """
    s = sizes.where("tokens > 0 AND source IS NOT NULL").withColumn("mixed", F.xxhash64("doc_id", F.lit(seed)))
    n = s.count()
    s = s.withColumn("chunk", F.floor((F.col("mixed").cast("double") / float(2**64) + 0.5) * max(1, n // CHUNK)).cast("int"))
    return running_total(s, ["source"], "chunk", ["mixed", "doc_id"], "tokens", "begins").select("source", "doc_id", "tokens", "begins")


def schedule(stock: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, slot, source, block, total, max_repeats): which block of which source fills each slot.

    `stock` has (source, total), `targets` (mix_name, source, target_share, max_repeats), one row each.
    Slot i goes to the source in whose part of the cumulative shares the point frac((i + 1/2) * golden ratio)
    lies. A source's slots take its blocks in order; a block is `block_tokens` of the source's tape, which
    begins again where it ends. A mix is as long as it can be before a source would be used more than
    max_repeats times. Sources without texts or repeats keep their slots, which stay empty, and don't limit the mix.
    """
    w = Window.partitionBy("mix_name").orderBy("source")
    total = F.sum("target_share").over(Window.partitionBy("mix_name"))
    t = targets.join(stock, "source", "left").withColumns({"part": F.col("target_share") / total, "total": F.when(F.col("max_repeats") > 0, F.col("total"))})
    t = t.withColumn("upto", F.sum("part").over(w)).withColumn("least", F.col("upto") - F.col("part"))
    t = t.withColumn("uses", F.when(F.col("total") > 0, F.greatest(F.lit(1), F.floor(F.col("max_repeats") * F.col("total") / block_tokens))))
    longest = F.when(F.col("uses") > 0, F.floor((F.col("uses") + 3) / F.col("part")))
    mixes = t.groupBy("mix_name").agg(
        F.min(longest).cast("bigint").alias("slots"),
        F.sort_array(F.collect_list(F.struct("upto", "source", "least", "total", "uses", "max_repeats"))).alias("parts"),
    )
    chunks = mixes.where("slots > 0").select("mix_name", "slots", "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    spread = chunks.repartition("mix_name", "chunk").withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)))
    x = (F.col("slot") + F.lit(0.5)) * F.lit(GOLDEN)
    at = x - F.floor(x)
    hit = F.coalesce(F.get(F.filter("parts", lambda p: p["upto"] > at), 0), F.element_at("parts", -1))
    s = spread.select("mix_name", "chunk", "slot", hit.alias("p")).select("mix_name", "chunk", "slot", "p.source", "p.total", "p.uses", "p.max_repeats", F.lit(1).alias("one"))
    s = written(running_total(s, ["mix_name", "source"], "chunk", ["slot"], "one", "block"), "slots")
    ends = s.where("uses > 0 AND block >= uses").groupBy("mix_name").agg(F.min("slot").alias("end"))
    s = s.join(F.broadcast(ends), "mix_name", "left").where("end IS NULL OR slot < end").where("total > 0")  # one row for each mix
    return s.select("mix_name", "slot", "source", "block", "total", "max_repeats")


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row for each mix and source: the shares added up, the smallest max_repeats. Rows with nulls or without a positive share are left out."""
    t = targets.where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats IS NOT NULL")
    return t.groupBy("mix_name", clean_source("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def blend(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_name, slot, source, copy_no, doc_id, tokens): the texts of each mix in its order; copy_no counts from 0.

    A text comes whole, in the slot of the block in which its middle lies: what a source gives up to any slot
    differs from the slot's place on its tape by half a text at most, and by nothing on average.
    """
    texts = written(tape(sizes), "tape")
    slots = written(schedule(texts.groupBy("source").agg(F.sum("tokens").alias("total")), clean_targets(targets), block_tokens), "schedule")
    last = slots.groupBy("mix_name", "source", "total", "max_repeats").agg(F.max("block").alias("last"))  # one row for each target
    copies = F.least(F.col("max_repeats") - 1, F.floor((F.col("last") + 1) * block_tokens / F.col("total")).cast("int"))
    x = texts.join(last, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies)))
    middle = F.col("copy_no") * F.col("total") + F.col("begins") + F.col("tokens") / 2
    x = x.withColumn("block", F.floor(middle / block_tokens)).where("block <= last")
    return slots.select("mix_name", "source", "block", "slot").join(x, ["mix_name", "source", "block"]).select("mix_name", "slot", "source", "copy_no", "doc_id", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, n_texts, most_copies) of every target, reached or not."""
    t = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_texts"), (F.max("copy_no") + 1).alias("most_copies"))
    all_ = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    j = clean_targets(targets).join(t, ["mix_name", "source"], "left")
    share = F.when(all_ > 0, F.round(F.coalesce("tokens", F.lit(0)) / all_, 6)).otherwise(F.lit(0.0))
    return j.select("mix_name", "source", F.round("target_share", 6).alias("target_share"), share.alias("actual_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_texts", "most_copies")))
