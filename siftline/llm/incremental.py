"""New batches checked against everything accepted so far, through persisted inverted cells of full vectors.

A record's vector is the multiset of the runs of its text. Two records can only be near when they share
their block (equal project, agreeing rule and file) and the vectors overlap in at least four fifths of the
larger one. The index keeps each distinct vector of a block, source and batch once, in full, in cells:

* a block of up to CELL_VECTORS vectors is one cell;
* a larger block has a cell for each run, and a vector lies in the cells of its rarest runs, rarest first
  in the block, as many as it has to: a vector that shares none of the first n - ceil(0.8 n) + 1 runs of
  another one is farther away than the bound, whatever the rest holds. Probing stops there, by that bound
  and by the bound on the two sizes; nothing nearer is left out.

Cells lie in buckets, folders of about BUCKET_ROWS rows of the history the index was built over. A batch reads
the buckets of the cells it asks and no others, and history isn't shuffled where the batch is small enough to
be sent to it. Candidates are ranked by their exact overlap. A block that outgrows its one cell is split when
the batch that makes it too large is appended. No cell has a capacity, and nothing is approximate but for
64-bit hashes standing for runs within a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import counted_vector, digest, run_key, runs
from siftline.session import new_table_path, written

CELL_VECTORS = 64
#: Rows of history in a bucket, about, and the most buckets there may be: each is a folder.
BUCKET_ROWS, MOST_BUCKETS = 16_384, 4096
#: A batch whose cells take more bytes than this is joined by a shuffle of both sides, else it is broadcast.
BROADCAST_BYTES = 32_000_000
#: The least share of the larger multiset, as a fraction of whole numbers.
SHARE = (4, 5)


def entries(df: DataFrame, key: str, source: str, batch: str | None = None) -> DataFrame:
    """(block, n, vec, source, batch, key): what the index holds of each row. Rows with a null key or project,
    or whose evidence has no runs, can't match and are left out; null rules and files are empty ones."""
    e = df.where(F.col(key).isNotNull() & F.col("project").isNotNull()).select(
        digest(F.col("project"), run_key("rule_id"), run_key("file")).alias("block"),
        counted_vector("evidence").alias("vec"),
        F.lit(source).alias("source"),
        (F.col(batch) if batch else F.lit(None)).cast("int").alias("batch"),
        F.col(key).cast("bigint").alias("key"),
    )
    return e.select("block", F.size("vec").alias("n"), "vec", "source", "batch", "key").where("n > 0")


def _prefix(n: Column) -> Column:
    """How many of its n rarest runs a vector has to be looked up by."""
    return n - F.ceil(n * SHARE[0] / F.lit(SHARE[1])).cast("int") + 1


def cells_of(rows: DataFrame, order: DataFrame | None) -> DataFrame:
    """`rows` once for each cell they lie in, with the column cell: 0 in a small block, else a run.

    `order` has (block, run, rows) for the large blocks, None if there is none; a run that isn't there is the rarest.
    """
    if order is None:
        return rows.select("block", F.lit(0).cast("bigint").alias("cell"), "n", "vec", "source", "batch", "key")
    large = order.select("block").distinct()
    in_small = rows.join(large, "block", "left_anti").withColumn("cell", F.lit(0).cast("bigint"))
    big = rows.join(large, "block", "left_semi").withColumn("row", F.struct("vec", "source", "batch", "key"))
    said = big.select("block", "n", "row", F.explode("vec").alias("run")).join(order, ["block", "run"], "left")
    ranked = said.groupBy("block", "n", "row").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "run"))).alias("by"))
    in_large = ranked.select("block", "n", "row.*", F.explode(F.slice("by", F.lit(1), _prefix(F.col("n")))).alias("c")).select("block", "n", "vec", "source", "batch", "key", F.col("c.run").alias("cell"))
    return in_small.select("block", "cell", "n", "vec", "source", "batch", "key").unionByName(in_large)


_CELLS = "block binary, cell bigint, n int, vec array<bigint>, source string, batch int, key bigint, bucket int"
_ENTRIES = "block binary, n int, vec array<bigint>, source string, batch int, key bigint, of int"
_HITS = "accepted_key bigint, inc_key bigint, accepted_in string"
_ORDER = "block binary, run bigint, rows bigint, bucket int"


@dataclass(frozen=True)
class CellIndex:
    """The persisted index at `path`: cells (block, cell, n, vec, source, batch, key) and the order of runs in
    large blocks (block, run, rows), both in folders by bucket, and its form (buckets, cell_vectors)."""

    spark: SparkSession
    path: str

    @cached_property
    def form(self) -> tuple[int, int]:
        """(buckets, cell_vectors), as they were when the index was built."""
        return tuple(self.spark.read.schema("buckets int, cell_vectors int").parquet(f"{self.path}/form").first())

    def cells(self, buckets: list[int]) -> DataFrame:
        """The cells in the given buckets; other folders aren't read."""
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells").where(F.col("bucket").isin(buckets))

    def order(self, rows: DataFrame) -> DataFrame | None:
        """The order of runs in those buckets that hold the blocks of `rows`; None while no block is large."""
        every = self.spark.read.schema(_ORDER).parquet(f"{self.path}/order")
        if not every.inputFiles():
            return None
        at = [r["b"] for r in rows.select(self._bucket("block").alias("b")).distinct().collect()]  # no more than there are buckets
        return every.where(F.col("bucket").isin(at)).drop("bucket")

    def _bucket(self, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.form[0])).cast("int")

    def _add(self, kind: str, rows: DataFrame, *of: str) -> None:
        # rebalance splits a bucket that holds a large part of the rows
        placed = rows.withColumn("bucket", self._bucket(*of)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *of)
        placed.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{kind}")

    def _placed(self, rows: DataFrame, order: DataFrame | None) -> DataFrame:
        return cells_of(rows, order).withColumn("bucket", self._bucket("block", "cell"))

    def ask(self, rows: DataFrame) -> Ask:
        """`rows` (of entries()) once for each cell in which something near them may lie, and the buckets of these cells."""
        order = self.order(rows)
        cells = self._placed(rows, order) if order is None else written(self._placed(rows, order), "asked")
        size = cells.agg(F.collect_set("bucket").alias("buckets"), F.coalesce(F.sum(8 * F.col("n") + 100), F.lit(0)).alias("bytes")).first()
        return Ask(rows, order, cells, size["buckets"], size["bytes"])

    def probe(self, ask: Ask) -> DataFrame:
        """(accepted_key, key, source) for each row asked and each source that holds a near one: the smallest such key.

        An accepted row counts if it has no batch or a lower one than the probing row. Only the buckets of the
        cells that are asked are read.
        """
        q = ask.cells.select("block", "cell", "bucket", F.col("n").alias("q_n"), F.col("vec").alias("q_vec"), F.col("batch").alias("q_batch"), F.col("key").alias("q_key"))
        num, den = SHARE
        near = (
            self.cells(ask.buckets).join(ask.sent(q), ["bucket", "block", "cell"])
            .where(F.col("batch").isNull() | (F.col("batch") < F.col("q_batch")))
            .where((F.col("n") * den >= F.col("q_n") * num) & (F.col("q_n") * den >= F.col("n") * num))
            .where(F.size(F.array_intersect("q_vec", "vec")) * den >= F.greatest("n", "q_n") * num)
        )
        return near.groupBy("q_key", "source").agg(F.min("key").alias("accepted_key")).select("accepted_key", F.col("q_key").alias("key"), "source")

    def growing(self, ask: Ask) -> DataFrame:
        """(bucket, block) of the blocks that would have more than cell_vectors vectors in one cell with the rows asked."""
        small = ask.rows if ask.order is None else ask.rows.join(ask.order.select("block").distinct(), "block", "left_anti")
        fresh = small.groupBy("block").agg(F.count_distinct(F.xxhash64("vec")).alias("more")).withColumn("bucket", self._bucket("block", F.lit(0).cast("bigint")))
        held = self.cells(ask.buckets).where("cell = 0").select("bucket", "block").join(ask.sent(fresh), ["bucket", "block"]).groupBy("block").agg(F.count(F.lit(1)).alias("held"))
        return fresh.join(held, "block", "left").where(F.col("more") + F.coalesce("held", F.lit(0)) > self.form[1]).select("bucket", "block")

    def append(self, ask: Ask) -> CellIndex:
        """The rows asked added to the cells, as accepted; what lies in them stays as it is.

        A block that gets more than cell_vectors vectors in its one cell is split: its rows are added to cells
        by run and its order is written. The cell it had is then asked by nothing any more.
        """
        add = classes(ask.rows)
        grown = self.growing(ask)
        if not grown.isEmpty():
            grown = written(grown, "grown")
            old = self.cells(ask.buckets).where("cell = 0")
            split = written(old.join(grown, ["bucket", "block"], "left_semi").select(add.columns).unionByName(add.join(grown, "block", "left_semi")), "split")
            ranks = written(frequencies(split), "ranks")
            self._add("cells", cells_of(split, ranks), "block", "cell")
            self._add("order", ranks, "block")
            add = add.join(grown, "block", "left_anti")
        self._add("cells", cells_of(add, ask.order), "block", "cell")
        return self


@dataclass(frozen=True)
class Ask:
    """Rows, the order of their large blocks, the cells they ask, with the buckets and the bytes of these."""

    rows: DataFrame
    order: DataFrame | None
    cells: DataFrame
    buckets: list[int]
    bytes: int

    def sent(self, df: DataFrame) -> DataFrame:
        """`df`, no larger than the cells asked, to be broadcast if these are small."""
        return F.broadcast(df) if self.bytes <= BROADCAST_BYTES else df


def classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector of a block, source and batch, with the smallest key."""
    return rows.groupBy("block", "n", "vec", "source", "batch").agg(F.min("key").alias("key")).select("block", "n", "vec", "source", "batch", "key")


def frequencies(rows: DataFrame) -> DataFrame:
    """(block, run, rows): in how many rows of its block each run occurs."""
    return rows.select("block", F.explode("vec").alias("run")).groupBy("block", "run").agg(F.count(F.lit(1)).alias("rows"))


def build_index(rows: DataFrame, path: str | None = None, cell_vectors: int = CELL_VECTORS, bucket_rows: int = BUCKET_ROWS) -> CellIndex:
    """The index over `rows` (of entries()), written to `path` or a new folder of the shared one."""
    spark = rows.sparkSession
    index = CellIndex(spark, path or new_table_path(spark, "cells"))
    distinct = written(classes(rows), "classes")  # the vectors are made once
    buckets = min(MOST_BUCKETS, max(1, -(-distinct.count() // bucket_rows)))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(cell_vectors).alias("cell_vectors")).write.parquet(f"{index.path}/form")
    large = distinct.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cell_vectors).select("block")
    ranks = written(frequencies(distinct.join(large, "block", "left_semi")), "ranks")
    index._add("order", ranks, "block")
    index._add("cells", cells_of(distinct, None if ranks.isEmpty() else ranks), "block", "cell")
    return index


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """The index that another session has built and appended to."""
    return CellIndex(spark, path)


def suppressed(incoming: DataFrame, suppressions: DataFrame) -> DataFrame:
    """(accepted_key, inc_key): the smallest suppression that holds for each incoming row, where one does.

    A suppression holds when project is equal, its rule_id is null or agrees, the runs of its file are the
    last ones (or all) of the row's file, its line is null, 0 or equal, and expires is null or not before the
    UTC day of received_at; an expires that is no date holds for none. Rows and suppressions with a null project match nothing. Only suffixes as long
    as some suppression of the project are tried, by equality.
    """
    s = suppressions.where("sup_key IS NOT NULL AND project IS NOT NULL").select(
        "sup_key",
        "project",
        F.size(runs("file")).alias("n"),
        run_key("file").alias("tail"),
        F.when(F.col("rule_id").isNotNull(), run_key("rule_id")).alias("s_rule"),
        F.when(F.col("line") != 0, F.col("line")).alias("s_line"),
        F.col("expires").isNull().alias("lasting"),
        F.try_to_date(F.col("expires"), "yyyy-MM-dd").alias("until"),
    )
    s = s.groupBy("project", "n", "tail", "s_rule", "s_line", "lasting", "until").agg(F.min("sup_key").alias("sup_key"))
    lengths = s.groupBy("project").agg(F.collect_set("n").alias("lengths"))
    i = incoming.where("inc_key IS NOT NULL").select("inc_key", "project", run_key("rule_id").alias("rule"), "line", F.to_date("received_at").alias("day"), runs("file").alias("parts"))
    i = i.join(lengths, "project").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.size("parts"))))
    i = i.withColumn("tail", F.array_join(F.slice("parts", F.size("parts") - F.col("n") + 1, F.col("n")), " "))
    holds = (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule"))) & (F.col("s_line").isNull() | (F.col("s_line") == F.col("line"))) & (F.col("lasting") | (F.col("until") >= F.col("day")))
    return i.join(s, ["project", "n", "tail"]).where(holds).groupBy("inc_key").agg(F.min("sup_key").alias("accepted_key")).select("accepted_key", "inc_key")


def repeats(findings: DataFrame, incoming: DataFrame, suppressions: DataFrame, index: CellIndex | None = None) -> DataFrame:
    """(accepted_key, inc_key, accepted_in): what each incoming row repeats of findings, earlier batches and suppressions.

    Without an `index`, one is built over findings; a given one already holds them and all batches before these.
    Batch after batch then probes it and is appended, in the order of batch_no. Rows without a batch_no are
    checked against findings alone and accepted by none. Empty tables give no rows.
    """
    index = index or build_index(entries(findings, "finding_key", "findings"))
    path = new_table_path(incoming.sparkSession, "asked")
    entries(incoming, "inc_key", "incoming_findings", "batch_no").withColumn("of", F.col("batch")).hint("rebalance", "of").write.partitionBy("of").parquet(path)
    asked = incoming.sparkSession.read.schema(_ENTRIES).parquet(path)
    hits = new_table_path(incoming.sparkSession, "hits")
    numbers = [r["of"] for r in asked.select("of").distinct().collect()]  # one for each batch
    for b in sorted(numbers, key=lambda b: (b is not None, b)):
        ask = index.ask(asked.where(F.col("of").eqNullSafe(b)).drop("of"))
        hit = index.probe(ask).select("accepted_key", F.col("key").alias("inc_key"), F.col("source").alias("accepted_in"))
        hit.write.mode("append").parquet(hits)
        if b is not None:
            index.append(ask)
    found = incoming.sparkSession.read.schema(_HITS).parquet(hits) if numbers else incoming.sparkSession.createDataFrame([], _HITS)
    return found.unionByName(suppressed(incoming, suppressions).withColumn("accepted_in", F.lit("suppressions")))
