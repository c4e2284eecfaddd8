"""Graphs over code: imports and calls resolved, call edges, levels and paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.code import module_name
from siftline.session import cut, written

#: Fixed value: edges of the longest path that is followed.
MAX_PATH = 8


def resolved_imports(facts: DataFrame) -> DataFrame:
    """(project, rel_path, line, module, target): the project's file that each import names.

    Tried in this order: the module's path from the root, its path from the importing file's folder, a file
    whose path ends with it, a file with its last part as a stem that no other file has. The first that
    exists counts, then the first path by name.
    """
    files = facts.select("project", F.col("rel_path").alias("target")).distinct().withColumn("dotted", module_name(F.col("target")))
    clean = F.regexp_replace(F.regexp_replace("name", r"^(?:\./|\.)+", ""), r"[/\\:]+", ".")
    folder = F.regexp_replace(module_name(F.col("rel_path")), r"\.?[^.]*$", "")
    i = facts.where("kind = 'import'").select("project", "rel_path", "line", F.col("name").alias("module"), clean.alias("m"), folder.alias("folder")).where("m <> ''")
    exact = i.select("project", "rel_path", "line", "module", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("m").alias("dotted")), F.struct(F.lit(2).alias("p"), F.concat_ws(".", "folder", "m").alias("dotted")))).alias("x"))
    exact = exact.select("project", "rel_path", "line", "module", "x.*").join(files, ["project", "dotted"]).drop("dotted")
    stem = lambda c: F.element_at(F.split(c, r"\."), -1)
    last = i.withColumn("stem", stem("m")).join(files.withColumn("stem", stem("dotted")), ["project", "stem"])
    tail = last.where(F.endswith("dotted", F.concat(F.lit("."), "m"))).select("project", "rel_path", "line", "module", F.lit(3).alias("p"), "target")
    only = files.withColumn("stem", stem("dotted")).groupBy("project", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    lone = i.withColumn("stem", stem("m")).join(only, ["project", "stem"]).select("project", "rel_path", "line", "module", F.lit(4).alias("p"), "target")
    found = exact.unionByName(tail).unionByName(lone).where(F.col("target") != F.col("rel_path"))
    return found.groupBy("project", "rel_path", "line", "module").agg(F.min_by("target", F.struct("p", "target")).alias("target"))


def call_edges(facts: DataFrame) -> DataFrame:
    """(project, caller_file, caller, line, callee_file, callee): each call of a function that the project defines.

    Tried in this order: a function of the same file, a function of an imported file, the only function of
    that name in the project.
    """
    short = F.element_at(F.split("name", r"\."), -1)
    calls = facts.where("kind = 'call'").select("project", "rel_path", F.col("func").alias("caller"), "line", short.alias("callee"))
    defs = facts.where("kind = 'function'").select("project", F.col("rel_path").alias("callee_file"), F.col("name").alias("callee")).distinct()
    local = calls.join(defs.withColumn("rel_path", F.col("callee_file")), ["project", "rel_path", "callee"]).withColumn("p", F.lit(1))
    imported = resolved_imports(facts).select("project", "rel_path", F.col("target").alias("callee_file")).distinct()
    through = calls.join(imported, ["project", "rel_path"]).join(defs, ["project", "callee_file", "callee"]).withColumn("p", F.lit(2))
    only = defs.groupBy("project", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("callee_file").alias("callee_file")).where("n = 1").drop("n")
    lone = calls.join(only, ["project", "callee"]).withColumn("p", F.lit(3))
    cols = ["project", "rel_path", "caller", "line", "callee", "callee_file", "p"]
    found = local.select(cols).unionByName(through.select(cols)).unionByName(lone.select(cols))
    best = found.groupBy("project", "rel_path", "caller", "line", "callee").agg(F.min_by("callee_file", F.struct("p", "callee_file")).alias("callee_file"))
    return best.select("project", F.col("rel_path").alias("caller_file"), "caller", "line", "callee_file", "callee")


def paths_to(edges: DataFrame, sinks: DataFrame, most: int = MAX_PATH, sources: DataFrame | None = None) -> DataFrame:
    """(project, start, sink, path): every way of at most `most` edges that ends in a sink and begins at a source or can't be begun earlier.

    `edges` has (project, a, b), `sinks` and `sources` (project, node). Ways are grown backwards; a node occurs
    once in a way; parallel edges count once. A way comes out when it begins at a source or no caller is left
    to put in front of it; one that begins at a source is grown further too.
    """
    e = edges.select("project", F.col("a").alias("from"), F.col("b").alias("head")).where("a <> b").distinct()
    ways = cut(sinks.select("project", F.col("node").alias("sink"), F.col("node").alias("head"), F.array("node").alias("path")).distinct())
    x = e.withColumnsRenamed({"project": "p", "head": "h"})
    more = (F.col("project") == F.col("p")) & (F.col("head") == F.col("h")) & ~F.array_contains("path", F.col("from"))

    def begun(ways: DataFrame) -> DataFrame:
        longer = ways.where(F.size("path") > 1)
        ended = longer.join(x, more, "left_anti")
        return ended if sources is None else ended.unionByName(longer.join(sources.select("project", F.col("node").alias("head")), ["project", "head"], "left_semi").select(ended.columns))

    done = begun(ways)
    for _ in range(most):
        ways = ways.join(e, ["project", "head"]).where(~F.array_contains("path", F.col("from")))
        ways = cut(ways.select("project", "sink", F.col("from").alias("head"), F.concat(F.array("from"), "path").alias("path")))
        if ways.isEmpty():
            break
        done = done.unionByName(begun(ways))
    return done.select("project", F.col("head").alias("start"), "sink", "path").distinct()


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, node, depth): the fewest edges from any root. Each round sends only the newly reached nodes, until there are none."""
    e = written(edges.select("project", F.col("a").alias("node"), F.col("b").alias("next")).distinct(), "level-edges")
    seen = front = written(roots.select("project", "node", F.lit(0).alias("depth")).distinct(), "level")
    for k in count(1):
        new = front.join(e, ["project", "node"]).select("project", F.col("next").alias("node"), F.lit(k).alias("depth")).distinct()
        front = written(new.join(seen, ["project", "node"], "left_anti"), "level")
        if front.isEmpty():
            return seen
        seen = gathered(seen.unionByName(front), k)


def gathered(parts: DataFrame, k: int, most: int = 16) -> DataFrame:
    """The table that `parts` of rounds make up, written as one after each `most` of them, so that plans stay small."""
    return parts if k % most else written(parts, "gathered")


def flow_edges(findings: DataFrame) -> DataFrame:
    """(project, a, b): the distinct steps of all data flows."""
    flow = F.col("data_flow")
    pairs = F.filter(F.transform(flow, lambda x, i: F.struct(x.alias("a"), F.get(flow, i + 1).alias("b"))), lambda p: p["b"].isNotNull() & p["a"].isNotNull())
    return findings.where("project IS NOT NULL AND data_flow IS NOT NULL").select("project", F.explode(pairs).alias("p")).select("project", "p.a", "p.b").distinct()
