"""Operators with an exact result: against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftline.llm import canonical, components, incremental, representative

T = [datetime(2026, 1 + i, 1, tzinfo=timezone.utc) for i in range(9)]
runs = lambda s: re.findall("[a-z0-9]+", (s or "").lower())

FOUND = "finding_key bigint, project string, canonical_rule string, line int, file string, severity string, confidence string, cwe string, detector_ids array<string>, scanned_at timestamp"
TRUST = [("a", "x", 90), ("b", "x", 10), ("b", "x", 20), (None, "x", 99), ("n", "x", None)]


def detectors(spark):
    return spark.createDataFrame(TRUST, "detector_id string, engine string, trust int")


def rows(spark, *r):
    return spark.createDataFrame(list(r), FOUND)


def test_representative_takes_the_first_usable_value(spark):
    f = rows(
        spark,
        (1, "p", "r", 5, "a/b.py", "??", None, "no info", ["b"], T[0]),
        (2, "p", "r", 5, "A\\b.PY", " high", "Low (12)", " cwe_0089", ["a", "z", None], T[1]),
        (3, "p", "r", 5, "./a/b.py", "CRITICAL", "MEDIUM", "79", ["b"], T[2]),
        (4, "p", "r", 5, "a/b.py", "LOW", "HIGH", "CWE-1", ["a"], T[1]),  # ties with 2 in trust and time: the larger key leads
        (5, "p", "r", 0, "a/b.py", "LOW", None, None, None, T[1]),
        (6, "p", None, 5, "a/b.py", "LOW", None, None, None, T[1]),
        (7, "q", "r", 5, None, None, None, None, None, None),
        (8, "q", "r", 5, "", "n/a", "", "CWE-0", [], T[1]),
        (9, "q", "r", 6, "", "INFO", "", "", [], T[1]),
        (None, "p", "r", 5, "a/b.py", "INFO", None, None, None, T[1]),
    ).withColumns({"g": F.lit("clash"), "trust": F.lit(-5), "value": F.lit("v"), "field": F.lit("f")})
    got = {r.group_key: tuple(r)[1:] for r in representative.defects(f, detectors(spark), "lead").collect()}
    assert got == {1: (4, "LOW", "HIGH", "CWE-1", "a,b,z"), 7: (2, "", "", "", "")}
    assert representative.defects(f.limit(0), detectors(spark), "lead").count() == 0
    assert representative.defects(f, detectors(spark).limit(0), "lead").count() == 2


def test_votes_add_up_and_age(spark):
    f = rows(
        spark,
        (1, "p", "r", 1, "a", "HIGH", None, None, ["b"], T[8]),
        (2, "p", "r", 1, "a", "HIGH", None, None, ["b"], T[8]),
        (3, "p", "r", 1, "a", "LOW", None, None, ["b"], T[8]),
        (4, "p", "r", 1, "a", "CRITICAL", None, None, ["a"], T[0]),
    )
    assert representative.defects(f, detectors(spark), "votes").first().severity == "HIGH"  # 2 x 20 recent beat 90 that are eight half-lives older
    assert representative.defects(f, detectors(spark), "lead").first().severity == "CRITICAL"


def test_many_detectors_are_joined(spark):
    f = rows(spark, (1, "p", "r", 1, "a", None, None, None, ["b", "a"], T[0]), (2, "p", "r", 1, "a", None, None, None, None, T[0]))
    for most in (1, 1000):
        got = {r.finding_key: r.trust for r in representative.with_trust(f, detectors(spark), "finding_key", most=most).collect()}
        assert got == {1: 90, 2: 0}


RAW = "finding_key bigint, project string, rule_id string, file string, line int, evidence string"


def test_format_duplicates(spark):
    f = spark.createDataFrame(
        [
            (1, "p", "VG-1", "a/b.py", 1, "x = Y(1)"), (2, "p", "vg 1", "./A/B.py", 1, "Y 1 x"), (3, "p", "VG-1", "a/b.py", 1, "x = Y(1)"), (4, "p", "VG-1", "a/b.py", 1, "x x Y 1"),
            (5, "p", None, None, None, None), (6, "p", "--", "", None, "  "), (7, None, "VG-1", "a", 1, "z"), (8, None, "VG-1", "a", 1, "z"), (9, "p", "VG-1", "a/b.py", 2, "x = Y(1)"), (None, "p", "VG-1", "a/b.py", 1, "x = Y(1)"),
            (10, "p", "L", "l", 1, "word " * 50_000), (11, "p", "L", "l", 1, "WORD\n" * 50_000),
        ],
        RAW,
    ).withColumns({"canon": F.lit(1), "raw": F.lit(2), "group_key": F.lit(3), "n": F.lit(4)})
    got = {(r.group_key, r.finding_key) for r in canonical.members(f, "finding_key", *canonical.finding_forms()).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (5, 5), (5, 6), (7, 7), (7, 8), (10, 10), (10, 11)}
    n = {r.group_key: (r.n_raw, r.n_rows) for r in canonical.collapse(f, "finding_key", *canonical.finding_forms()).collect()}
    assert n[1] == (2, 3) and n[10] == (2, 2) and n[7] == (1, 2) and n[4] == (1, 1)
    assert canonical.members(f.limit(0), "finding_key", *canonical.finding_forms()).count() == 0


def union_find(pairs):
    at = {}
    find = lambda x: x if at.setdefault(x, x) == x else find(at[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(at)}


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_hash_to_min(spark, shape):
    r = random.Random(5)
    ids = r.sample(range(10_000), 300)
    pairs = {
        "path": list(zip(ids, ids[1:], strict=False)),
        "star": [(ids[7], x) for x in ids] * 2,
        "random": [(r.choice(ids), r.choice(ids)) for _ in range(170)],
        "loops": [(x, x) for x in ids[:5]] + [(ids[0], ids[1]), (ids[1], ids[0])],
    }[shape]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "v bigint, u bigint").withColumn("m", F.lit(0))
    got = {x.vertex: x.root for x in components.hash_to_min(df).collect()}
    assert got == union_find(pairs)


def test_hash_to_min_of_nothing(spark):
    assert components.hash_to_min(spark.createDataFrame([], "v bigint, u bigint")).count() == 0


def test_alias_groups(spark):
    a = spark.createDataFrame(
        [
            (1, "CVE-2020-1", None), (2, None, ["cve 2020", "X9"]), (3, "x-9", []), (4, "GH1", ["cve20201; none", None]), (5, "n/a", ["unknown", "0-0"]), (6, "N/A", ["000"]),
            (7, "Q7", ["Q7"]), (8, None, None), (9, "z1|y", ["z1"]), (10, "", ["Z-1 , w3"]), (None, "Q7", None), (11, "longer " * 5000 + "5", None),
        ],
        "adv_key bigint, id string, aliases array<string>",
    ).withColumns({"ident": F.lit(1), "root": F.lit(1), "first": F.lit(1), "n": F.lit(1)})
    got = {(r.group_key, r.adv_key) for r in components.vulnerability_groups(a).collect()}
    assert got == {(1, 1), (1, 4), (2, 2), (2, 3), (9, 9), (9, 10)}
    assert components.vulnerability_groups(a.limit(0)).count() == 0


IN = "inc_key bigint, batch_no int, received_at timestamp, project string, rule_id string, file string, line int, evidence string"
SUP = "sup_key bigint, project string, rule_id string, file string, line int, expires string"


def near(x, y):
    a, b = Counter(runs(x)), Counter(runs(y))
    return a and b and 5 * (a & b).total() >= 4 * max(a.total(), b.total())


def brute(found, incoming):
    out = {}
    for k, b, _, p, rule, file, _, ev in incoming:
        for src, rows_ in (("findings", [(x[0], None, *x[1:]) for x in found]), ("incoming_findings", [(x[0], x[1], x[3], x[4], x[5], x[6], x[7]) for x in incoming])):
            hits = [x[0] for x in rows_ if (x[1] is None or x[1] < b) and x[2] == p and p is not None and runs(x[3]) == runs(rule) and runs(x[4]) == runs(file) and near(x[6], ev)]
            if hits:
                out[k, src] = min(hits)
    return out


@pytest.mark.parametrize("cell_vectors", [2, 4, 64])
def test_batches_against_history(spark, cell_vectors):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(r.choices(words, k=r.randint(1, 9)))
    found = [(i, r.choice(["p", "q", None]), r.choice(["R-1", "r 1", None]), r.choice(["a/b", "A\\B"]), 1, r.choice([text(), text(), "", None])) for i in range(150)]
    incoming = [(1000 + i, 1 + i // 20, T[0], r.choice(["p", "q"]), r.choice(["R-1", None]), "a.b", 1, text()) for i in range(80)]
    f = spark.createDataFrame(found, RAW).withColumns({"vec": F.lit(1), "block": F.lit(2), "cell": F.lit(3)})
    i = spark.createDataFrame(incoming, IN).withColumns({"n": F.lit(1), "key": F.lit(2), "batch": F.lit(3)})
    asked = incremental.entries(i, "inc_key", "incoming_findings", "batch_no")
    index = incremental.build_index(incremental.entries(f, "finding_key", "findings").unionAll(asked), cell_vectors=cell_vectors)
    whole = {(x.key, x.source): x.accepted_key for x in index.probe(index.ask(asked)).collect()}
    assert whole == brute(found, incoming)
    # the same batch after batch: probe, then append
    index = incremental.build_index(incremental.entries(f, "finding_key", "findings"), cell_vectors=cell_vectors, bucket_rows=20)
    got = incremental.repeats(f, i, spark.createDataFrame([], SUP), index)
    assert {(x.inc_key, x.accepted_in): x.accepted_key for x in got.collect()} == whole
    again = incremental.open_index(spark, index.path)  # what another session finds
    assert {(x.key, x.source): x.accepted_key for x in again.probe(again.ask(asked)).collect()} == whole


def test_a_block_that_outgrows_its_cell_is_split(spark):
    words = [f"w{i}" for i in range(40)]
    r = random.Random(8)
    text = lambda: " ".join(r.sample(words, 8))
    found = [(1, "p", "R", "f", 1, text()), (2, "q", "R", "f", 1, text())]
    incoming = [(100 + k, 1 + k // 10, T[0], "p", "R", "f", 1, text()) for k in range(60)]
    incoming += [(200 + k, 7, T[0], "p", "R", "f", 1, incoming[k * 5][7]) for k in range(12)]
    f, i = spark.createDataFrame(found, RAW), spark.createDataFrame(incoming, IN)
    index = incremental.build_index(incremental.entries(f, "finding_key", "findings"), cell_vectors=8)
    got = incremental.repeats(f, i, spark.createDataFrame([], SUP), index)
    assert {(x.inc_key, x.accepted_in): x.accepted_key for x in got.collect()} == brute(found, incoming)
    cells = spark.read.parquet(f"{index.path}/cells").where("cell <> 0").groupBy("block", "cell").count()
    assert cells.count() > 8 and cells.agg(F.max("count")).first()[0] < 72


def test_a_batch_reads_its_own_buckets_only(spark):
    from pathlib import Path

    def history(n):
        return spark.range(n).select(F.col("id").alias("finding_key"), F.concat(F.lit("p"), F.col("id") % 997).alias("project"), F.lit("R").alias("rule_id"), F.concat(F.lit("f"), F.col("id") % 31).alias("file"), F.lit(1).alias("line"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.lit("a b c d e f")).alias("evidence"))

    i = spark.createDataFrame([(-1, 1, T[0], "p5", "R", "f5", 1, "x"), (-2, 1, T[0], "p9", "r", "f9", 1, "y")], IN)
    asked = incremental.entries(i, "inc_key", "incoming_findings", "batch_no")
    read = []
    for n in (4_000, 16_000):
        index = incremental.build_index(incremental.entries(history(n), "finding_key", "findings"), bucket_rows=500)
        at = index.ask(asked).buckets
        scan = index.cells(at)._jdf.queryExecution().executedPlan().toString()
        assert index.form[0] == n // 500 and len(at) <= 2 and "PartitionFilters: [bucket" in scan
        read.append(sum(Path(x.f.removeprefix("file://")).stat().st_size for x in index.cells(at).select(F.input_file_name().alias("f")).distinct().collect()))
    assert read[1] < 2 * read[0]  # four times the history, no more bytes for the batch


def test_suppressions_and_edges(spark):
    s = spark.createDataFrame(
        [
            (1, "p", None, "b.py", None, None), (2, "p", "R 1", "a/b.py", 0, "2026-01-01"), (3, "p", "R-1", "b.py", 7, "2025-12-31"), (4, "p", "R-1", "B.PY", 7, None), (5, None, None, "b.py", None, None),
            (6, "q", None, None, None, "never"), (7, "q", None, None, None, None), (8, "q", None, None, None, None), (9, "p", "", "b.py", None, None),
        ],
        SUP,
    )
    i = spark.createDataFrame(
        [(10, 1, T[0], "p", "R-1", "x/a/b.py", 7, "e"), (11, 1, T[0], "p", "R-2", "xb.py", 7, "e"), (12, 1, T[0], "q", None, None, None, None), (13, None, T[0], "p", "R-1", "a/b.py", 3, "e"), (14, 1, None, "p", "R-1", "b.py", 7, "e"), (None, 1, T[0], "p", "R-1", "b.py", 7, "e")],
        IN,
    )
    got = {(r.accepted_key, r.inc_key) for r in incremental.suppressed(i, s).collect()}
    assert got == {(1, 10), (7, 12), (1, 13), (1, 14)}
    only = {(r.accepted_key, r.inc_key) for r in incremental.suppressed(i, s.where("sup_key IN (2, 3, 4)")).collect()}
    assert only == {(2, 10), (2, 13), (4, 14)}
    f = spark.createDataFrame([], RAW)
    assert {(r.inc_key, r.accepted_in) for r in incremental.repeats(f, i, s).collect()} == {(k, "suppressions") for k in (10, 12, 13, 14)}
    assert incremental.repeats(f, i.limit(0), s.limit(0)).count() == 0


def test_very_long_evidence_is_matched_whole(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    f = spark.createDataFrame([(1, "p", "R", "f", 1, long)], RAW)
    i = spark.createDataFrame([(9, 1, T[0], "p", "R", "f", 1, long.replace("w1", "v1")), (8, 1, T[0], "p", "R", "f", 1, " ".join(f"w{k}" for k in range(25_000)))], IN)
    got = {r.inc_key for r in incremental.repeats(f, i, spark.createDataFrame([], SUP)).collect()}
    assert got == {8}
