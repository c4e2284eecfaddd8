"""Suppression files, scan settings and advisory imports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.documents import as_array, as_list, as_object, member, plain_json, text_of
from siftline.operators.nested import classified, flat_tables
from siftline.session import written

MODES, FORMATS = ("full", "changed"), ("terminal", "json", "html", "sarif")


@dataclass(frozen=True)
class ScanSettings:
    """Settings with their defaults; unknown keys of a file are ignored, wrong values raise."""

    block_on: tuple[str, ...] = ("CRITICAL", "HIGH")
    scan_mode: str = "full"
    dependency_scan: bool = True
    secret_scan: bool = True
    source_scan: bool = True
    report_format: str = "terminal"
    fail_closed: bool = False
    exclude: tuple[str, ...] = field(default=("*.md", "tests", "docs"))

    @classmethod
    def load(cls, path: str) -> ScanSettings:
        """The settings of a JSON file; the defaults if there is none."""
        p = Path(path)
        if not p.exists():
            return cls()
        given = json.loads(p.read_text())
        known = {f.name for f in fields(cls)}
        s = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
        if s.scan_mode not in MODES or s.report_format not in FORMATS or not set(s.block_on) <= {"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}:
            raise ValueError(f"invalid settings in {path}")
        return s


def suppressions_from_json(files: DataFrame, text: str = "content") -> DataFrame:
    """(project, rule_id, file, line, reason, expires, problem) of baseline files, an array or {"suppressions": [...]}.

    problem is null for a valid entry, else what is wrong: an entry needs a rule_id or a file and a real date;
    a file that isn't valid gives one row with the problem `malformed`.
    """
    v = files.select("project", F.try_parse_json(plain_json(text)).alias("v"))
    inner = F.coalesce(F.when(as_object(F.col("v")).isNotNull(), member(F.col("v"), "suppressions")), F.col("v"))
    x = v.select("project", F.explode_outer(as_list(inner)).alias("e"), F.col("v").isNull().alias("broken"))
    t = {k: text_of(member(F.col("e"), k)) for k in ("rule_id", "file", "line", "reason", "expires")}
    x = x.select("project", "broken", F.col("e").isNotNull().alias("some"), *(c.alias(k) for k, c in t.items())).where("broken OR some")
    date = F.try_to_date("expires", "yyyy-MM-dd")
    neither = (F.coalesce("rule_id", F.lit("")) == "") & (F.coalesce("file", F.lit("")) == "")
    problem = F.when(F.col("broken"), "malformed").when(neither, "neither rule nor file").when((F.coalesce("expires", F.lit("")) != "") & date.isNull(), "bad date")
    return x.select("project", "rule_id", "file", F.col("line").try_cast("int").alias("line"), "reason", "expires", problem.alias("problem"))


def advisory_records(raw: DataFrame) -> DataFrame:
    """(raw_id, vuln_pos, affected_pos, id, package, ecosystem, summary, aliases, fixed_versions, n_ranges): one record for each affected package of the documents."""
    t = flat_tables(raw, written(classified(raw), "classified"))
    fixed = t["events_fixed"].groupBy("raw_id", "vuln_pos", "affected_pos").agg(F.array_sort(F.collect_set("version_text")).alias("fixed_versions"))
    n = t["ranges"].groupBy("raw_id", "vuln_pos", "affected_pos").agg(F.count(F.lit(1)).alias("n_ranges"))
    v = t["vulnerabilities"].select("raw_id", "vuln_pos", F.col("vuln_id").alias("id"), "summary", "aliases")
    keys = ["raw_id", "vuln_pos", "affected_pos"]
    a = t["affected"].where("package <> ''").select(*keys, "package", "ecosystem").join(v, ["raw_id", "vuln_pos"])
    a = a.join(fixed, keys, "left").join(n, keys, "left")
    return a.select(*keys, "id", "package", "ecosystem", "summary", "aliases", F.coalesce("fixed_versions", F.array().cast("array<string>")).alias("fixed_versions"), F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"))


def advisory_ratings(raw: DataFrame) -> DataFrame:
    """(raw_id, vuln_pos, severity, cwes, cvss): what each vulnerability of the documents says of its weight.

    severity is that of database_specific in upper case, MEDIUM without one; cwes are its texts; cvss is the
    score of the first entry of severity whose type speaks of CVSS, '' without one.
    """
    v = raw.select("raw_id", F.try_parse_json(plain_json("payload")).alias("v")).withColumn("w", member(F.col("v"), "vulns"))
    wrapped = as_array(F.col("w")).isNotNull() | as_object(F.col("w")).isNotNull()
    x = v.select("raw_id", F.posexplode_outer(as_list(F.when(wrapped, F.col("w")).otherwise(F.col("v")))).alias("vuln_pos", "x")).where("vuln_pos IS NOT NULL")
    own = member(F.col("x"), "database_specific")
    texts = F.array_compact(F.transform(as_list(member(own, "cwe")), text_of))
    rated = F.filter(F.transform(as_list(member(F.col("x"), "severity")), lambda e: F.struct(text_of(member(e, "type")).alias("type"), text_of(member(e, "score")).alias("score"))), lambda e: F.upper(e["type"]).contains("CVSS"))
    severity = F.upper(F.coalesce(F.nullif(text_of(member(own, "severity")), F.lit("")), F.lit("MEDIUM")))
    return x.select("raw_id", "vuln_pos", severity.alias("severity"), texts.alias("cwes"), F.coalesce(F.get(rated, 0)["score"], F.lit("")).alias("cvss"))


def from_json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_id, payload) of every JSON file below a folder; raw_id is made from the path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return f.select(F.xxhash64("path").alias("raw_id"), F.col("content").cast("string").alias("payload"))
