"""Findings as reports: SARIF results and rules, JSON lines, an HTML page, and the written tables behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.findings import clean_severity

# Risk categories of 2021 by weakness.
RISKS = {
    "A03:2021-Injection": ("CWE-89", "CWE-78", "CWE-95", "CWE-79"),
    "A02:2021-Cryptographic Failures": ("CWE-295", "CWE-327", "CWE-319"),
    "A07:2021-Identification and Authentication Failures": ("CWE-798", "CWE-259", "CWE-330", "CWE-916"),
    "A05:2021-Security Misconfiguration": ("CWE-489", "CWE-942", "CWE-668", "CWE-614", "CWE-1188", "CWE-347"),
    "A08:2021-Software and Data Integrity Failures": ("CWE-502",),
    "A10:2021-Server-Side Request Forgery": ("CWE-918",),
    "A01:2021-Broken Access Control": ("CWE-250", "CWE-200", "CWE-552", "CWE-22"),
}


def risk_category(cwe: Column) -> Column:
    """The risk category of a weakness, case and outer blanks aside; '' without one."""
    of = F.create_map(*(F.lit(x) for risk, cwes in RISKS.items() for c in cwes for x in (c, risk)))
    return F.coalesce(F.element_at(of, F.upper(F.trim(cwe))), F.lit(""))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(finding_key, result): each finding as a SARIF 2.1.0 result in JSON; lines start at 1, the message tells weakness and data flow."""
    e = F.lit("")
    cwe = F.when(F.coalesce("cwe", e) != "", F.concat(F.lit(" ["), "cwe", F.lit("]"))).otherwise("")
    text = F.when((F.coalesce("description", e) != "") & (F.col("description") != F.col("title")), F.concat("title", F.lit(": "), "description")).otherwise(F.col("title"))
    steps = F.when(F.size("data_flow") > 0, F.concat(F.lit("\nData Flow Provenance:\n"), F.array_join(F.transform("data_flow", lambda s: F.concat(F.lit("  -> "), s, F.lit("\n"))), ""))).otherwise("")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.coalesce("rule_id", "id").alias("ruleId"), sarif_level(clean_severity("severity")).alias("level"), F.struct(F.concat(text, cwe, steps).alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("finding_key", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule, name, level, tags, help_uri): the rules of a report, each as its first finding (by key) has it."""
    first = findings.groupBy(F.coalesce("rule_id", "id").alias("rule")).agg(F.min_by(F.struct("title", "severity", "category", "cwe"), "finding_key").alias("f"))
    cwe = F.coalesce("f.cwe", F.lit(""))
    tags = F.array_compact(F.array(F.lit("security"), F.lower("f.category"), F.when(cwe != "", cwe), F.nullif(risk_category(cwe), F.lit(""))))
    uri = F.when(cwe != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace(cwe, "^CWE-", ""), F.lit(".html"))).otherwise("")
    return first.select("rule", F.col("f.title").alias("name"), sarif_level(clean_severity("f.severity")).alias("level"), F.array_join(tags, ",").alias("tags"), uri.alias("help_uri"))


def sarif_document(findings: DataFrame) -> DataFrame:
    """(part, key, text): the lines of one SARIF 2.1.0 document, in the order of part and key: head, rules, results and foot.

    Every rule and every result is a line of its own, so that the document is written by all tasks: sorted, the
    part files one after the other are the document.
    """
    spark = findings.sparkSession
    rule = F.struct(F.col("rule").alias("id"), "name", F.struct("level").alias("defaultConfiguration"), F.nullif("help_uri", F.lit("")).alias("helpUri"), F.struct(F.split("tags", ",").alias("tags")).alias("properties"))
    rules = sarif_rules(findings).select(F.lit(1).alias("part"), F.coalesce("rule", F.lit("")).alias("key"), F.to_json(rule).alias("text"))
    results = sarif_results(findings).select(F.lit(3).alias("part"), F.lpad("finding_key", 20, "0").alias("key"), F.col("result").alias("text"))
    lines = rules.unionAll(results)
    first = lines.groupBy("part").agg(F.min(F.struct("key", "text")).alias("f"))  # no comma before the first of each list
    lines = lines.join(F.broadcast(first), "part")  # two rows
    lines = lines.select("part", "key", F.when(F.struct("key", "text") == F.col("f"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text"))
    frame = spark.createDataFrame(
        [
            (0, "", '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "siftline", "rules": ['),
            (2, "", ']}}, "results": ['),
            (4, "", "]}]}"),
        ],
        "part int, key string, text string",
    )
    return frame.unionAll(lines)


def html_rows(findings: DataFrame) -> DataFrame:
    """(finding_key, row): each finding as an escaped row of an HTML table."""
    def esc(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    cells = [F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in ("severity", "rule_id", "title", "file", "line", "evidence")]
    return findings.select("finding_key", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as partitioned Parquet and as JSON lines, SARIF results, a SARIF document in parts and HTML rows as text, each written by all tasks."""
    findings.write.mode("overwrite").partitionBy("category").parquet(f"{path}/findings")
    findings.write.mode("overwrite").json(f"{path}/json")
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/sarif")
    sarif_document(findings).orderBy("part", "key", "text").select("text").write.mode("overwrite").text(f"{path}/sarif-document")
    html_rows(findings).select("row").write.mode("overwrite").text(f"{path}/html")
