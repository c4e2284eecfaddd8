"""A whole scan as one dataflow: files to findings, then merging, scoring, suppression, chains and the gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import literal_map
from siftline.operators import code, configs, containers, findings, lexical, rules, sca, semantic, taint
from siftline.session import side_by_side, written
from siftline.sources import corpus
from siftline.sources.baseline import ScanSettings

#: The columns of a finding and their types.
FINDING = {
    "finding_key": "bigint", "id": "string", "rule_id": "string", "project": "string", "category": "string", "severity": "string", "title": "string", "description": "string", "file": "string", "line": "int", "col_no": "int",
    "evidence": "string", "confidence": "string", "source": "string", "sink": "string", "data_flow": "array<string>", "cwe": "string", "detector_ids": "array<string>", "evidences": "array<string>",
}
_TITLES = {r.rule_id: r.title for r in rules.RULES} | {"VG-WEBHOOK-001": "Missing Webhook Signature Verification", "VG-SECRET-FILE": "Sensitive Credential File", "VG-CFG-004": "Environment File Not Ignored", "VG-GIT-001": "Sensitive File Tracked", "VG-DCK-014": "Sensitive File in Build Context"}


@dataclass(frozen=True)
class ScanResult:
    """What a scan gives: all rows written once, the rest lazy."""

    findings: DataFrame
    scores: DataFrame
    chains: DataFrame
    scope: DataFrame
    warnings: DataFrame


@dataclass(frozen=True)
class Scan:
    """A scan of `files` (project, rel_path, name, content), with dependencies, advisories and suppressions where given."""

    files: DataFrame
    settings: ScanSettings = field(default_factory=ScanSettings)
    deps: DataFrame | None = None
    advisories: DataFrame | None = None
    suppressions: DataFrame | None = None
    as_of: str = "2026-10-01"

    def gated(self) -> DataFrame:
        return corpus.gated(self.files, exclude=self.settings.exclude)

    def detected(self) -> DataFrame:
        """The findings of all detectors, before anything is merged. finding_key is made from what was found and where, so that it is the same in every run."""
        files = self.gated().where("verdict = 'scanned'").drop("verdict")
        parts = []
        if self.settings.secret_scan:
            parts.append(_secrets)
        if self.settings.source_scan:
            parts += [_code, _configuration, _containers]
        if self.settings.dependency_scan and self.deps is not None and self.advisories is not None:
            parts.append(lambda _: _dependencies(self.deps, self.advisories))
        if not parts:
            return self.files.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in FINDING.items()))
        found = side_by_side([lambda part=part: written(reduce(DataFrame.unionByName, part(files)), "detected") for part in parts])
        return reduce(DataFrame.unionByName, found)

    def run(self) -> ScanResult:
        merged = findings.merged(self.detected()).withColumnRenamed("base_key", "finding_key").withColumnRenamed("file_lc", "file")
        kept = merged.withColumns({"id": F.col("canonical_rule"), "rule_id": F.get("detector_ids", 0), "description": F.lit("")})
        if self.suppressions is not None:
            kept = findings.unsuppressed(kept, self.suppressions, self.as_of)
        kept = written(findings.scored(kept), "findings")
        return ScanResult(kept, findings.project_scores(kept, self.settings.block_on), findings.chains(kept), findings.scope(kept), corpus.warnings(self.gated()))


_AT = ["project", "rel_path"]


def _secrets(files: DataFrame) -> list[DataFrame]:
    hits = lexical.rule_hits(corpus.lines(files, _AT), _AT, rules.SECRET_RULES)
    names = lexical.sensitive_names(files, _AT)
    return [
        _finding(hits, evidence=F.col("evidence")),
        _finding(names, rule="VG-SECRET-FILE", severity="HIGH", category="secret", line=F.lit(1), evidence=F.col("name")),
    ]


def _code(files: DataFrame) -> list[DataFrame]:
    """What lines, calls and flows of source files show."""
    facts = written(code.facts(files), "facts")
    sources = files.where(F.coalesce(corpus.extension(F.col("rel_path")), F.lit("")).isin(*rules.SOURCE_EXTENSIONS))
    wanted = [*zip(taint.flow_graph(facts), ("flow-edges", "starts", "ends"), strict=True), (lexical.rule_hits(corpus.lines(corpus.before_tests(sources), _AT), _AT, rules.CODE_RULES), "code-hits")]
    *graph, hits = side_by_side([lambda x=x: written(*x) for x in wanted])
    seen = taint.reached(*graph[:2])
    hits = lexical.judged(hits, facts, written(taint.reached_names(seen), "names"))
    sunk = F.when(F.col("source").isNotNull(), F.concat_ws(":", "rel_path", F.col("line_no").cast("string"), "evidence"))
    unsigned = lexical.missing_webhook_signature(corpus.lines(sources, _AT), _AT)
    flow = taint.flows(facts, graph, seen).withColumnRenamed("source", "src").withColumnRenamed("sink", "snk").withColumn("rel_path", F.col("sink_file"))
    ends = {"source": F.concat_ws(":", "source_file", F.col("source_line").cast("string"), "src"), "sink": F.concat_ws(":", "sink_file", F.col("sink_line").cast("string"), "snk")}
    return [
        _finding(hits, evidence=F.col("evidence"), source=F.col("source"), sink=sunk, flow=F.when(sunk.isNotNull(), F.array("source", sunk))),
        _finding(unsigned, rule="VG-WEBHOOK-001", severity="HIGH", category="sourcecode", confidence="HIGH"),
        _finding(semantic.semantic_hits(facts), category="sourcecode", line=F.col("line"), evidence=F.col("callee")),
        _finding(flow, category="sourcecode", confidence="HIGH", line=F.col("sink_line"), evidence=F.col("snk"), flow=F.array(*ends.values()), **ends),
    ]


def _configuration(files: DataFrame) -> list[DataFrame]:
    return [
        _finding(configs.config_hits(configs.entries(files)), category="configuration", confidence="HIGH", evidence=F.col("evidence")),
        _finding(configs.env_not_ignored(files), rule="VG-CFG-004", severity="MEDIUM", category="configuration", line=F.lit(1)),
        _finding(lexical.tracked_sensitive(files, _AT), rule="VG-GIT-001", severity="CRITICAL", category="git", line=F.lit(1), evidence=F.col("name")),
    ]


def _containers(files: DataFrame) -> list[DataFrame]:
    return [
        _finding(containers.dockerfile_hits(files), category="docker", confidence="HIGH"),
        _finding(containers.compose_hits(containers.services(files)), category="docker", confidence="HIGH", evidence=F.col("service")),
        _finding(containers.exposed_context(files), rule="VG-DCK-014", severity="HIGH", category="docker"),
    ]


def _dependencies(deps: DataFrame, advisories: DataFrame) -> list[DataFrame]:
    at = ["eco", "pkg", "version"]
    m = sca.matches(deps, advisories).withColumnRenamed("severity", "given")
    d = sca.dep_findings(m, advisories, (*at, "given")).join(sca.places(deps), at).withColumnRenamed("source_file", "rel_path")
    return [_finding(d, severity_column=F.coalesce("given", F.lit("MEDIUM")), category="dependency", confidence="HIGH", line=F.lit(0), evidence=F.col("evidence"), title=F.col("title"))]


def _finding(
    hits: DataFrame,
    rule: str | None = None,
    severity: str | None = None,
    severity_column: Column | None = None,
    category: str | None = None,
    confidence: str | None = None,
    line: Column | None = None,
    evidence: Column | None = None,
    title: Column | None = None,
    source: Column | None = None,
    sink: Column | None = None,
    flow: Column | None = None,
) -> DataFrame:
    """A detector's rows as findings: what isn't given is taken from the columns of the same name, or null."""
    has = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("string")
    rule_id = F.lit(rule) if rule else F.col("rule_id")
    names, cwes = literal_map(_TITLES), literal_map(rules.CWE_OF)
    at = line if line is not None else F.col("line_no")
    cols = {
        "id": rule_id,
        "rule_id": rule_id,
        "project": F.col("project"),
        "category": F.lit(category) if category else F.col("category"),
        "severity": severity_column if severity_column is not None else F.lit(severity) if severity else F.col("severity"),
        "title": title if title is not None else F.coalesce(has("title"), F.element_at(names, rule_id), rule_id),
        "description": has("description"),
        "file": F.col("rel_path"),
        "line": at,
        "col_no": F.lit(1),
        "evidence": evidence if evidence is not None else F.lit(None),
        "confidence": F.lit(confidence) if confidence else F.coalesce(has("confidence"), F.lit("MEDIUM")),
        "source": source if source is not None else F.lit(None),
        "sink": sink if sink is not None else F.lit(None),
        "data_flow": flow if flow is not None else F.lit(None),
        "cwe": F.coalesce(has("cwe"), F.element_at(cwes, rule_id)),
        "detector_ids": F.lit(None),
        "evidences": F.lit(None),
    }
    x = hits.select(*(c.cast(FINDING[n]).alias(n) for n, c in cols.items()))
    key = F.xxhash64("project", "file", "line", "rule_id", "title", "evidence", "source", "sink")
    return x.withColumn("finding_key", key).select(*FINDING)
