"""What happens to findings once detectors have reported them: classes, fingerprints, merging, confidence, chains, suppression, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import blank, digest, literal_map
from siftline.session import written
from siftline.sources.corpus import basename

# Severities by rank, and what each of them takes from the score of 100.
SEVERITY_RANK = {"INFO": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}
DEFAULT_SEVERITY = "MEDIUM"
PENALTY = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 3, "LOW": 1}


@dataclass(frozen=True)
class ClassRow:
    """A class holds if any of these is true: the rule holds a text or is one, the title holds a text, the category is one."""

    name: str
    cwe: str
    rule_has: tuple[str, ...] = ()
    rule_is: tuple[str, ...] = ()
    title_has: tuple[str, ...] = ()
    category: tuple[str, ...] = ()


# The canonical classes; the first that holds counts. Rules in upper case, titles in lower case.
CANONICAL = (
    ClassRow("VG-CANON-CRED-AWS", "CWE-798", ("SEC-001",), (), ("aws",)),
    ClassRow("VG-CANON-CRED-GITHUB", "CWE-798", ("SEC-003",), (), ("github",)),
    ClassRow("VG-CANON-CRED-JWT", "CWE-798", ("AUTH-003",), (), ("jwt",)),
    ClassRow("VG-CANON-CRED-DB", "CWE-798", (), (), ("database password", "db_password", "database_url")),
    ClassRow("VG-CANON-CRED-APIKEY", "CWE-798", ("SEC-002",), (), ("api key", "apikey")),
    ClassRow("VG-CANON-CRED-SLACK", "CWE-798", ("SEC-004",), (), ("slack",)),
    ClassRow("VG-CANON-CRED-KEY", "CWE-798", ("SEC-005",), (), ("private key",)),
    ClassRow("VG-CANON-FILE-SECRET", "CWE-200", ("SECRET-FILE",), (), ("sensitive credential file",)),
    ClassRow("VG-CANON-CRED-GENERIC", "CWE-798", ("SECRET",), (), ("password", "secret", "credential"), ("secret",)),
    ClassRow("VG-CANON-INJ-SQL", "CWE-89", ("SQL",), (), ("sql injection",)),
    ClassRow("VG-CANON-ARG-INJ", "CWE-88", (), ("VG-CMD-LIST",), ("argument injection",)),
    ClassRow("VG-CANON-INJ-CMD", "CWE-78", ("CMD", "SAST-002", "SAST-008"), (), ("command injection", "shell execution")),
    ClassRow("VG-CANON-SSRF", "CWE-918", ("SSRF",), (), ("ssrf", "server-side request forgery")),
    ClassRow("VG-CANON-PATH", "CWE-22", ("PATH",), (), ("path traversal",)),
    ClassRow("VG-CANON-XSS", "CWE-79", ("XSS",), (), ("cross-site", "xss")),
    ClassRow("VG-CANON-DESER", "CWE-502", ("DESER",), (), ("deserializ", "pickle")),
    ClassRow("VG-CANON-AUTH-HASH", "CWE-916", ("AUTH-001",), (), ("password hash",)),
    ClassRow("VG-CANON-AUTH-TOKEN", "CWE-330", ("AUTH-002",), (), ("predictable",)),
    ClassRow("VG-CANON-CRYPTO-WEAK", "CWE-327", ("SAST-005",), (), ("weak crypto", "md5", "sha1")),
    ClassRow("VG-CANON-TLS-INSECURE", "CWE-295", ("SAST-004", "CFG-007"), (), ("tls", "ssl")),
    ClassRow("VG-CANON-DOCKER-HEALTH", "CWE-250", (), ("VG-DCK-004",), ("healthcheck",)),
    ClassRow("VG-CANON-DOCKER-ROOT", "CWE-250", (), ("VG-DCK-001",), ("running as root",)),
    ClassRow("VG-CANON-DOCKER", "CWE-16", ("DCK",), (), (), ("docker",)),
    ClassRow("VG-CANON-CONFIG-DEBUG", "CWE-489", (), ("VG-SAST-010", "VG-CFG-001"), ("debug mode",)),
    ClassRow("VG-CANON-CONFIG", "CWE-16", ("CFG",), (), (), ("configuration",)),
    ClassRow("VG-CANON-GENERIC", "CWE-699"),
)
# The classes of chains; rules as they are written, titles in lower case.
CHAIN_CLASSES = (
    ClassRow("SQL Injection", "CWE-89", ("SQL", "sql"), (), ("sql",)),
    ClassRow("Command Injection", "CWE-78", ("CMD", "cmd"), (), ("command",)),
    ClassRow("Server-Side Request Forgery", "CWE-918", ("SSRF", "ssrf"), (), ("ssrf",)),
    ClassRow("Path Traversal", "CWE-22", ("PATH", "path"), (), ("path traversal",)),
    ClassRow("Cross-Site Scripting", "CWE-79", ("XSS", "xss"), (), ("cross-site",)),
    ClassRow("Template Injection", "CWE-1336", ("SSTI", "template"), (), ("template injection",)),
    ClassRow("Insecure Deserialization", "CWE-502", ("DESER",), (), ("deserializ",)),
    ClassRow("Exposed Credential", "CWE-798", (), (), ("secret", "api key", "password")),
    ClassRow("Weak Cryptography", "CWE-326", (), (), ("tls", "ssl", "crypto")),
    ClassRow("Container Misconfiguration", "CWE-16", (), (), ("docker", "container")),
    ClassRow("Security Misconfiguration", "CWE-16", (), (), ("debug", "config")),
    ClassRow("Other Security Issue", "CWE-693"),
)
# The families of the second pass over findings of all sources; the first that holds counts, else the canonical class.
WIDE_FAMILIES = (
    ClassRow("CREDENTIAL", "CWE-798", ("SEC-", "CFG-008"), (), ("secret", "credential", "key", "token"), ("secret",)),
    ClassRow("SQL_INJECTION", "CWE-89", ("SQL",), (), ("sql",)),
    ClassRow("COMMAND_INJECTION", "CWE-78", ("CMD", "SAST-002"), (), ("command",)),
    ClassRow("SSRF", "CWE-918", ("SSRF",), (), ("ssrf",)),
    ClassRow("PATH_TRAVERSAL", "CWE-22", ("PATH",), (), ("path",)),
    ClassRow("XSS", "CWE-79", ("XSS",), (), ("xss",)),
    ClassRow("DESERIALIZATION", "CWE-502", ("DESER",), (), ("deserializ",)),
    ClassRow("", ""),
)
# How specific a detector is, from rule, title and evidence in lower case; the first that holds counts, else 1.
SPECIFICITY = (
    (10, ("sec-001",), ("aws",), ("aws_access_key", "akia")),
    (9, ("sec-003",), ("github",), ("ghp_",)),
    (8, ("auth-003",), ("jwt",), ("jwt_secret",)),
    (7, (), ("database password", "db_password"), ("db_password", "database_url")),
    (6, ("sec-002",), ("api key", "apikey"), ("api_key",)),
    (5, ("sec-004",), ("slack",), ()),
    (4, ("sec-005",), ("private key",), ()),
    (3, ("secret-001", "secret-002", "secret-003", "sec-006", "sec-007", "sec-008"), (), ()),
    (2, ("cfg-008",), (), ()),
)
# New names of merged groups, from detectors, the title and the evidences in lower case; the first that holds counts.
RETITLED = (
    ("Exposed AWS Credential", "VG-CANON-CRED-AWS", ("SEC-001",), ("aws",), ("aws_access_key", "akia")),
    ("Exposed GitHub Token", "VG-CANON-CRED-GITHUB", ("SEC-003",), ("github",), ("ghp_",)),
    ("Exposed JWT Secret", "VG-CANON-CRED-JWT", ("AUTH-003",), ("jwt",), ("jwt",)),
    ("Exposed Database Password", "VG-CANON-CRED-DB", (), ("database password",), ("db_password", "database_url", "db_pass")),
    ("Exposed API Key", "VG-CANON-CRED-APIKEY", ("SEC-002", "SECRET-002"), ("api key",), ("api_key", "apikey")),
)


def _any(c: Column, texts: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | c.contains(t)
    return out


def _first(rows: Sequence[ClassRow], value: str, rule: Column, title: Column, category: Column) -> Column:
    out: Column | None = None
    for r in rows[:-1]:
        holds = _any(rule, r.rule_has) | _any(title, r.title_has)
        holds = holds | rule.isin(*r.rule_is) if r.rule_is else holds
        holds = holds | category.isin(*r.category) if r.category else holds
        v = F.lit(getattr(r, value))
        out = F.when(holds, v) if out is None else out.when(holds, v)
    return out.otherwise(F.lit(getattr(rows[-1], value)))


def canonical_class(rule: Column, title: Column, category: Column, value: str = "name") -> Column:
    """The canonical class (or its cwe) of a finding; nulls count as ''."""
    e = F.lit("")
    return _first(CANONICAL, value, F.upper(F.coalesce(rule, e)), F.lower(F.coalesce(title, e)), F.lower(F.coalesce(category, e)))


def chain_class(rule: Column, title: Column, value: str = "name") -> Column:
    e = F.lit("")
    return _first(CHAIN_CLASSES, value, F.coalesce(rule, e), F.lower(F.coalesce(title, e)), e)


def clean_severity(c: Column | str) -> Column:
    v = F.upper(blank(c))
    return F.when(v.isin(*SEVERITY_RANK), v).otherwise(DEFAULT_SEVERITY)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(SEVERITY_RANK), severity), F.lit(0))


def clean_path(c: Column | str) -> Column:
    """Forward slashes, no doubled ones, no leading './'; '.' for an empty path."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "/+", "/"), r"^(?:\./)+", "")
    return F.when(p == "", ".").otherwise(p)


def fingerprint(f: dict[str, Column]) -> Column:
    """rule:file:line:column:source:sink:evidence; running numbers as rules give way to the title, evidence has 60 characters at most."""
    e = F.lit("")
    rule = F.coalesce(f["rule_id"], f["id"], e)
    rule = F.when(F.startswith(rule, F.lit("VG-0")), F.lower(F.trim(f["title"]))).otherwise(rule)
    path = F.regexp_replace(F.coalesce(f["file"], e), r"\\", "/")
    ends = [F.trim(F.coalesce(f[c], e)) for c in ("source", "sink")]
    return F.concat_ws(":", rule, path, F.coalesce(f["line"], F.lit(0)).cast("string"), F.coalesce(f["col_no"], F.lit(1)).cast("string"), *ends, F.substring(F.trim(F.coalesce(f["evidence"], e)), 1, 60))


def tagged(findings: DataFrame) -> DataFrame:
    """`findings` with canon, a cwe where it was null, detectors and evidences that are never null, and fp, the recomputed fingerprint."""
    c = {x: F.col(x) for x in ("rule_id", "id", "title", "file", "line", "col_no", "source", "sink", "evidence")}
    rule = F.coalesce("rule_id", "id")
    canon = canonical_class(rule, F.col("title"), F.col("category"))
    return findings.withColumns({
        "canon": canon,
        "cwe": F.coalesce("cwe", canonical_class(rule, F.col("title"), F.col("category"), "cwe")),
        "detectors": F.coalesce("detector_ids", F.array(rule)),
        "proofs": F.coalesce("evidences", F.when(F.col("evidence").isNotNull(), F.array("evidence")), F.array().cast("array<string>")),
        "fp": fingerprint(c),
    })


def first_by_fingerprint(findings: DataFrame) -> DataFrame:
    """(fp, first_key, n): exact duplicates within a project, the smallest finding_key first."""
    return tagged(findings).groupBy("project", "fp").agg(F.min("finding_key").alias("first_key"), F.count(F.lit(1)).alias("n"))


def specificity(rule: Column, title: Column, evidence: Column) -> Column:
    e = F.lit("")
    r, t, ev = (F.lower(F.coalesce(x, e)) for x in (rule, title, evidence))
    out: Column | None = None
    for rank, rules, titles, proofs in SPECIFICITY:
        holds = _any(r, rules) | _any(t, titles) | _any(ev, proofs)
        out = F.when(holds, rank) if out is None else out.when(holds, rank)
    return out.otherwise(1)


def wide_family(rule: Column, title: Column, category: Column, canon: Column) -> Column:
    """The family of a finding in the second pass, over the findings of scanner, diffs and dependencies together."""
    e = F.lit("")
    found = _first(WIDE_FAMILIES, "name", F.upper(F.coalesce(rule, e)), F.lower(F.coalesce(title, e)), F.lower(F.coalesce(category, e)))
    return F.when(found != "", found).otherwise(F.coalesce(canon, rule))


def merged(findings: DataFrame, wide: bool = False) -> DataFrame:
    """One row for each place and family: what several detectors say of one line becomes one finding.

    `wide` groups by wide_family(), the second pass; else by the canonical class.

    Exact duplicates (by fingerprint) go first. Rows with a line are grouped by project, lower-case file, line
    and family (all credentials are one family, else the canonical class); rows without a line stay alone. The
    base is the row with the highest severity, then specificity, then longest data flow, then smallest key. It
    takes the first HIGH confidence where it has none, and the first data flow where it has none, in that
    order; detectors, evidences and related ids are joined, sorted and distinct; groups of credentials are renamed.
    What is gathered of a group are its distinct detectors, evidences and ids, never its rows.
    """
    t = tagged(findings)
    keep = t.groupBy("project", "fp").agg(F.min("finding_key").alias("finding_key")).select("finding_key")
    t = t.join(keep, "finding_key", "left_semi")
    credential = F.col("canon").rlike("^VG-CANON-(?:CRED|FILE)")
    has_line = F.col("line") > 0
    t = t.withColumns({
        "file_lc": F.lower(F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/")),
        "family": wide_family(F.coalesce("rule_id", "id"), F.col("title"), F.col("category"), F.coalesce("canonical_rule", "canon") if "canonical_rule" in t.columns else F.col("canon")) if wide else F.when(credential, "CREDENTIAL").otherwise(F.col("canon")),
        "alone": F.when(has_line, F.lit(None)).otherwise(F.col("finding_key")),
        "sev": clean_severity("severity"),
        "flow": F.coalesce(F.array_size("data_flow"), F.lit(0)),
        "rule": F.coalesce("rule_id", "id"),
    })
    t = written(t, "tagged")
    order = F.struct(severity_rank(F.col("sev")), specificity(F.col("rule"), F.col("title"), F.col("evidence")), F.col("flow"), -F.col("finding_key"))
    base = F.struct("finding_key", "id", "title", F.col("sev").alias("severity"), "confidence", "canon", "category", "cwe", "evidence", "source", "sink", "data_flow")
    high = F.startswith(F.coalesce("confidence", F.lit("")), F.lit("HIGH"))
    g = t.groupBy("project", "file_lc", "line", "family", "alone").agg(
        F.max_by(base, order).alias("b"),
        F.max_by(F.when(high, F.col("confidence")), F.when(high, order)).alias("high"),
        F.max_by(F.when(F.col("data_flow").isNotNull(), F.struct("source", "sink", "data_flow")), F.when(F.col("data_flow").isNotNull(), order)).alias("flowing"),
        F.count(F.lit(1)).alias("n"),
    )
    g = g.select("*", digest("project", "file_lc", "line", "family", "alone").alias("place"))
    parts = F.array(
        F.struct(F.lit("d").alias("of"), F.col("detectors").alias("items")), F.struct(F.lit("e").alias("of"), F.col("proofs").alias("items")), F.struct(F.lit("i").alias("of"), F.array("id").alias("items")),
    )
    said = t.select(digest("project", "file_lc", "line", "family", "alone").alias("place"), F.explode(parts).alias("p")).select("place", "p.of", F.explode("p.items").alias("item")).where("item IS NOT NULL")
    said = said.groupBy("place", "of", "item").agg(F.count(F.lit(1)).alias("k"))  # distinct before anything is gathered
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("of") == kind, F.col("item"))))
    ids = F.collect_list(F.when(F.col("of") == "i", F.struct("item", "k")))
    g = g.join(said.groupBy("place").agg(of("d").alias("detector_ids"), of("e").alias("evidences"), ids.alias("ids")), "place", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("detector_ids", "evidences")})
    e = F.lit("")
    low, all_ev = F.lower(F.coalesce("b.title", e)), F.lower(F.array_join("evidences", " "))
    several = F.col("n") > 1
    name: Column | None = None
    for i, (_, _, detectors, titles, proofs) in enumerate(RETITLED):
        holds = _any(F.array_join("detector_ids", "\x00"), detectors) | _any(low, titles) | _any(all_ev, proofs)
        name = F.when(several & holds, i) if name is None else name.when(several & holds, i)
    g = g.withColumn("as", name)
    pick = lambda values, c: F.coalesce(F.get(F.array(*(F.lit(v) for v in values)), F.col("as")), c)
    own_flow = F.col("b.data_flow").isNotNull() | F.col("flowing").isNull()
    keyed = F.get(F.filter("evidences", lambda x: F.contains(x, F.lit("="))), 0)
    return g.select(
        "project",
        F.col("b.finding_key").alias("base_key"),
        "file_lc",
        "line",
        "n",
        pick([r[0] for r in RETITLED], F.col("b.title")).alias("title"),
        pick([r[1] for r in RETITLED], F.col("b.canon")).alias("canonical_rule"),
        F.when(F.col("as").isNotNull(), "secret").otherwise(F.col("b.category")).alias("category"),
        F.when(F.col("as").isNotNull(), "CRITICAL").otherwise(F.col("b.severity")).alias("severity"),
        F.when(F.col("as").isNotNull(), "CWE-798").otherwise(F.col("b.cwe")).alias("cwe"),
        F.when(several & ~F.startswith(F.coalesce("b.confidence", e), F.lit("HIGH")), F.coalesce("high", "b.confidence")).otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(own_flow, F.col("b.source")).otherwise(F.col("flowing.source")).alias("source"),
        F.when(own_flow, F.col("b.sink")).otherwise(F.col("flowing.sink")).alias("sink"),
        F.when(own_flow, F.col("b.data_flow")).otherwise(F.col("flowing.data_flow")).alias("data_flow"),
        F.when(several & ~F.contains(F.coalesce("b.evidence", e), F.lit("=")), F.coalesce(keyed, F.col("b.evidence"))).otherwise(F.col("b.evidence")).alias("evidence"),
        "detector_ids",
        "evidences",
        F.array_sort(F.transform(F.filter(F.coalesce("ids", F.array().cast("array<struct<item: string, k: bigint>>")), lambda m: (m["item"] != F.coalesce("b.id", e)) | (m["k"] > 1)), lambda m: m["item"])).alias("related_findings"),
    )


def confidence_score(confidence: Column, severity: Column, evidence: Column, source: Column, sink: Column, data_flow: Column) -> Column:
    """5 to 100, from the label, the data flow, both ends of it, the severity and the evidence."""
    # The numbers of this sum.
    base = F.when(confidence == "HIGH", 75).when(confidence == "MEDIUM", 45).otherwise(15)
    flow = F.when(F.coalesce(F.array_size(data_flow), F.lit(0)) >= 2, 15).otherwise(0)
    head = lambda c: F.substring_index(c, ":", 1)
    ends = F.when(source.isNotNull() & sink.isNotNull(), F.when(head(source) != head(sink), 10).otherwise(5)).otherwise(0)
    sev = F.when(severity == "CRITICAL", 5).when(severity == "HIGH", 2).otherwise(0)
    ev = F.when(evidence.isNull(), -15).when(F.length(F.trim(evidence)) < 20, -10).otherwise(0)
    bare = F.when(source.isNull() & sink.isNull(), -10).otherwise(0)
    return F.greatest(F.lit(5), F.least(F.lit(100), base + flow + ends + sev + ev + bare))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW")


def scored(findings: DataFrame) -> DataFrame:
    """`findings` with score and label."""
    s = confidence_score(F.col("confidence"), clean_severity("severity"), F.col("evidence"), F.col("source"), F.col("sink"), F.col("data_flow"))
    return findings.withColumn("score", s).withColumn("label", confidence_label(F.col("score")))


def chains(findings: DataFrame, kinds: bool = False) -> DataFrame:
    """One row for each chain of a project: (project, vuln_class, file, cwe, n, first_key, severity, score, label, cross_file, cross_function).

    Findings with both a source and a sink form one chain for each class if there are two or more, without a
    file; the others, and lone ones, form chains by class and base name. The score is the whole mean of the
    members' scores, 10 more (100 at most) where members of the first kind lie in several files.
    """
    f = scored(findings).select(
        "project",
        chain_class(F.coalesce("rule_id", "id"), F.col("title")).alias("vuln_class"),
        chain_class(F.coalesce("rule_id", "id"), F.col("title"), "cwe").alias("cwe"),
        basename(F.col("file")).alias("name"),
        F.col("file").alias("path"),
        "finding_key",
        severity_rank(clean_severity("severity")).alias("rank"),
        "score",
        (F.col("source").isNotNull() & F.col("sink").isNotNull()).alias("traced"),
        F.col("data_flow").isNotNull().alias("flows"),
    )
    pairs = f.where("traced").groupBy("project", "vuln_class").agg(F.count(F.lit(1)).alias("traced_n")).where("traced_n > 1")
    f = f.join(pairs, ["project", "vuln_class"], "left").withColumn("first_kind", F.col("traced") & F.col("traced_n").isNotNull())
    f = f.withColumn("file", F.when(~F.col("first_kind"), F.col("name")))
    g = f.groupBy("project", "vuln_class", "cwe", "first_kind", "file").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("finding_key").alias("first_key"),
        F.max("rank").alias("rank"),
        F.floor(F.sum("score") / F.count(F.lit(1))).cast("int").alias("mean"),
        F.min("path").alias("p1"),
        F.max("path").alias("p2"),
        F.max("flows").alias("cross_function"),
    )
    cross = F.col("first_kind") & (F.col("p1") != F.col("p2"))
    score = F.least(F.lit(100), F.col("mean") + F.when(cross, 10).otherwise(0))
    names = F.create_map(*(F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k)))
    return g.select("project", "vuln_class", "file", "cwe", "n", "first_key", F.element_at(names, F.col("rank")).alias("severity"), score.alias("score"), confidence_label(score).alias("label"), cross.alias("cross_file"), "cross_function", *(["first_kind"] if kinds else []))


def scope(findings: DataFrame) -> DataFrame:
    """(project, intra_function, cross_function, cross_file, framework_aware, config_aware): how many findings are of each kind."""
    head = lambda c: F.substring_index(c, ":", 1)
    cross_file = F.coalesce((head("source") != head("sink")) & (head("source") != "") & (head("sink") != ""), F.lit(False))
    cross_function = F.coalesce(F.array_size("data_flow"), F.lit(0)) >= 3
    e = F.lit("")
    # Words that name a framework, and what configuration files are called.
    framework = F.contains(F.coalesce("rule_id", e), F.lit("FW-")) | F.contains(F.lower(F.coalesce("title", e)), F.lit("framework")) | F.lower(F.coalesce("description", e)).rlike("flask|django|fastapi|express|spring")
    config = F.lower(F.coalesce("category", e)).rlike("configuration|docker") | F.coalesce("file", e).rlike(r"\.env|\.(?:yml|yaml|toml|ini)$")
    n = lambda c, name: F.sum(c.cast("int")).cast("bigint").alias(name)
    return findings.groupBy("project").agg(n(~cross_file & ~cross_function, "intra_function"), n(cross_function, "cross_function"), n(cross_file, "cross_file"), n(framework, "framework_aware"), n(config, "config_aware"))


def unsuppressed(findings: DataFrame, suppressions: DataFrame, as_of: str) -> DataFrame:
    """The findings that no suppression of their project holds for.

    A suppression holds if its rule_id is null, '' or the finding's id or title, its file is null, '' or the end of
    the finding's, its line (or the finding's) is null or 0 or both are equal, and it isn't expired: on the day
    of expires it is. All joins are by equality: a rule is looked for among a finding's id and title, a file
    among the ends of the finding's path that are as long as some suppressed file of the project.
    """
    e = F.lit("")
    s = suppressions.where("project IS NOT NULL").select(
        "project",
        F.coalesce("rule_id", e).alias("s_rule"),
        F.when(F.col("file").isNotNull() & (F.col("file") != ""), clean_path("file")).otherwise("").alias("s_file"),
        F.when(F.col("line") > 0, F.col("line")).alias("s_line"),
        F.try_to_date("expires", "yyyy-MM-dd").alias("until"),
    )
    s = s.where(F.col("until").isNull() | (F.to_timestamp(F.lit(as_of)) <= F.col("until").cast("timestamp"))).drop("until").distinct().withColumn("n", F.length("s_file"))
    # every line, or none, that an entry without one holds for, as one key
    s = s.groupBy("project", "n", "s_file", "s_rule").agg(F.max(F.col("s_line").isNull()).alias("all_lines"), F.collect_set("s_line").alias("lines"))
    lengths = s.groupBy("project").agg(F.collect_set("n").alias("lengths"), F.collect_set("s_rule").alias("rules"))
    f = findings.select("finding_key", "project", "id", "title", clean_path("file").alias("f_file"), F.when(F.col("line") > 0, F.col("line")).alias("f_line"))
    f = f.join(lengths, "project").select("finding_key", "project", "f_line", "f_file", "lengths", F.explode(F.array_intersect(F.array(e, F.coalesce("id", e), F.coalesce("title", e)), "rules")).alias("s_rule"))
    f = f.select("finding_key", "project", "f_line", "f_file", "s_rule", F.explode(F.filter("lengths", lambda n: n <= F.length("f_file"))).alias("n"))
    f = f.withColumn("s_file", F.when(F.col("n") == 0, e).otherwise(F.expr("right(f_file, n)")))
    hit = f.join(s, ["project", "n", "s_file", "s_rule"]).where(F.col("all_lines") | F.col("f_line").isNull() | F.array_contains("lines", F.col("f_line"))).select("finding_key")
    return findings.join(hit, "finding_key", "left_anti")


def project_scores(findings: DataFrame, block_on: Sequence[str] = ("CRITICAL", "HIGH")) -> DataFrame:
    """(project, critical, high, medium, low, score, gate, reasons): counts by severity, 100 less the penalties (0 at least), and whether a blocked severity occurs."""
    counts = {s: F.sum((clean_severity("severity") == s).cast("int")).cast("bigint").alias(s.lower()) for s in PENALTY}
    g = findings.groupBy("project").agg(*counts.values())
    lost = sum((F.col(s.lower()) * p for s, p in PENALTY.items()), F.lit(0))
    blocked = [F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(f" {s}"))) for s in block_on]
    reasons = F.concat_ws(" and ", *blocked)
    return g.select("*", F.greatest(F.lit(0), 100 - lost).cast("int").alias("score"), F.when(reasons != "", "BLOCKED").otherwise("PASSED").alias("gate"), F.when(reasons != "", F.concat(reasons, F.lit(" detected"))).otherwise("").alias("reasons"))


def by_category(findings: DataFrame) -> DataFrame:
    """(category, severity, n) with totals: null stands for all of a column."""
    return findings.select(F.lower("category").alias("category"), clean_severity("severity").alias("severity")).rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def chain_members(findings: DataFrame) -> DataFrame:
    """(project, vuln_class, file, finding_key): which findings each chain of chains() holds."""
    f = findings.select("project", chain_class(F.coalesce("rule_id", "id"), F.col("title")).alias("vuln_class"), basename(F.col("file")).alias("name"), "finding_key", (F.col("source").isNotNull() & F.col("sink").isNotNull()).alias("traced"))
    pairs = f.where("traced").groupBy("project", "vuln_class").agg(F.count(F.lit(1)).alias("traced_n")).where("traced_n > 1")
    f = f.join(pairs, ["project", "vuln_class"], "left")
    return f.select("project", "vuln_class", F.when(~(F.col("traced") & F.col("traced_n").isNotNull()), F.col("name")).alias("file"), "finding_key")


def changed_only(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """The findings in the files (project, rel_path) that a push changes."""
    return findings.withColumn("rel_path", clean_path("file")).join(changed.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_semi").drop("rel_path")


def ranked_chains(findings: DataFrame) -> DataFrame:
    """chains() with chain_id and rationale; within a project the highest score comes first, then class, file and first finding. chain_id counts from 1."""
    w = Window.partitionBy("project").orderBy(F.desc("score"), "vuln_class", F.coalesce("file", F.lit("")), F.col("file").isNotNull(), "first_key")
    c = chains(findings, kinds=True).withColumn("chain_id", F.concat(F.lit("CHAIN-"), F.lpad(F.row_number().over(w).cast("string"), 6, "0")))
    n = F.col("n").cast("string")
    traced = F.concat(n, F.lit(" related findings with confirmed taint provenance"), F.when(F.col("cross_file"), " in several files.").otherwise(" in one file."))
    alone = F.concat(n, F.lit(" related finding(s) for "), "vuln_class", F.lit(" in the same file scope."))
    return c.withColumn("rationale", F.when(F.col("first_kind"), traced).otherwise(alone)).drop("first_kind")
