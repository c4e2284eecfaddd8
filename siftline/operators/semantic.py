"""Rules on code facts: how a dangerous call is built, who controls it and what guards it; evidence tiers; secret scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import literal_map
from siftline.operators import taint
from siftline.operators.findings import confidence_label

# Texts that show a guard, and names that aren't under a user's control.
HOST_GUARD = r"(?i)ALLOWED_|allowlist|whitelist|is_safe_host"
PATH_GUARD = r"(?i)basename|secure_filename|realpath|resolve\(|abspath|startswith|commonpath|filepath\.clean|filepath\.base"
INTERNAL_PATH = r"(?i)config|settings|template|static|log|__file__"
METADATA_HOST = r"169\.254\.169\.254"
ENTRY_NAME = r"^(?:(?:handle|get|post|put|delete|api|route)_|main$|handler$)"
ENTRY_PATH = r"routes|controllers|views|api|endpoints"
ENTRY_PARAMETER = r"req|input|query|param|payload|user|args"
BIND_MARK = r"%s|\?|:\w+|\$\d"
RAW_HTML = r"(?:\.(?:innerHTML|outerHTML)\s*\+?=(?!=)\s*(.+?);?\s*$)|(?:(?:document\.write(?:ln)?|insertAdjacentHTML|\$\([^)]*\)\.html)\((.+)\))"


def build_of(arg: Column) -> Column:
    """literal, fstring, percent, format, concat, list, call, name or other: how an argument is made."""
    a = F.trim(arg)
    return (
        F.when(a.rlike(r"""^(?:[rbu]?"[^"]*"|[rbu]?'[^']*'|-?[0-9.]+|True|False|None|true|false|null|nil)$"""), "literal")
        .when(a.rlike(r"""^(?:[fF]["'].*\{|`.*\$\{)"""), "fstring")
        .when(a.rlike(r"""["']\s*%\s*\S"""), "percent")
        .when(a.rlike(r"""["']\.format\(|(?i)^fmt\.sprintf\(|^string\.format\("""), "format")
        .when(a.rlike(r"""^[\[{].*[\]}]$"""), "list")
        .when(a.rlike(r"""\+"""), "concat")
        .when(a.rlike(r"^[A-Za-z_][\w.]*\("), "call")
        .when(a.rlike(r"^[A-Za-z_$][\w.\[\]'\"]*$"), "name")
        .otherwise("other")
    )


def entries(facts: DataFrame) -> DataFrame:
    """(project, rel_path, func): functions that look like a handler by name, path, parameter or what they read, and the top of a file that calls something."""
    f = facts.where("kind = 'function'").select("project", "rel_path", F.col("name").alias("func"), "args")
    named = F.lower("func").rlike(ENTRY_NAME) | F.lower("rel_path").rlike(ENTRY_PATH) | F.exists("args", lambda a: F.lower(a).rlike(ENTRY_PARAMETER))
    reads = facts.where("kind = 'assign' AND func <> ''").where(taint.is_source(F.col("text")))
    top = facts.where("kind = 'call' AND func = ''")
    cols = ["project", "rel_path", "func"]
    return f.where(named).select(cols).unionByName(reads.select(cols)).unionByName(top.select(cols)).distinct()


def constants(facts: DataFrame) -> DataFrame:
    """(project, rel_path, name): the names of a file to which nothing but literals, and sums of literals, are assigned."""
    literal = F.col("text").rlike(r"""^\s*(?:[rbu]?"[^"]*"|[rbu]?'[^']*'|-?[0-9.]+)(?:\s*\+\s*(?:"[^"]*"|'[^']*'))*\s*$""")
    return facts.where("kind = 'assign'").groupBy("project", "rel_path", "name").agg(F.min(literal).alias("only")).where("only").drop("only")


def judged_calls(facts: DataFrame) -> DataFrame:
    """Every call of a sink with what its deciding argument is: (project, rel_path, func, line, callee, kind, arg, build, control, text, args).

    control is constant, sanitized, user (a request source, or a name assigned from one), derived (built from
    parts) or unknown. A name is constant if the file assigns it nothing but literals.
    """
    calls = facts.where("kind = 'call'").select("project", "rel_path", "func", "line", F.col("name").alias("callee"), "args", "text").withColumn("kind", taint.sink_kind(F.col("callee"))).where("kind IS NOT NULL AND size(args) > 0")
    calls = calls.withColumn("arg", F.get("args", 0)).withColumn("build", build_of(F.col("arg")))
    fixed = constants(facts).select("project", "rel_path", F.col("name").alias("arg"), F.lit(True).alias("fixed"))
    said = facts.where("kind = 'assign'").select("project", "rel_path", "func", F.col("name").alias("arg"), taint.is_source(F.col("text")).alias("from_source"), taint.cleared(F.col("text")).alias("made_safe"), build_of(F.col("text")).isin("fstring", "percent", "format", "concat").alias("joined"))
    said = said.groupBy("project", "rel_path", "func", "arg").agg(F.max("from_source").alias("from_source"), F.min("made_safe").alias("made_safe"), F.max("joined").alias("joined"))
    x = calls.join(fixed, ["project", "rel_path", "arg"], "left").join(said, ["project", "rel_path", "func", "arg"], "left")
    bit = taint.kind_bit(F.col("kind"))
    safe = taint.cleared(F.col("arg")).bitwiseAND(bit) + F.coalesce(F.col("made_safe"), F.lit(0)).bitwiseAND(bit) > 0
    pieces = F.filter(F.split("arg", r"\+"), lambda p: build_of(p) != "literal")
    control = (
        F.when((F.col("build") == "literal") | F.coalesce("fixed", F.lit(False)) | ((F.col("build").isin("concat", "list")) & (F.size(F.filter(F.split(F.regexp_replace("arg", r"^\[|\]$", ""), r"[+,]"), lambda p: build_of(p) != "literal")) == 0)), "constant")
        .when(safe, "sanitized")
        .when(taint.is_source(F.col("arg")) | F.coalesce("from_source", F.lit(False)), "user")
        .when(F.col("build").isin("fstring", "percent", "format") | ((F.col("build") == "concat") & (F.size(pieces) > 0)) | F.coalesce("joined", F.lit(False)), "derived")
        .otherwise("unknown")
    )
    return x.select("project", "rel_path", "func", "line", "callee", "kind", "arg", "build", control.alias("control"), "text", "args")


def semantic_hits(facts: DataFrame) -> DataFrame:
    """(project, rel_path, func, line, rule_id, cwe, severity, confidence, callee): the rules on queries, commands, outgoing requests and paths.

    Queries: anything but constants, sanitized values and constants with bind marks. Commands: by control and
    by whether a shell runs them. Requests: unless the function speaks of an allow-list. Paths: unless the
    function checks the boundary; only arguments that look like a user's, CRITICAL with '..'.
    """
    j = judged_calls(facts)
    guards = facts.groupBy("project", "rel_path", "func").agg(F.max(F.col("text").rlike(HOST_GUARD)).alias("host_guard"), F.max(F.col("text").rlike(PATH_GUARD)).alias("path_guard"))
    j = j.join(guards, ["project", "rel_path", "func"], "left")
    open_ = ~F.col("control").isin("constant", "sanitized")
    bound = (F.size("args") >= 2) & (F.col("build") == "literal") & F.col("arg").rlike(BIND_MARK)
    shell = F.col("text").rlike(r"(?i)shell\s*=\s*(?:True|1)") | F.lower("callee").rlike(r"^(?:os\.|eval$|system$|child_process\.exec$|runtime)")
    # Severity and confidence by control and shell.
    command = (
        F.when(F.col("control") == "user", F.struct(F.lit("CRITICAL").alias("s"), F.lit("HIGH").alias("c")))
        .when((F.col("control") == "derived") & shell, F.struct(F.lit("CRITICAL").alias("s"), F.lit("HIGH").alias("c")))
        .when(F.col("control") == "derived", F.struct(F.lit("HIGH").alias("s"), F.lit("HIGH").alias("c")))
        .when((F.col("control") == "unknown") & shell, F.struct(F.lit("HIGH").alias("s"), F.lit("MEDIUM").alias("c")))
        .when(F.col("control") == "unknown", F.struct(F.lit("LOW").alias("s"), F.lit("LOW").alias("c")))
    )
    fixed = lambda s, c: F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"))
    looks = taint.is_untrusted_name(F.col("arg")) | taint.is_source(F.col("arg")) | (F.col("control") == "user")
    path = F.when(F.contains("arg", F.lit("..")), fixed("CRITICAL", "HIGH")).when(looks & ~F.col("arg").rlike(INTERNAL_PATH), fixed("HIGH", "MEDIUM"))
    verdict = (
        F.when((F.col("kind") == "sql") & open_ & ~bound, fixed("CRITICAL", "HIGH"))
        .when((F.col("kind") == "command") & open_, command)
        .when((F.col("kind") == "ssrf") & open_ & ~F.coalesce("host_guard", F.lit(False)) & ~F.col("text").rlike(METADATA_HOST), fixed("HIGH", "MEDIUM"))
        .when((F.col("kind") == "path") & open_ & ~F.coalesce("path_guard", F.lit(False)), path)
    )
    names = {"sql": ("VG-SQL-001", "CWE-89"), "command": ("VG-CMD-001", "CWE-78"), "ssrf": ("VG-SSRF-001", "CWE-918"), "path": ("VG-PATH-001", "CWE-22")}
    of = lambda i: F.element_at(literal_map({k: n[i] for k, n in names.items()}), F.col("kind"))
    x = j.withColumn("v", verdict).where("v IS NOT NULL")
    return x.select("project", "rel_path", "func", "line", of(0).alias("rule_id"), of(1).alias("cwe"), F.col("v.s").alias("severity"), F.col("v.c").alias("confidence"), "callee").distinct()


def raw_html_hits(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, rule_id, severity): markup written from a value that is neither a literal nor a number nor escaped."""
    value = F.coalesce(F.nullif(F.regexp_extract("line", RAW_HTML, 1), F.lit("")), F.nullif(F.regexp_extract("line", RAW_HTML, 2), F.lit("")))
    escaped = taint.cleared(value).bitwiseAND(F.lit(1 << taint.KINDS.index("xss"))) > 0
    return lines.where(F.col("line").rlike(RAW_HTML) & (build_of(value) != "literal") & ~escaped).select(*keys, "line_no", F.lit("VG-XSS-001").alias("rule_id"), F.lit("HIGH").alias("severity"))


def evidence_tier(has_source: Column, has_flow: Column, has_sink: Column, sanitized: Column, literal: Column) -> Column:
    """confirmed, potential or informational, from five facts about a finding."""
    return F.when(literal | sanitized, "informational").when(has_source & has_sink & has_flow, "confirmed").when(has_sink, "potential").otherwise("informational")


def verified(findings: DataFrame) -> DataFrame:
    """(finding_key, tier, confidence): findings by the tier of their evidence."""
    bit = F.coalesce(taint.kind_bit(F.col("kind")), F.lit(0))
    x = findings.join(taint.flow_kinds(findings), "finding_key")
    literal = F.coalesce(F.regexp_extract("evidence", r"\(([^()]*)\)", 1).rlike(r"""^(?:"[^"{]*"|'[^'{]*'|[0-9]+)$"""), F.lit(False))
    tier = evidence_tier(F.col("source").isNotNull(), F.coalesce(F.array_size("data_flow"), F.lit(0)) >= 2, F.col("kind").isNotNull() | F.col("sink").isNotNull(), F.col("clears").bitwiseAND(bit) > 0, literal)
    confidence = F.when(tier == "confirmed", "HIGH").when(tier == "potential", "MEDIUM").otherwise("LOW")
    return x.select("finding_key", tier.alias("tier"), confidence.alias("confidence"))


# The terms of the score of an assignment that may hold a secret.
SECRET_FILE = r"(?i)(?:^|/)(?:\.env[^/]*|[^/]*\.env|password[^/]*\.txt|leak[^/]*\.txt|credentials?[^/]*|secrets?[^/]*)$"
SECRET_KEY = r"(?i)(?:^|[^A-Za-z])(?:password|passwd|pwd|api[_-]?key|secret|token|credential)s?\w*[\"'\]]*\s*(?::=|[:=])(?![=])"
COMPARISON = r"[!=]==?"
QUOTED_VALUE = r"""(?i)(?::=|[:=])\s*["']([^"']+)["']"""
PLACEHOLDERS = r"(?i)example|demo|changeme|dummy|placeholder|your|sample"
DOCUMENT_FILE, TEST_FILE = r"(?i)\.(?:md|rst|txt)$", r"(?i)(?:^|/)(?:tests?|fixtures?|mocks?|testdata)/"


def secret_scores(lines: DataFrame, keys: list[str], path: str = "rel_path") -> DataFrame:
    """(keys, line_no, score, label): lines that assign to a name that speaks of a secret, by a sum of ten terms; below 20 dropped."""
    line, p = F.col("line"), F.coalesce(F.col(path), F.lit(""))
    value = F.regexp_extract(line, QUOTED_VALUE, 1)
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (value.rlike("[^A-Za-z0-9]") | (F.length(value) >= 16))
    plain = F.lower(value).isin("", "password", "admin", "secret", "token")
    terms = [
        F.when(p.rlike(SECRET_FILE), 30), F.lit(25), F.lit(20), F.when(value != "", 15), F.when(~plain & ~value.rlike(PLACEHOLDERS), 15), F.when(mixed, 10), F.when(~p.rlike(DOCUMENT_FILE), 10),
        F.when(p.rlike(DOCUMENT_FILE), -30), F.when(line.rlike(PLACEHOLDERS), -25), F.when(line.rlike(r"^\s*(?:#|//|/\*|\*|--)"), -20), F.when(p.rlike(TEST_FILE), -40),
    ]
    score = sum((F.coalesce(t, F.lit(0)) for t in terms), F.lit(0))
    x = lines.where(line.rlike(SECRET_KEY) & ~line.rlike(COMPARISON)).select(*keys, "line_no", F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))
    label = F.when(F.col("score") >= 80, "HIGH").when(F.col("score") >= 50, "MEDIUM").otherwise("LOW")
    return x.where("score >= 20").select(*keys, "line_no", "score", label.alias("label"))


def label_percentages(scored: DataFrame) -> DataFrame:
    """(project, n, high, medium, low): whole percentages of the confidence labels."""
    part = lambda label: F.floor(100 * F.sum((F.col("label") == label).cast("int")) / F.count(F.lit(1))).cast("int")
    return scored.withColumn("label", confidence_label(F.col("score"))).groupBy("project").agg(F.count(F.lit(1)).alias("n"), part("HIGH").alias("high"), part("MEDIUM").alias("medium"), part("LOW").alias("low"))


def risk_level(score: Column) -> Column:
    """CRITICAL below 60, HIGH below 75, MEDIUM below 90, else LOW."""
    return F.when(score < 60, "CRITICAL").when(score < 75, "HIGH").when(score < 90, "MEDIUM").otherwise("LOW")


def enclosing_functions(facts: DataFrame) -> DataFrame:
    """(project, rel_path, line, kind, name, scope): for each call and assignment the first function, in order of definition, whose lines hold it; '' if none does.

    A range join within the file: equality on the file, then the interval.
    """
    f = facts.where("kind = 'function'").select("project", "rel_path", F.col("name").alias("scope"), F.col("line").alias("from"), "end_line")
    x = facts.where("kind IN ('call', 'assign')").select("project", "rel_path", "line", "kind", "name").distinct()
    held = x.join(f, ["project", "rel_path"]).where("line BETWEEN `from` AND end_line").groupBy("project", "rel_path", "line", "kind", "name").agg(F.min_by("scope", F.struct("from", "scope")).alias("scope"))
    return x.join(held, ["project", "rel_path", "line", "kind", "name"], "left").select("project", "rel_path", "line", "kind", "name", F.coalesce("scope", F.lit("")).alias("scope"))
