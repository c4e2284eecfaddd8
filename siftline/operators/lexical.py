"""The lexical rules over lines: one narrow projection, then windows where a rule looks further than its line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import blank, mask
from siftline.operators import rules as R
from siftline.operators import semantic, taint


def _harmless(rule_id: str, low: Column) -> Column:
    out = F.lit(False)
    for s in R.HARMLESS.get(rule_id, ()):
        out = out | low.contains(s)
    return out


def _holds_one(low: Column, texts: Sequence[str]) -> Column:
    out = F.lit(not texts)
    for t in texts:
        out = out | low.contains(t)
    return out


def is_code_line(line: Column) -> Column:
    """Neither a comment nor a line of a rule's own description."""
    return ~line.rlike(R.COMMENT) & ~line.rlike(R.METADATA)


def rule_hits(lines: DataFrame, keys: Sequence[str], rules: Sequence[R.Rule] = R.RULES) -> DataFrame:
    """(keys, line_no, rule_id, severity, confidence, cwe, title, category, evidence) for each rule that a line breaks.

    Every pattern is a literal of the projection, so that it is compiled once for each task and there is no
    join of lines with rules. Deserialisation is LOW on a literal, CRITICAL on request data, else HIGH.
    Evidence of secrets is masked. Comments and descriptions of rules break no code rule. A rule hits a line once. Null lines hit nothing.
    """
    line, low = F.col("line"), F.col("low")
    hits = []
    for r in rules:
        severity, confidence = F.lit(r.severity), F.lit("MEDIUM")
        if r.rule_id == "VG-SAST-009":
            arg = F.regexp_extract(line, r"\((.*)\)", 1)
            literal = F.trim(arg).rlike(r"""^(?:b?"[^"]*"|b?'[^']*'|-?[0-9]+)$""")
            reached = F.lit(False)
            for w in R.ATTACKER_WORDS:
                reached = reached | line.contains(w)
            severity = F.when(literal, "LOW").when(reached, "CRITICAL").otherwise("HIGH")
            confidence = F.when(literal, "LOW").otherwise("HIGH")
        meta = F.struct(F.lit(r.rule_id).alias("rule_id"), severity.alias("severity"), confidence.alias("confidence"), F.lit(r.cwe).alias("cwe"), F.lit(r.title).alias("title"), F.lit(r.category).alias("category"))
        hit = _holds_one(low, R.NEEDS.get(r.rule_id, ())) & line.rlike(r.pattern) & ~_harmless(r.rule_id, low)
        hits.append(F.when(hit & F.col("is_code") if r in R.CODE_RULES else hit, meta))
    found = lines.withColumns({"is_code": is_code_line(line), "low": F.lower("line")}).select(*keys, "line_no", "line", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    evidence = F.when(F.col("h.category") == "secret", mask(blank("line"))).otherwise(blank("line"))
    return found.select(*keys, "line_no", "h.*", evidence.alias("evidence"))


def missing_webhook_signature(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, route_line, line_no): webhook routes whose body is read within WEBHOOK_REACH lines in a file that checks no signature.

    line_no is the first line that reads the body, the route's own line included.
    """
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(0, R.WEBHOOK_REACH - 1)
    whole = Window.partitionBy(*keys)
    reads = F.min(F.when(F.col("line").rlike(R.WEBHOOK_BODY), F.col("line_no"))).over(w)
    signed = F.max(F.col("line").rlike(R.WEBHOOK_SIGNED)).over(whole)
    x = lines.withColumn("reads", reads).withColumn("signed", signed)
    return x.where(F.col("line").rlike(R.WEBHOOK_ROUTE) & F.col("reads").isNotNull() & ~F.col("signed")).select(*keys, F.col("line_no").alias("route_line"), F.col("reads").alias("line_no"))


def diff_secrets(added: DataFrame, keys: Sequence[str], file: str = "file", text: str = "text") -> DataFrame:
    """(keys, file, title, evidence) of added lines that hold a secret; the first pattern that holds counts, evidence is masked.

    `added` is corpus.diff_added(). Passwords in documents, or with a value that says nothing, don't count.
    """
    # Titles, patterns, document extensions and harmless values.
    t, low = F.col(text), F.lower(text)
    document = F.lower(F.coalesce(F.col(file), F.lit(""))).rlike(r"\.(?:md|markdown|rst|txt|html?|adoc)$")
    harmless = low.rlike(r'''"admin"|"password"|""|"\.\.\."|read-host|param\(''')
    title = (
        F.when(t.rlike("AKIA[0-9A-Z]{16}"), "AWS Access Key in Pushed Commit")
        .when(t.rlike(r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['"][^'"]{8,}"""), "Generic API Key in Pushed Commit")
        .when(t.rlike("-----BEGIN (?:RSA|DSA|EC|OPENSSH)? PRIVATE KEY-----"), "Private Key in Pushed Commit")
        .when(t.rlike(r"""(?i)password\s*=\s*"[^"]+\"""") & ~document & ~harmless, "Password Assignment in Pushed Commit")
    )
    shown = F.when(F.length(blank(text)) > 8, F.concat(F.substring(blank(text), 1, 8), F.lit("****"))).otherwise(blank(text))
    return added.withColumn("title", title).where("title IS NOT NULL").select(*keys, file, "title", shown.alias("evidence"))


def tracked_sensitive(files: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """(keys, name): key and credential files that a repository tracks."""
    return files.where(F.col(name).rlike(r"^(?:id_rsa|id_dsa|\.htpasswd|credentials\..*|.*\.pem)$")).select(*keys, name)


def sensitive_names(files: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """(keys, name): files whose name says that they hold credentials."""
    pattern = r"(?i)^(?:\.env(?:\..+)?|.*\.env|id_rsa|id_dsa|id_ecdsa|id_ed25519|.*\.(?:pem|key|p12|pfx|jks|keystore)|\.netrc|\.npmrc|\.pypirc|credentials(?:\.json)?|secrets?\.(?:json|ya?ml|toml))$"
    return files.where(F.col(name).rlike(pattern)).select(*keys, name)


#: The rules whose lines are judged by what their arguments are.
JUDGED = ("VG-SAST-001", "VG-SAST-002", "VG-SAST-008", "VG-CMD-LIST")
_SHELL = r"shell\s?=\s?True|shell=1"
_FIXED_TEXT = r"""^(?:"[^"]*"|'[^']*'|-?[0-9]+|true|false)$"""


def judged(hits: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """rule_hits() with source, and without the hits on queries and commands that nothing but fixed or made-safe values reach.

    `names` are taint.reached_names(). A query goes if what it holds of a source was made safe for queries. A
    command goes if its arguments are literals and names that hold nothing else, and a list of arguments without
    a shell is left to the rule on lists, which goes if all its items are such or made safe. Where a tainted name
    is in the line, source says where it comes from, confidence is HIGH, and commands are CRITICAL, lists HIGH.
    """
    keys = ["project", "rel_path", "line_no"]
    mine = hits.where(F.col("rule_id").isin(*JUDGED))
    scopes = facts.where("kind = 'function'").select("project", "rel_path", F.col("name").alias("func"), F.col("line").alias("begins"), "end_line")
    at = mine.select(*keys, "evidence").distinct()
    inside = at.select(*keys).distinct().join(scopes, ["project", "rel_path"]).where("line_no BETWEEN begins AND end_line").groupBy(*keys).agg(F.max_by("func", "begins").alias("func"))
    at = at.join(inside, keys, "left").select(*keys, F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("func", F.lit(""))))).alias("func"), "evidence")
    at = at.select(*keys, "func", F.explode(taint.names_of(F.col("evidence"))).alias("name"))
    fixed = semantic.constants(facts).select("project", "rel_path", "name", F.lit(True).alias("fixed"))
    at = at.join(fixed, ["project", "rel_path", "name"], "left").join(names, ["project", "rel_path", "func", "name"], "left")
    has = lambda kind: F.col("kinds").bitwiseAND(F.lit(1 << taint.KINDS.index(kind))) > 0
    held = lambda c: F.collect_set(F.when(c, F.col("name")))
    told = at.groupBy(*keys).agg(
        held(F.col("fixed") & F.col("kinds").isNull()).alias("fixed"), held(has("sql")).alias("sql"), held(~has("sql")).alias("sql_safe"), held(has("command")).alias("cmd"), held(~has("command")).alias("cmd_safe"),
        F.min(F.when(has("sql"), F.col("origin"))).alias("sql_from"), F.min(F.when(has("command"), F.col("origin"))).alias("cmd_from"),
    )
    none = F.array().cast("array<string>")
    lists = ("fixed", "sql", "sql_safe", "cmd", "cmd_safe")
    x = mine.join(told, keys, "left").withColumns({c: F.coalesce(c, none) for c in lists})
    line, some = F.col("evidence"), lambda c: F.size(c) > 0
    shell, quoted = line.rlike(_SHELL), F.contains(line, F.lit("shlex.quote"))
    still = lambda i: F.trim(i).rlike(_FIXED_TEXT) | F.array_contains("fixed", F.trim(i))
    inner = F.regexp_extract(line, r"\[(.*)\]", 1)
    item_safe = lambda i: still(i) | F.array_contains("cmd_safe", F.trim(i)) | F.contains(i, F.lit("shlex.quote"))
    args = F.trim(F.regexp_extract(line, r"\((.*)\)", 1))
    joined = args.rlike(r"""[%]|f["']|\$\{|format\(""")
    literal = (args != "") & ~joined & ~some("cmd") & F.forall(F.split(args, r"\s*[+,]\s*"), lambda a: still(a) | a.rlike(r"^\[.*\]$"))
    rule = F.col("rule_id")
    gone = (
        F.when(rule == "VG-SAST-001", some("sql_safe") & ~some("sql"))
        .when(rule == "VG-CMD-LIST", shell | F.forall(F.split(inner, ","), item_safe))
        .when(rule == "VG-SAST-002", ~shell & (line.rlike(r"\[.*\]") | literal))
        .otherwise(F.lit(False))
    )
    hot = F.when(rule == "VG-SAST-001", some("sql")).otherwise(some("cmd") & ~quoted)
    source = F.when(hot, F.when(rule == "VG-SAST-001", F.col("sql_from")).otherwise(F.col("cmd_from")))
    severity = F.when(hot & rule.isin("VG-SAST-002", "VG-SAST-008"), "CRITICAL").otherwise(F.col("severity"))
    x = x.where(~gone).withColumns({"severity": severity, "confidence": F.when(hot, "HIGH").otherwise(F.col("confidence")), "source": source})
    rest = hits.where(~rule.isin(*JUDGED)).withColumn("source", F.lit(None).cast("string"))
    return rest.unionByName(x.select(rest.columns))
