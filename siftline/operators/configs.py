"""Configuration files as entries of key and value, and the rules on them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftline.functions.text import mask
from siftline.session import written
from siftline.sources.corpus import basename, lines

_KEY = re.compile(r"^(\s*)(?:-\s+)?[\"']?([\w.\-/ ]+?)[\"']?\s*:(?:\s+(.*))?$")


def config_format(path: Column) -> Column:
    """env, yaml, json, toml, ini or other, by the file's name."""
    p, n = F.lower(path), F.lower(basename(path))
    return (
        F.when((n == ".env") | n.startswith(".env.") | n.endswith(".env"), "env")
        .when(p.rlike(r"\.ya?ml$"), "yaml")
        .when(p.endswith(".json"), "json")
        .when(p.endswith(".toml"), "toml")
        .when(p.rlike(r"\.(?:ini|cfg|conf)$"), "ini")
        .otherwise("other")
    )


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2")


def flat_entries(files: DataFrame, format: str | None = None) -> DataFrame:  # noqa: A002
    """Entries of the line formats env, ini and toml: (project, rel_path, format, section, key, value, raw_line, line_no).

    The section is carried down from its [header]. ini takes '=' before ':'. `format` reads all files as that one.
    """
    f = files.withColumn("format", F.lit(format) if format else config_format(F.col("rel_path"))).where(F.col("format").isin("env", "ini", "toml"))
    x = lines(f, ["project", "rel_path", "format"])
    w = Window.partitionBy("project", "rel_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^\s*\[+\s*([^\]]+?)\s*\]+", 1)
    x = x.withColumn("section", F.when(F.col("format") != "env", F.last(F.when(header != "", header), ignorenulls=True).over(w)))
    text = F.when(F.col("format") == "env", F.regexp_replace("line", r"^\s*export\s+", "")).otherwise(F.col("line"))
    by_equal, by_colon = r"^\s*([^=\s\[#;][^=]*?)\s*=\s*(.*)$", r"^\s*([^:=\s\[#;][^:=]*?)\s*:\s*(.*)$"
    pattern = F.when(text.rlike(by_equal), 1).when((F.col("format") == "ini") & text.rlike(by_colon), 2)
    key = F.when(pattern == 1, F.regexp_extract(text, by_equal, 1)).when(pattern == 2, F.regexp_extract(text, by_colon, 1))
    value = F.when(pattern == 1, F.regexp_extract(text, by_equal, 2)).when(pattern == 2, F.regexp_extract(text, by_colon, 2))
    x = x.where(~F.col("line").rlike(r"^\s*(?:[#;]|//)") & key.isNotNull())
    full = F.when(F.col("section").isNotNull(), F.concat("section", F.lit("."), key)).otherwise(key)
    return x.select("project", "rel_path", "format", "section", full.alias("key"), _unquoted(value).alias("value"), F.col("line").alias("raw_line"), "line_no")


def nested_text_entries(text: str) -> list[tuple[str, str, str, int]]:
    """(key, value, raw_line, line_no) of the mappings of an indented document; keys are joined by dots, list items aren't entries."""
    stack: list[tuple[int, str]] = []
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip() or line.lstrip().startswith(("#", "---")):
            continue
        m = _KEY.match(line)
        if not m:
            continue
        depth, key, value = len(m[1]), m[2].strip(), (m[3] or "").strip()
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if value and value not in ("|", ">", "|-", ">-"):
            out.append((".".join([*(k for _, k in stack), key]), re.sub(r"^([\"'])(.*)\1$", r"\2", value), line, no))
        else:
            stack.append((depth, key))
    return out


def json_entries(text: str) -> list[tuple[str, str, str, int]]:
    """The same of a JSON document: objects and their lists, a.b[0]; the line is the first that holds the key. Scalars in lists aren't entries."""
    import json

    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return []
    rows = [line.rstrip("\r") for line in text.split("\n")]
    out: list[tuple[str, str, str, int]] = []
    todo: list[tuple[str, object]] = [("", doc)]
    while todo:
        at, x = todo.pop(0)
        for key, v in x.items() if isinstance(x, dict) else enumerate(x):
            path = f"{at}[{key}]" if isinstance(x, list) else f"{at}.{key}" if at else str(key)
            if isinstance(v, dict | list):
                todo.append((path, v))
            elif isinstance(x, dict):
                no = next((i for i, line in enumerate(rows, 1) if f'"{key}"' in line), 1)
                out.append((path, v if isinstance(v, str) else json.dumps(v), rows[no - 1], no))
    return out


def nested_entries(files: DataFrame) -> DataFrame:
    """Entries of yaml and json files, by a small parser in one Arrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (p, r, f, None, *e)
                for p, r, f, t in zip(b["project"], b["rel_path"], b["format"], b["content"], strict=True)
                for e in (json_entries(t) if f == "json" else nested_text_entries(t))
            ]
            yield pd.DataFrame(rows, columns=["project", "rel_path", "format", "section", "key", "value", "raw_line", "line_no"])

    f = files.withColumn("format", config_format(F.col("rel_path"))).where(F.col("format").isin("yaml", "json") & F.col("content").isNotNull())
    return f.select("project", "rel_path", "format", "content").mapInPandas(run, "project string, rel_path string, format string, section string, key string, value string, raw_line string, line_no int")


def entries(files: DataFrame) -> DataFrame:
    """The entries of all configuration files: those of a known format and those called config.*. A file without any is read as ini."""
    named = F.lower(basename(F.col("rel_path"))).rlike(r"^config\.")
    files = files.where((config_format(F.col("rel_path")) != "other") | named)
    known = written(flat_entries(files).unionByName(nested_entries(files)), "entries")
    without = files.join(known.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_anti")
    return known.unionByName(flat_entries(without, "ini"))


# The words, values and patterns of the rules.
OFF, ON = ("false", "0", "no"), ("true", "1")
SECRET_KEY = r"(?i)api[_-]?key|secret|password|passwd|pwd|jwt|token|private[_-]?key|auth"
SECRET_VALUE = r"AKIA[0-9A-Z]{16}|eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+"
URL_PASSWORD = r"(?i)[a-z0-9_-]+://[^:]*:([^@]+)@"
COMMON_PASSWORDS = ("admin", "password", "password123", "root", "postgres", "changeme", "secret", "123456", "default")
CONFIG_RULES = {
    "VG-CFG-001": "MEDIUM", "VG-CFG-002": "MEDIUM", "VG-CFG-003": "LOW", "VG-CFG-005": "MEDIUM", "VG-CFG-006": "HIGH",
    "VG-CFG-007": "HIGH", "VG-CFG-008": "CRITICAL", "VG-CFG-009": "HIGH", "VG-CFG-010": "HIGH",
}


def config_hits(found: DataFrame) -> DataFrame:
    """(project, rel_path, line_no, rule_id, severity, key, evidence) for each rule that an entry breaks; secrets are masked."""
    k, v, low = F.lower("key"), F.lower("value"), F.lower("raw_line")
    has = lambda *xs: k.rlike("|".join(xs))
    secret = F.col("key").rlike(SECRET_KEY)
    in_url = F.regexp_extract("value", URL_PASSWORD, 1)
    unreal = v.rlike("dummy|placeholder|example")
    none = has("algorithm") & (v == "none")
    open_jwt = (has("verify_signature") & v.isin("false", "0")) | (has("allow_unverified", "allow_none") & v.isin(*ON))
    rules = {
        "VG-CFG-001": (has("debug") & v.isin("true", "1", "yes", "on")) | (has("env") & v.isin("development", "dev") & low.contains("debug")),
        "VG-CFG-002": has("cors", "allow_origin", "allowed_origin") & ((F.trim("value") == "*") | F.col("value").rlike(r"'\*'|\"\*\"|\[\*\]")),
        "VG-CFG-003": has("host", "bind", "address", "listen") & F.col("value").rlike(r"0\.0\.0\.0|::"),
        "VG-CFG-005": has("url", "endpoint", "api_base", "host") & v.startswith("http://") & ~v.rlike(r"localhost|127\.0\.0\.1"),
        "VG-CFG-006": (has("cookie_secure", "cookie_httponly", "strict_transport_security") & (v == "false"))
        | (has("csrf_enabled", "csrf_protection") & v.isin("false", "0"))
        | (has("disable_csrf") & v.isin(*ON))
        | (has("samesite") & (v == "none")),
        "VG-CFG-007": (has("ssl_verify", "tls_verify", "verify_ssl", "reject_unauthorized") & v.isin(*OFF)) | (has("insecure_skip") & v.isin(*ON)),
        "VG-CFG-008": F.col("value").rlike(SECRET_VALUE) | ((in_url != "") & ~in_url.isin("password", "root", "admin")) | (secret & (F.octet_length("value") >= 16) & ~unreal),
        "VG-CFG-009": secret & v.isin(*COMMON_PASSWORDS),
        "VG-CFG-010": none | (has("jwt", "token") & open_jwt),
    }
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(CONFIG_RULES[r]).alias("severity"))) for r, c in rules.items())))
    x = found.select("project", "rel_path", "line_no", "key", "value", "raw_line", F.explode(hits).alias("h"))
    evidence = F.when(F.col("h.rule_id") == "VG-CFG-008", F.concat("key", F.lit("="), mask("value"))).otherwise(F.trim("raw_line"))
    return x.select("project", "rel_path", "line_no", "h.*", "key", evidence.alias("evidence"))


def env_not_ignored(files: DataFrame) -> DataFrame:
    """(project, rel_path): .env files of projects whose .gitignore doesn't list them, or that have none."""
    env = files.where(F.lower(basename(F.col("rel_path"))).rlike(r"^\.env$|\.env$"))
    ignore = files.where(basename(F.col("rel_path")) == ".gitignore")
    listed = lines(ignore, ["project"]).where(F.trim("line").isin(".env", "*.env", "/.env", ".env*")).select("project").distinct()
    return env.join(listed, "project", "left_anti").select("project", "rel_path")
