"""Taint: what is a source, a sink and a sanitizer, and how values flow over assignments and calls.

Flows are paths in one graph. Its nodes are variables of functions; an edge leads from a variable to one that
is assigned an expression with it, from an argument to the callee's parameter, and from a returned variable
to what the call is assigned to. An edge carries the kinds that a sanitizer on it clears, as bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import literal_map
from siftline.operators.graph import call_edges, gathered
from siftline.session import written

# The kinds, the words of sources, sinks and sanitizers.
KINDS = ("sql", "command", "ssrf", "path", "template", "xss", "deserialization")
ALL = (1 << len(KINDS)) - 1
SOURCES = (
    "request.args", "request.form", "request.values", "request.get_json", "request.json", "request.data", "request.cookies", "request.headers", "request.get", "request.post", "request.body",
    "request.files", "request.view_args", "request.query_string", "request.stream", "input(", "sys.argv", "req.query", "req.body", "req.params", "req.headers", "req.cookies", "req.signedcookies", "req.param(",
    "request.query", "request.params", "process.argv", "window.location", "document.location", "r.url.query()", "r.formvalue(", "r.postformvalue(", "c.query(", "c.param(", "c.body(", "os.args",
    "request.getparameter(", "request.getheaders(", "request.getreader(", "@requestparam", "@pathvariable", "@requestbody",
)
UNTRUSTED_NAMES = ("user_id", "uid", "username", "param", "query", "host", "url", "cmd", "command", "filename", "path", "payload", "data", "input", "req", "request")
SQL_NEVER = ("tmpl", "template", "htmltemplate", "texttemplate", "t", "w", "writer", "cmd", "rootcmd", "command", "cobracommand", "c", "app", "task", "runner", "workflow", "future", "promise", "executor", "batch")
SQL_RECEIVERS = ("db", "cursor", "cur", "conn", "connection", "session", "orm", "tx", "sql", "repo", "repository", "client", "engine", "stmt")
SQL_METHODS = ("executemany", "query", "queryrow", "query_row", "raw", "executequery", "executeupdate")
SINKS = {
    "command": r"^(?:os\.(?:system|popen)|exec\.command|runtime\.getruntime\(\)\.exec|processbuilder|eval|system)$|^(?:subprocess|child_process)\.",
    "ssrf": r"^(?:requests\.(?:get|post|request)|urllib\.request\.urlopen|httpx\.(?:get|post)|http\.(?:get|post|newrequest)|axios\.(?:get|post)|fetch$|redirect$)",
    "path": r"^(?:open|os\.(?:remove|unlink|open|readfile)|shutil\.rmtree|fs\.(?:readfile|writefile)\w*|files\.readallbytes|send_file|send_from_directory)$",
    "template": r"render_template_string|jinja2\.template|from_string",
    "xss": r"markupsafe\.markup|response\.write|res\.(?:send|write)$",
    "deserialization": r"^(?:_?pickle\.loads?|yaml\.(?:unsafe_load|load)|marshal\.loads?|shelve\.open|unserialize|readobject)",
}
SANITIZERS = (
    (("int(", "float(", "parseint(", "parsefloat(", "number(", "strconv.atoi(", "strconv.parseint(", "integer.parseint(", "long.parselong(", "double.parsedouble(", "to_i"), ("sql", "command", "xss")),
    (("shlex.quote(", "escapeshellarg(", "escapeshellcmd(", "shell_escape("), ("command",)),
    (("os.path.basename(", "path.basename(", "filepath.base(", "secure_filename(", "path.clean(", "filepath.clean("), ("path",)),
    (("is_safe_url(", "validate_ip(", "check_url_allowlist(", "is_allowed_host("), ("ssrf",)),
    (("html.escape(", "cgi.escape(", "dompurify.sanitize(", "escapehtml(", "encodeuricomponent(", "validator.escape("), ("xss",)),
    (("yaml.safe_load(", "json.loads(", "json.parse(", "json.unmarshal("), ("deserialization",)),
    (("uuid.parse(", "uuid.uuid(", "uuid.uuid4(", "uuid.uuid1(", "uuid.fromstring(", "uuid.mustparse(", "uuid.new(", "is_uuid("), ("sql", "command", "path")),
    (("bool(", "boolean(", "strconv.parsebool(", "parse_bool("), ("sql", "command", "path", "xss", "ssrf")),
    (("urllib.parse.quote(", "url.queryescape(", "url.pathescape("), ("path", "command")),
    (("hex.encodetostring(", "base64.b64encode(", "base64.stdencoding.encodetostring("), ("sql", "command")),
)
RULES = {
    "sql": ("VG-TAINT-SQL", "CWE-89"), "command": ("VG-TAINT-CMD", "CWE-78"), "ssrf": ("VG-TAINT-SSRF", "CWE-918"), "path": ("VG-TAINT-PATH", "CWE-22"),
    "template": ("VG-TAINT-SSTI", "CWE-1336"), "xss": ("VG-TAINT-XSS", "CWE-79"), "deserialization": ("VG-TAINT-DESER", "CWE-502"),
}


def _any(c: Column, texts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in texts))


def is_source(expr: Column) -> Column:
    return _any(F.lower(expr), SOURCES)


def is_untrusted_name(name: Column) -> Column:
    return _any(F.lower(name), UNTRUSTED_NAMES)


def sink_kind(callee: Column) -> Column:
    """The kind of sink that a call is, or null. execute and exec are queries on receivers that stand for a database."""
    low = F.lower(callee)
    method, receiver = F.element_at(F.split(low, r"\."), -1), F.element_at(F.split(F.regexp_replace(low, r"\.?[^.]*$", ""), r"\."), -1)
    database = receiver.isin(*SQL_RECEIVERS) | receiver.rlike("(?:db|conn|cursor|session|repo)$")
    query = F.when(F.contains(low, F.lit(".")), ~receiver.isin(*SQL_NEVER) & F.when(method.isin("execute", "exec"), database).otherwise(method.isin(*SQL_METHODS)))
    out = F.when(F.coalesce(query, F.lit(False)), "sql")
    for kind, pattern in SINKS.items():
        out = out.when(low.rlike(pattern), kind)
    return out


def cleared(expr: Column) -> Column:
    """The kinds, as bits, that the sanitizers in an expression neutralise."""
    low = F.lower(F.coalesce(expr, F.lit("")))
    parts = [F.when(_any(low, texts), F.lit(sum(1 << KINDS.index(k) for k in kinds))).otherwise(0) for texts, kinds in SANITIZERS]
    safe = F.when(F.contains(low, F.lit("render_template(")) & ~F.contains(low, F.lit("render_template_string(")), 1 << KINDS.index("template")).otherwise(0)
    return reduce(lambda a, b: a.bitwiseOR(b), [*parts, safe])


def kind_bit(kind: Column) -> Column:
    return F.element_at(literal_map({k: 1 << i for i, k in enumerate(KINDS)}), kind)


def names_of(expr: Column) -> Column:
    """The identifiers of an expression outside its literals."""
    bare = F.regexp_replace(expr, r"""(?<![fF])"[^"]*"|(?<![fF])'[^']*'""", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[A-Za-z_]\w*"), 0))


def _node(file: str, func: str, var: Column | str) -> Column:
    return F.concat_ws("\x1f", file, F.coalesce(F.col(func), F.lit("")), var)


def flow_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, starts, ends): edges (project, a, b, clears), starts (project, node, source, file, line), ends (project, node, kind, clears, callee, file, line)."""
    assigned = facts.where("kind = 'assign'").select("project", "rel_path", "func", "line", F.col("name").alias("target"), F.col("text").alias("expr"))
    inner = assigned.select("project", F.explode(names_of(F.col("expr"))).alias("v"), "rel_path", "func", "target", cleared(F.col("expr")).alias("clears")).where("v <> target")
    inner = inner.select("project", _node("rel_path", "func", "v").alias("a"), _node("rel_path", "func", "target").alias("b"), "clears")
    calls = facts.where("kind = 'call'").select("project", "rel_path", "func", "line", F.col("name").alias("callee"), "args", F.element_at(F.split("name", r"\."), -1).alias("short"))
    known = call_edges(facts).select("project", F.col("caller_file").alias("rel_path"), F.col("caller").alias("func"), "line", F.col("callee").alias("short"), "callee_file")
    params = facts.where("kind = 'function'").select("project", F.col("rel_path").alias("callee_file"), F.col("name").alias("short"), F.posexplode("args").alias("i", "param"))
    passed = calls.select("project", "rel_path", "func", "line", "short", F.posexplode("args").alias("i", "arg")).join(known, ["project", "rel_path", "func", "line", "short"]).join(params, ["project", "callee_file", "short", "i"])
    passed = passed.select("project", F.explode(names_of(F.col("arg"))).alias("v"), "rel_path", "func", "callee_file", "short", "param", cleared(F.col("arg")).alias("clears"))
    passed = passed.select("project", _node("rel_path", "func", "v").alias("a"), _node("callee_file", "short", "param").alias("b"), "clears")
    returned = facts.where("kind = 'return'").select("project", F.col("rel_path").alias("callee_file"), F.col("func").alias("short"), F.explode(names_of(F.col("text"))).alias("v"), cleared(F.col("text")).alias("clears")).where("short <> ''")
    back = assigned.join(known, ["project", "rel_path", "func", "line"]).select("project", "callee_file", "short", "rel_path", "func", "target").distinct().join(returned, ["project", "callee_file", "short"])
    back = back.select("project", _node("callee_file", "short", "v").alias("a"), _node("rel_path", "func", "target").alias("b"), "clears")
    edges = inner.unionByName(passed).unionByName(back).distinct()
    direct = assigned.where(is_source(F.col("expr"))).select("project", _node("rel_path", "func", "target").alias("node"), F.col("expr").alias("source"), F.col("rel_path").alias("file"), "line")
    named = facts.where("kind = 'function'").select("project", "rel_path", F.col("name").alias("func"), "line", F.explode("args").alias("param")).where(is_untrusted_name(F.col("param")))
    named = named.select("project", _node("rel_path", "func", "param").alias("node"), F.concat(F.lit("parameter "), "param").alias("source"), F.col("rel_path").alias("file"), "line")
    ends = calls.withColumn("kind", sink_kind(F.col("callee"))).where("kind IS NOT NULL")
    ends = ends.withColumn("used", F.when(F.col("kind") == "sql", F.slice("args", 1, 1)).otherwise(F.col("args")))
    ends = ends.select("project", "rel_path", "func", "line", "callee", "kind", F.explode("used").alias("arg"))
    ends = ends.select("project", F.explode(names_of(F.col("arg"))).alias("v"), "rel_path", "func", "kind", cleared(F.col("arg")).alias("clears"), "callee", "line")
    ends = ends.select("project", _node("rel_path", "func", "v").alias("node"), "kind", "clears", "callee", F.col("rel_path").alias("file"), "line").distinct()
    return edges, direct.unionByName(named).distinct(), ends


def origin_of() -> Column:
    return F.concat_ws(":", "file", "line", "source")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(project, origin, node, kinds, steps): every variable that a source reaches, with the kinds that are still tainted there.

    `edges` and `starts` are those of flow_graph(). A round sends on only what it reached anew, by origin, node
    and remaining kinds; these are finite, so the rounds end by themselves. Each round is written, and read as one
    table with those before it.
    """
    seen = front = written(starts.select("project", origin_of().alias("origin"), "node", F.lit(ALL).alias("kinds"), F.lit(0).alias("steps")).distinct(), "reached")
    if front.isEmpty():
        return seen
    edges = written(edges.withColumnRenamed("a", "node"), "edges")
    for k in count(1):
        step = front.join(edges, ["project", "node"]).select("project", "origin", F.col("b").alias("node"), F.col("kinds").bitwiseAND(F.lit(ALL) - F.col("clears")).alias("kinds"), F.lit(k).alias("steps"))
        front = written(step.where("kinds > 0").distinct().join(seen, ["project", "origin", "node", "kinds"], "left_anti"), "reached")
        if front.isEmpty():
            return seen
        seen = gathered(seen.unionByName(front), k)


def reached_names(seen: DataFrame) -> DataFrame:
    """(project, rel_path, func, name, kinds, origin): reached() by variable, with all kinds that arrive by any way."""
    at = lambda i: F.get(F.split("node", "\x1f"), i)
    x = seen.select("project", at(0).alias("rel_path"), at(1).alias("func"), at(2).alias("name"), "kinds", "origin", "steps")
    return x.groupBy("project", "rel_path", "func", "name").agg(F.bit_or("kinds").alias("kinds"), F.min_by("origin", F.struct("steps", "origin")).alias("origin"))


def flows(facts: DataFrame, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(project, rule_id, cwe, kind, severity, source, source_file, source_line, sink, sink_file, sink_line, steps): the shortest flow of each source to each sink.

    Kinds that every edge on the way leaves tainted arrive. CRITICAL across files, else HIGH. `graph` and `seen`:
    flow_graph() and reached(), where they are at hand.
    """
    edges, starts, ends = flow_graph(facts) if graph is None else graph
    if seen is None:
        starts, ends = written(starts, "starts"), written(ends, "ends")
        seen = reached(edges.where("false") if ends.isEmpty() else edges, starts)  # nothing to be reached, no way to be gone
    hit = seen.join(ends, ["project", "node"]).where(F.col("kinds").bitwiseAND(F.lit(ALL) - F.col("clears")).bitwiseAND(kind_bit(F.col("kind"))) > 0)
    src = starts.select("project", origin_of().alias("origin"), "source", F.col("file").alias("source_file"), F.col("line").alias("source_line")).distinct()
    x = hit.groupBy("project", "origin", "kind", F.col("callee").alias("sink"), F.col("file").alias("sink_file"), F.col("line").alias("sink_line")).agg(F.min("steps").alias("steps")).join(src, ["project", "origin"])
    rule = lambda i: F.element_at(literal_map({k: r[i] for k, r in RULES.items()}), F.col("kind"))
    severity = F.when(F.col("source_file") != F.col("sink_file"), "CRITICAL").otherwise("HIGH")
    return x.select("project", rule(0).alias("rule_id"), rule(1).alias("cwe"), "kind", severity.alias("severity"), "source", "source_file", "source_line", "sink", "sink_file", "sink_line", "steps")


def flow_kinds(findings: DataFrame) -> DataFrame:
    """(finding_key, from_source, kind, clears): what the two ends and the evidence of a finding say, by the same predicates."""
    ends = F.coalesce(F.col("sink"), F.regexp_extract("evidence", r"([A-Za-z_][\w.]*)\(", 1))
    return findings.select("finding_key", F.coalesce(is_source(F.col("source")), F.lit(False)).alias("from_source"), sink_kind(ends).alias("kind"), cleared(F.col("evidence")).alias("clears"))
