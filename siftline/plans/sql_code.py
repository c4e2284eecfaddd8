"""DuckDB statements for the queries on graphs, taint, manifests, reports and streams."""

from siftline.operators import code, semantic, taint
from siftline.plans.sql import _LABEL, _SCORED, _SEVERITY, P4_AFFECTED, P4_FOUND, P4_RANGES, P4_VULNERABILITIES, RSK_PROJECTS, lines, quoted
from siftline.sinks import reports

GRF_LEVELS = """
WITH RECURSIVE s AS (SELECT project, data_flow[i] AS a, data_flow[i + 1] AS b FROM (SELECT project, data_flow, unnest(range(1, len(data_flow))) AS i FROM findings WHERE data_flow IS NOT NULL)),
e AS (SELECT DISTINCT project, a, b FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
w(project, node, depth) USING KEY (project, node) AS (SELECT DISTINCT project, a, 0 FROM e WHERE starts_with(a, 'request.')
  UNION SELECT DISTINCT w.project, e.b, w.depth + 1 FROM w JOIN e ON e.project = w.project AND e.a = w.node WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.project = w.project AND r.node = e.b))
SELECT project, node, depth FROM w
"""


def _any(c: str, texts: tuple) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(t)})" for t in texts) + ")"


def _sink(c: str) -> str:
    low = f"lower({c})"
    method, receiver = f"regexp_extract({low}, '[^.]*$')", f"regexp_extract(regexp_replace({low}, '[.]?[^.]*$', ''), '[^.]*$')"
    names = lambda xs: "(" + ", ".join(quoted(x) for x in xs) + ")"
    query = f"contains({low}, '.') AND {receiver} NOT IN {names(taint.SQL_NEVER)} AND CASE WHEN {method} IN ('execute', 'exec') THEN {receiver} IN {names(taint.SQL_RECEIVERS)} OR regexp_matches({receiver}, '(?:db|conn|cursor|session|repo)$') ELSE {method} IN {names(taint.SQL_METHODS)} END"
    return f"CASE WHEN {query} THEN 'sql' " + " ".join(f"WHEN regexp_matches({low}, {quoted(p)}) THEN {quoted(k)}" for k, p in taint.SINKS.items()) + " END"


def _cleared(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    parts = [f"CASE WHEN {_any(low, texts)} THEN {sum(1 << taint.KINDS.index(k) for k in kinds)} ELSE 0 END" for texts, kinds in taint.SANITIZERS]
    return " | ".join([f"({p})" for p in parts] + [f"(CASE WHEN contains({low}, 'render_template(') AND NOT contains({low}, 'render_template_string(') THEN {1 << taint.KINDS.index('template')} ELSE 0 END)"])


_CALLEE = quoted(r"([A-Za-z_][\w.]*)\(")
TNT_KINDS = f"SELECT finding_key, coalesce({_any('lower(source)', taint.SOURCES)}, false) AS from_source, {_sink('ends')} AS kind, {_cleared('evidence')} AS clears FROM (SELECT *, coalesce(sink, regexp_extract(evidence, {_CALLEE}, 1)) AS ends FROM findings)"
_DEPS = "SELECT DISTINCT project, source_file AS rel_path, trim(name, ' ') AS n, trim(version, ' ') AS v, regexp_extract(source_file, '[^/]*$') AS f, regexp_extract(source_file, '^(.*/)?[^/]*$', 1) AS dir FROM deps WHERE trim(name, ' ') <> ''"
_PINNED = quoted(r"^[^=<>!~\[\s]+")
DEP_MANIFESTS = f"""
WITH d AS ({_DEPS}), k AS (SELECT * FROM d WHERE NOT (f = 'package.json' AND EXISTS (SELECT 1 FROM d l WHERE l.project = d.project AND l.dir = d.dir AND l.f = 'package-lock.json')) AND NOT (f = 'Cargo.toml' AND EXISTS (SELECT 1 FROM d l WHERE l.project = d.project AND l.dir = d.dir AND l.f = 'Cargo.lock' AND l.v IS NOT NULL)))
SELECT DISTINCT project, rel_path, n AS name, v AS version, 'Go' AS ecosystem FROM k WHERE f = 'go.mod' AND regexp_matches(v, '^v[0-9]')
UNION SELECT project, rel_path, n, regexp_replace(coalesce(max(v), ''), '^[\\s^~>=]+', ''), 'npm' FROM k WHERE f = 'package.json' GROUP BY 1, 2, 3
UNION SELECT project, rel_path, n, max(v), 'npm' FROM k WHERE f = 'package-lock.json' AND v <> '' GROUP BY 1, 2, 3
UNION SELECT project, rel_path, regexp_extract(n, {_PINNED}), coalesce(nullif(v, ''), 'unknown'), 'PyPI' FROM k WHERE f = 'requirements.txt'
UNION SELECT project, rel_path, n, regexp_replace(v, '^[\\s^~>=]+', ''), 'crates.io' FROM k WHERE f = 'Cargo.toml' AND v <> ''
UNION SELECT project, rel_path, n, v, 'crates.io' FROM k WHERE f = 'Cargo.lock' AND v <> ''
""".replace("\\\\s", "\\s")
OSV_RECORDS = f"""
WITH v AS ({P4_VULNERABILITIES}), a AS ({P4_AFFECTED}), r AS (SELECT raw_id, vuln_pos, affected_pos, count(*) AS n FROM ({P4_RANGES}) GROUP BY 1, 2, 3),
x AS (SELECT raw_id, vuln_pos, affected_pos, string_agg(DISTINCT version_text, ',' ORDER BY version_text) AS fixed FROM ({P4_FOUND}) WHERE bound = 'fixed' GROUP BY 1, 2, 3)
SELECT a.raw_id, a.vuln_pos, a.affected_pos, v.vuln_id AS id, a.package, a.ecosystem, coalesce(x.fixed, '') AS fixed_versions, coalesce(r.n, 0) AS n_ranges FROM a JOIN v USING (raw_id, vuln_pos) LEFT JOIN r USING (raw_id, vuln_pos, affected_pos) LEFT JOIN x USING (raw_id, vuln_pos, affected_pos) WHERE a.package <> ''
"""
_LEVEL = "CASE WHEN sev IN ('CRITICAL', 'HIGH') THEN 'error' WHEN sev = 'MEDIUM' THEN 'warning' ELSE 'note' END"
_RISK = "CASE upper(trim(cwe, ' ')) " + " ".join(f"WHEN {quoted(c)} THEN {quoted(r)}" for r, cs in reports.RISKS.items() for c in cs) + " ELSE '' END"
REP_RULES = f"""
WITH f AS (SELECT *, {_SEVERITY} AS sev, coalesce(rule_id, id) AS rule FROM findings), b AS (SELECT rule, arg_min(f, finding_key) AS x FROM f GROUP BY 1), g AS (SELECT rule, x.title AS name, x.sev AS sev, x.category AS category, coalesce(x.cwe, '') AS cwe FROM b)
SELECT rule, name, {_LEVEL} AS level, 'security,' || lower(category) || CASE WHEN cwe <> '' THEN ',' || cwe ELSE '' END || CASE WHEN {_RISK} <> '' THEN ',' || {_RISK} ELSE '' END AS tags, CASE WHEN cwe <> '' THEN 'https://cwe.mitre.org/data/definitions/' || regexp_replace(cwe, '^CWE-', '') || '.html' ELSE '' END AS help_uri FROM g
"""


def _esc(c: str) -> str:
    x = f"coalesce({c}::VARCHAR, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


REP_HTML = "SELECT finding_key, '<tr>' || " + " || ".join(f"'<td>' || {_esc(c)} || '</td>'" for c in ("severity", "rule_id", "title", "file", "line", "evidence")) + " || '</tr>' AS row FROM findings"
STR_DAYS = f"SELECT date_trunc('day', scanned_at AT TIME ZONE 'UTC') AT TIME ZONE 'UTC' AS window_start, sev AS severity, count(*) AS n FROM (SELECT scanned_at, {_SEVERITY} AS sev FROM findings WHERE scanned_at IS NOT NULL) GROUP BY 1, 2"
_FW = " UNION ALL ".join(
    f"SELECT project, rel_path, {quoted(n)} AS framework FROM source_files WHERE lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '[.]([^.]+)$', 1)) IN ({', '.join(quoted(e) for e in exts)}) AND {_any('content', texts)}" for n, (exts, texts) in code.FRAMEWORKS.items()
)


_CALL_ARG, _LITERAL = quoted(r"\(([^()]*)\)"), quoted(r"""^(?:"[^"{]*"|'[^'{]*'|[0-9]+)$""")
_BIT = "CASE kind " + " ".join(f"WHEN {quoted(k)} THEN {1 << i}" for i, k in enumerate(taint.KINDS)) + " ELSE 0 END"
TNT_TIERS = f"""
WITH x AS (SELECT f.*, k.kind, k.clears FROM findings f JOIN ({TNT_KINDS}) k USING (finding_key)),
t AS (SELECT finding_key, CASE WHEN coalesce(regexp_matches(regexp_extract(evidence, {_CALL_ARG}, 1), {_LITERAL}), false) OR (clears & ({_BIT})) > 0 THEN 'informational'
  WHEN source IS NOT NULL AND (kind IS NOT NULL OR sink IS NOT NULL) AND coalesce(len(data_flow), 0) >= 2 THEN 'confirmed' WHEN kind IS NOT NULL OR sink IS NOT NULL THEN 'potential' ELSE 'informational' END AS tier FROM x)
SELECT finding_key, tier, CASE tier WHEN 'confirmed' THEN 'HIGH' WHEN 'potential' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM t
"""
BEN_LABELS = f"SELECT project, count(*) AS n, " + ", ".join(f"(100 * sum((label = '{x}')::INT) // count(*))::INT AS {x.lower()}" for x in ("HIGH", "MEDIUM", "LOW")) + f" FROM (SELECT project, {_LABEL.format('score')} AS label FROM ({_SCORED})) GROUP BY 1"
RSK_LEVELS = f"SELECT project, score, CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 75 THEN 'HIGH' WHEN score < 90 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ({RSK_PROJECTS})"
_S_KEY = quoted(semantic.SECRET_KEY.replace("(?![=])", "(?:[^=]|$)"))
_S = {k: quoted(v) for k, v in {"cmp": semantic.COMPARISON, "val": semantic.QUOTED_VALUE, "ph": semantic.PLACEHOLDERS, "doc": semantic.DOCUMENT_FILE, "test": semantic.TEST_FILE, "file": semantic.SECRET_FILE}.items()}
_PATHS = lines("source_files", "file_key, rel_path", "content")
_REMARK = quoted(r"^\s*(?:#|//|/\*|\*|--)")
SEC_SCORES = f"""
WITH l AS (SELECT *, coalesce(rel_path, '') AS p, regexp_extract(line, {_S["val"]}, 1) AS v FROM {_PATHS} WHERE regexp_matches(line, {_S_KEY}) AND NOT regexp_matches(line, {_S["cmp"]})),
s AS (SELECT file_key, rel_path, line_no, greatest(0, least(100, 45 + CASE WHEN regexp_matches(p, {_S["file"]}) THEN 30 ELSE 0 END + CASE WHEN v <> '' THEN 15 ELSE 0 END
  + CASE WHEN lower(v) NOT IN ('', 'password', 'admin', 'secret', 'token') AND NOT regexp_matches(v, {_S["ph"]}) THEN 15 ELSE 0 END
  + CASE WHEN regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND (regexp_matches(v, '[^A-Za-z0-9]') OR length(v) >= 16) THEN 10 ELSE 0 END + CASE WHEN regexp_matches(p, {_S["doc"]}) THEN -30 ELSE 10 END
  + CASE WHEN regexp_matches(line, {_S["ph"]}) THEN -25 ELSE 0 END + CASE WHEN regexp_matches(line, {_REMARK}) THEN -20 ELSE 0 END + CASE WHEN regexp_matches(p, {_S["test"]}) THEN -40 ELSE 0 END)) AS score FROM l)
SELECT *, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM s WHERE score >= 20
"""
STR_SESSIONS = """
WITH r AS (SELECT project, received_at AS t, coalesce(received_at - lag(received_at) OVER w >= INTERVAL 6 HOUR, true) AS new FROM incoming_findings WHERE received_at IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY received_at)),
s AS (SELECT project, t, sum(new::INT) OVER (PARTITION BY project ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT project, min(t) AS session_start, max(t) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY project, k
"""


def statements() -> dict[str, str]:
    return {"grf_levels": GRF_LEVELS, "tnt_kinds": TNT_KINDS, "dep_manifests": DEP_MANIFESTS, "osv_records": OSV_RECORDS, "rep_rules": REP_RULES, "rep_html": REP_HTML, "str_days": STR_DAYS, "fwk_detected": _FW, "tnt_tiers": TNT_TIERS, "ben_labels": BEN_LABELS, "rsk_levels": RSK_LEVELS, "sec_scores": SEC_SCORES, "str_sessions": STR_SESSIONS}
