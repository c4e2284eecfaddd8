"""DuckDB statements that give the same rows as the queries of the core."""

from siftline.operators import findings, rules


def _items(of: str) -> str:
    """The elements of a JSON list with their positions; an object is the only element of itself."""
    return f"(SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM (SELECT CASE json_type({of}) WHEN 'ARRAY' THEN json_extract({of}, '$[*]') WHEN 'OBJECT' THEN [{of}] ELSE [] END AS l))"


def _of(x: str, key: str) -> str:
    """The value of a key in any case; null if x is no object."""
    return f"(CASE WHEN json_type({x}) = 'OBJECT' THEN json_extract({x}, '$.\"' || list_last(list_filter(json_keys({x}), lambda k: lower(k) = '{key}')) || '\"') END)"


P4_FOUND = f"""
WITH p AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM advisory_raw),
o AS (SELECT raw_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM p),
e AS (SELECT raw_id, CASE WHEN json_type({_of("j", "vulns")}) IN ('ARRAY', 'OBJECT') THEN {_of("j", "vulns")} ELSE j END AS j FROM o),
v AS (SELECT raw_id, t.pos AS vuln_pos, {_of("t.x", "affected")} AS j FROM e, LATERAL {_items("e.j")} t),
a AS (SELECT raw_id, vuln_pos, t.pos AS affected_pos, {_of("t.x", "ranges")} AS j FROM v, LATERAL {_items("v.j")} t),
r AS (SELECT raw_id, vuln_pos, affected_pos, t.pos AS range_pos, {_of("t.x", "events")} AS j FROM a, LATERAL {_items("a.j")} t),
ev AS (SELECT raw_id, vuln_pos, affected_pos, range_pos, t.pos AS event_pos, t.x AS x FROM r, LATERAL {_items("r.j")} t),
b AS (
  SELECT * EXCLUDE (x), 'introduced' AS bound, {_of("x", "introduced")} AS y FROM ev
  UNION ALL SELECT * EXCLUDE (x), 'fixed', {_of("x", "fixed")} FROM ev
  UNION ALL SELECT * EXCLUDE (x), 'last_affected', {_of("x", "last_affected")} FROM ev)
SELECT raw_id, vuln_pos::INT AS vuln_pos, affected_pos::INT AS affected_pos, range_pos::INT AS range_pos, event_pos::INT AS event_pos, bound, y ->> '$' AS version_text
FROM b WHERE y ->> '$' <> '' AND json_type(y) NOT IN ('OBJECT', 'ARRAY', 'NULL')
"""


def _text(x: str) -> str:
    """The text of a JSON scalar; null for anything else."""
    return f"(CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {x} ->> '$' END)"


_DOCUMENTS = P4_FOUND[: P4_FOUND.index("v AS (SELECT")] + f"""
v AS (SELECT raw_id, t.pos::INT AS vuln_pos, t.x AS x, CASE WHEN e.wrapped THEN 'vulns' WHEN json_type(e.j) = 'OBJECT' THEN 'one' ELSE 'list' END AS envelope FROM
  (SELECT o.raw_id, CASE WHEN json_type({_of("j", "vulns")}) IN ('ARRAY', 'OBJECT') THEN {_of("j", "vulns")} ELSE j END AS j, coalesce(json_type({_of("j", "vulns")}) IN ('ARRAY', 'OBJECT'), false) AS wrapped FROM o) e, LATERAL {_items("e.j")} t)"""
_AFFECTED = _DOCUMENTS + f""", a AS (SELECT raw_id, vuln_pos, t.pos::INT AS affected_pos, t.x AS x FROM (SELECT raw_id, vuln_pos, {_of("x", "affected")} AS j FROM v) w, LATERAL {_items("w.j")} t)"""
_RANGES = _AFFECTED + f""", r AS (SELECT raw_id, vuln_pos, affected_pos, t.pos::INT AS range_pos, t.x AS x FROM (SELECT raw_id, vuln_pos, affected_pos, {_of("x", "ranges")} AS j FROM a) w, LATERAL {_items("w.j")} t)"""
P4_VULNERABILITIES = _DOCUMENTS + f" SELECT raw_id, vuln_pos, envelope, {_text(_of('x', 'id'))} AS vuln_id, {_text(_of('x', 'summary'))} AS summary FROM v"
P4_AFFECTED = _AFFECTED + f" SELECT raw_id, vuln_pos, affected_pos, {_text(_of('p', 'name'))} AS package, {_text(_of('p', 'ecosystem'))} AS ecosystem FROM (SELECT *, {_of('x', 'package')} AS p FROM a)"
P4_RANGES = _RANGES + f" SELECT raw_id, vuln_pos, affected_pos, range_pos, {_text(_of('x', 'type'))} AS range_type FROM r"


def _state(level: str, *parts: str) -> str:
    """The state of the thing x from those of its parts."""
    named = f"'{level}(' || concat_ws(',', {', '.join(parts)}) || ')'"
    return f"CASE WHEN json_type(x) = 'OBJECT' THEN {named} WHEN x IS NULL OR json_type(x) = 'NULL' THEN 'null' ELSE 'alien' END"


def _list(key: str) -> str:
    """The state of the list under a key, from `inner`, the distinct states of its elements in order."""
    of = f"json_type({_of('x', key)})"
    return f"'{key}=' || CASE {of} WHEN 'OBJECT' THEN inner_ WHEN 'ARRAY' THEN '[' || coalesce(inner_, '') || ']' ELSE 'null' END"


def _given(key: str, word: str) -> str:
    return f"CASE WHEN {word} THEN '{key}' END"


def _with_inner(rows: str, parts: str, keys: str) -> str:
    return f"(SELECT * FROM {rows} LEFT JOIN (SELECT {keys}, string_agg(DISTINCT state, ',' ORDER BY state) AS inner_ FROM {parts} GROUP BY ALL) USING ({keys}))"


_BOUND = [_given(b, f"{_text(_of('x', b))} <> ''") for b in ("introduced", "fixed", "last_affected")]
_K = ["raw_id, vuln_pos", "raw_id, vuln_pos, affected_pos", "raw_id, vuln_pos, affected_pos, range_pos"]
P4_SHAPES = _RANGES + f""", es AS (SELECT {_K[2]}, {_state("event", *_BOUND)} AS state FROM (SELECT {_K[2]}, t.x AS x FROM (SELECT {_K[2]}, {_of("x", "events")} AS j FROM r) w, LATERAL {_items("w.j")} t)),
rs AS (SELECT {_K[1]}, {_state("range", _given("type", f"{_text(_of('x', 'type'))} IS NOT NULL"), _list("events"))} AS state FROM {_with_inner("r", "es", _K[2])}),
afs AS (SELECT {_K[0]}, {_state("affected", _given("package", f"json_type({_of('x', 'package')}) = 'OBJECT'"), _list("ranges"))} AS state FROM {_with_inner("a", "rs", _K[1])}),
vs AS (SELECT {_state("vuln", _given("id", f"{_text(_of('x', 'id'))} IS NOT NULL"), _list("affected"))} AS state FROM {_with_inner("v", "afs", _K[0])})
SELECT level, state, count(*) AS n FROM (SELECT 'vulnerabilities' AS level, state FROM vs UNION ALL SELECT 'affected', state FROM afs UNION ALL SELECT 'ranges', state FROM rs UNION ALL SELECT 'events', state FROM es) GROUP BY ALL
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values: object) -> str:
    return "(" + ", ".join(quoted(str(v)) for v in values) + ")"


_BASE = "regexp_extract({0}, '[^/]*$')"


def lines(of: str, keys: str, text: str) -> str:
    """Rows of (keys, line_no, line)."""
    return f"""(SELECT {keys}, p + 1 AS line_no, regexp_replace(raw, '\r$', '') AS line FROM (
  SELECT {keys}, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS raw, len(l) AS n FROM (SELECT {keys}, string_split({text}, chr(10)) AS l FROM {of} WHERE {text} IS NOT NULL)) WHERE p + 1 < n OR raw <> '')"""


_dirs = "|".join(d.replace(".", "[.]") for d in rules.SKIPPED_DIRS)
_EXT = "lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '[.]([^.]+)$', 1))"
SRC_FILES = f"""
SELECT file_key, CASE
  WHEN rel_path IS NULL OR content IS NULL THEN 'binary'
  WHEN ends_with(rel_path, '.xml') OR rel_path = 'services/schema-10014' OR starts_with(rel_path, 'services/schema-10014/') OR {_BASE.format("rel_path")} = 'services/schema-10014' THEN 'excluded'
  WHEN regexp_matches(rel_path, '(?:^|/)(?:{_dirs})/') THEN 'folder'
  WHEN regexp_matches(lower(rel_path), {quoted(rules.TEST_FILES)}) THEN 'test'
  WHEN {_EXT} IN {_in(rules.SKIPPED_EXTENSIONS)} OR ({_EXT} NOT IN {_in(rules.TEXT_EXTENSIONS)} AND contains(substring(content, 1, 1024), chr(0))) THEN 'binary'
  WHEN strlen(content) > {8 * 1024 * 1024} THEN 'size' ELSE 'scanned' END AS verdict FROM source_files
"""
SRC_LINES = f"SELECT file_key, count(*) AS n_lines, max(length(line)) AS longest FROM {lines('source_files', 'file_key', 'content')} GROUP BY 1"


def rule_hits(source: str, keys: str, which: tuple, columns: str) -> str:
    """One branch for each rule."""
    parts = []
    for r in which:
        unharmed = "".join(f" AND NOT contains(lower(line), {quoted(h)})" for h in rules.HARMLESS.get(r.rule_id, ()))
        severity = quoted(r.severity)
        if r.rule_id == "VG-SAST-009":
            arg = "trim(regexp_extract(line, '\\((.*)\\)', 1), ' ')".replace("\\", "\\"[:1])
            reached = " OR ".join(f"contains(line, {quoted(w)})" for w in rules.ATTACKER_WORDS)
            literal = quoted("""^(?:b?"[^"]*"|b?'[^']*'|-?[0-9]+)$""")
            severity = f"CASE WHEN regexp_matches({arg}, {literal}) THEN 'LOW' WHEN {reached} THEN 'CRITICAL' ELSE 'HIGH' END"
        clean = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')".replace("\\", "\\"[:1])
        evidence = f"CASE WHEN length({clean}) > 8 THEN left({clean}, 8) || '****' ELSE '****' END" if r.category == "secret" else clean
        parts.append(f"SELECT {keys}, line_no, {quoted(r.rule_id)} AS rule_id, {severity} AS severity, {evidence} AS evidence FROM {'code' if r in rules.CODE_RULES else 'l'} WHERE regexp_matches(line, {quoted(r.pattern)}){unharmed}")
    body = " UNION ALL ".join(parts)
    return f"WITH l AS (SELECT * FROM {source}), code AS (SELECT * FROM l WHERE NOT regexp_matches(line, {quoted(rules.COMMENT)}) AND NOT regexp_matches(line, {quoted(rules.METADATA)})), hits AS ({body}) SELECT {columns} FROM hits"


_FILE_LINES, _DOC_LINES, _EVIDENCE_LINES = lines("source_files", "file_key", "content"), lines("documents", "doc_id", "text"), lines("findings", "finding_key", "evidence")
LEX_CODE = rule_hits(_FILE_LINES, "file_key", rules.CODE_RULES, "file_key, line_no, rule_id, severity")
LEX_SECRET = rule_hits(_FILE_LINES, "file_key", rules.SECRET_RULES, "file_key, line_no, rule_id, evidence")
LEX_DOCUMENTS = rule_hits(_DOC_LINES, "doc_id", rules.RULES, "rule_id, severity, count(*) AS n, count(DISTINCT doc_id) AS docs") + " GROUP BY rule_id, severity"
LEX_EVIDENCE = rule_hits(_EVIDENCE_LINES, "finding_key", rules.RULES, "finding_key, line_no, rule_id, severity")
LEX_WEBHOOKS = f"""
WITH l AS (SELECT *, min(CASE WHEN regexp_matches(line, {quoted(rules.WEBHOOK_BODY)}) THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND {rules.WEBHOOK_REACH - 1} FOLLOWING) AS reads,
  bool_or(regexp_matches(line, {quoted(rules.WEBHOOK_SIGNED)})) OVER (PARTITION BY doc_id) AS signed FROM {_DOC_LINES})
SELECT doc_id, line_no AS route_line, reads AS line_no FROM l WHERE regexp_matches(line, {quoted(rules.WEBHOOK_ROUTE)}) AND reads IS NOT NULL AND NOT signed
"""
FLT_MASKED = "SELECT finding_key, CASE WHEN length(evidence) > 8 THEN left(evidence, 8) || '****' WHEN evidence IS NOT NULL THEN '****' END AS masked FROM findings"


def _has(c: str, texts: tuple) -> str:
    return " OR ".join([f"contains({c}, {quoted(t)})" for t in texts] or ["false"])


def class_of(rows: tuple, value: str, rule: str, title: str, category: str) -> str:
    out = "CASE"
    for r in rows[:-1]:
        tests = [_has(rule, r.rule_has), _has(title, r.title_has)] + ([f"{rule} IN {_in(r.rule_is)}"] if r.rule_is else []) + ([f"{category} IN {_in(r.category)}"] if r.category else [])
        out += f" WHEN {' OR '.join(tests)} THEN {quoted(getattr(r, value))}"
    return out + f" ELSE {quoted(getattr(rows[-1], value))} END"


_R, _T, _C = "upper(coalesce(rule_id, id, ''))", "lower(coalesce(title, ''))", "lower(coalesce(category, ''))"
_CANON, _CANON_CWE = class_of(findings.CANONICAL, "name", _R, _T, _C), class_of(findings.CANONICAL, "cwe", _R, _T, _C)
_FP = """concat_ws(':', CASE WHEN starts_with(coalesce(rule_id, id, ''), 'VG-0') THEN lower(trim(title, ' ')) ELSE coalesce(rule_id, id, '') END, replace(coalesce(file, ''), chr(92), '/'), coalesce(line, 0)::VARCHAR, coalesce(col_no, 1)::VARCHAR,
  trim(coalesce(source, ''), ' '), trim(coalesce(sink, ''), ' '), left(trim(coalesce(evidence, ''), ' '), 60))"""
_TAGGED = f"SELECT * EXCLUDE (cwe), {_CANON} AS canon, coalesce(cwe, {_CANON_CWE}) AS cwe, {_FP} AS fp FROM findings"
_SEVERITY = f"CASE WHEN upper(regexp_replace(severity, '^\\s+|\\s+$', '', 'g')) IN {_in(findings.SEVERITY_RANK)} THEN upper(regexp_replace(severity, '^\\s+|\\s+$', '', 'g')) ELSE 'MEDIUM' END".replace("\\", "\\"[:1])
_RANK = "CASE " + " ".join(f"WHEN sev = {quoted(k)} THEN {v}" for k, v in findings.SEVERITY_RANK.items()) + " END"
FND_CANONICAL = f"SELECT finding_key, canon, cwe, fp FROM ({_TAGGED})"
DDP_EXACT = f"SELECT project, fp, min(finding_key) AS first_key, count(*) AS n FROM ({_TAGGED}) GROUP BY 1, 2"


def _specificity() -> str:
    r, t, e = "lower(coalesce(rule_id, id, ''))", "lower(coalesce(title, ''))", "lower(coalesce(evidence, ''))"
    return "CASE " + " ".join(f"WHEN {_has(r, a)} OR {_has(t, b)} OR {_has(e, c)} THEN {n}" for n, a, b, c in findings.SPECIFICITY) + " ELSE 1 END"


def _renamed() -> str:
    return "CASE WHEN n > 1 THEN CASE " + " ".join(f"WHEN {_has('ds', a)} OR {_has('lower(coalesce(title, chr(0)))', b)} OR {_has('lower(es)', c)} THEN {i}" for i, (_, _, a, b, c) in enumerate(findings.RETITLED)) + " END END"


_ORD = f"({_RANK}, {_specificity()}, coalesce(len(data_flow), 0), -finding_key)"
_pick = lambda i: "CASE renamed " + " ".join(f"WHEN {k} THEN {quoted(r[i])}" for k, r in enumerate(findings.RETITLED)) + " END"
DDP_MERGED = f"""
WITH t AS (SELECT *, {_SEVERITY} AS sev FROM ({_TAGGED}) WHERE finding_key IN (SELECT min(finding_key) FROM ({_TAGGED}) GROUP BY project, fp)),
u AS (SELECT *, lower(replace(coalesce(file, ''), chr(92), '/')) AS file_lc, CASE WHEN regexp_matches(canon, '^VG-CANON-(CRED|FILE)') THEN 'CREDENTIAL' ELSE canon END AS family, CASE WHEN line > 0 THEN NULL ELSE finding_key END AS alone,
  {_ORD} AS ord, coalesce(detector_ids, [coalesce(rule_id, id)]) AS ds0, coalesce(evidences, CASE WHEN evidence IS NOT NULL THEN [evidence] ELSE [] END) AS es0, coalesce(starts_with(confidence, 'HIGH'), false) AS is_high FROM t),
g AS (SELECT project, file_lc, line, family, alone, count(*) AS n, arg_max(u, ord) AS b, arg_max(confidence, ord) FILTER (WHERE is_high) AS high,
  arg_max({{'source': source, 'sink': sink}}, ord) FILTER (WHERE data_flow IS NOT NULL) AS flowing, list_sort(list_distinct(flatten(list(ds0)))) AS dl, list_sort(list_distinct(flatten(list(es0)))) AS el, list({{'k': finding_key, 'id': id}}) AS members FROM u GROUP BY 1, 2, 3, 4, 5),
h AS (SELECT g.*, b.title AS title, array_to_string(dl, chr(0)) AS ds, array_to_string(el, ' ') AS es FROM g),
k AS (SELECT *, {_renamed()} AS renamed, b.data_flow IS NOT NULL OR flowing IS NULL AS own FROM h)
SELECT project, b.finding_key AS base_key, file_lc, line, n, coalesce({_pick(0)}, b.title) AS title, coalesce({_pick(1)}, b.canon) AS canonical_rule, CASE WHEN renamed IS NOT NULL THEN 'secret' ELSE b.category END AS category,
  CASE WHEN renamed IS NOT NULL THEN 'CRITICAL' ELSE b.sev END AS severity, CASE WHEN renamed IS NOT NULL THEN 'CWE-798' ELSE b.cwe END AS cwe,
  CASE WHEN n > 1 AND NOT coalesce(starts_with(b.confidence, 'HIGH'), false) THEN coalesce(high, b.confidence) ELSE b.confidence END AS confidence,
  CASE WHEN own THEN b.source ELSE flowing.source END AS source, CASE WHEN own THEN b.sink ELSE flowing.sink END AS sink,
  CASE WHEN n > 1 AND NOT contains(coalesce(b.evidence, ''), '=') THEN coalesce(list_filter(el, lambda x: contains(x, '='))[1], b.evidence) ELSE b.evidence END AS evidence,
  array_to_string(dl, '|') AS detector_ids, array_to_string(el, '|') AS evidences, array_to_string(list_sort(list_distinct(list_transform(list_filter(members, lambda m: m.k <> b.finding_key), lambda m: m.id))), '|') AS related_findings FROM k
"""
_WIDE = f"coalesce(nullif({class_of(findings.WIDE_FAMILIES, 'name', _R, _T, _C)}, ''), canonical_rule, canon)"
DDP_WIDE = f"""
WITH t AS (SELECT *, {_SEVERITY} AS sev FROM ({_TAGGED}) WHERE finding_key IN (SELECT min(finding_key) FROM ({_TAGGED}) GROUP BY project, fp)),
u AS (SELECT *, lower(replace(coalesce(file, ''), chr(92), '/')) AS file_lc, {_WIDE} AS family, CASE WHEN line > 0 THEN NULL ELSE finding_key END AS alone, {_ORD} AS ord, coalesce(detector_ids, [coalesce(rule_id, id)]) AS ds0, coalesce(evidences, CASE WHEN evidence IS NOT NULL THEN [evidence] ELSE [] END) AS es0 FROM t),
g AS (SELECT project, file_lc, line, family, alone, count(*) AS n, arg_max(u, ord) AS b, list_sort(list_distinct(flatten(list(ds0)))) AS dl, list_sort(list_distinct(flatten(list(es0)))) AS el FROM u GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, {_renamed()} AS renamed FROM (SELECT *, b.title AS title, array_to_string(dl, chr(0)) AS ds, array_to_string(el, ' ') AS es FROM g))
SELECT project, b.finding_key AS base_key, file_lc, line, n, CASE WHEN renamed IS NOT NULL THEN 'CRITICAL' ELSE b.sev END AS severity, array_to_string(dl, '|') AS detector_ids FROM k
"""
_DOCS, _IDLE = quoted(r"[.](?:md|markdown|rst|txt|html?|adoc)$"), quoted(r'''"admin"|"password"|""|"[.][.][.]"|read-host|param[(]''')
_KEYED, _PASSWORD = quoted(r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['"][^'"]{8,}"""), quoted(r'''(?i)password\s*=\s*"[^"]+"''')
_ADDED = lines("source_files", "file_key, rel_path", "content")
_SHOWN = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
DIF_SECRETS = f"""
SELECT file_key, line_no + 2 AS line_no, rel_path AS file, title, CASE WHEN length({_SHOWN}) > 8 THEN left({_SHOWN}, 8) || '****' ELSE {_SHOWN} END AS evidence FROM (SELECT *, CASE
  WHEN regexp_matches(line, 'AKIA[0-9A-Z]{{16}}') THEN 'AWS Access Key in Pushed Commit' WHEN regexp_matches(line, {_KEYED}) THEN 'Generic API Key in Pushed Commit'
  WHEN regexp_matches(line, '-----BEGIN (RSA|DSA|EC|OPENSSH)? PRIVATE KEY-----') THEN 'Private Key in Pushed Commit'
  WHEN regexp_matches(line, {_PASSWORD}) AND NOT regexp_matches(lower(rel_path), {_DOCS}) AND NOT regexp_matches(lower(line), {_IDLE}) THEN 'Password Assignment in Pushed Commit' END AS title FROM {_ADDED} WHERE NOT starts_with(line, '++ ')) WHERE title IS NOT NULL
"""
GIT_TRACKED = "SELECT file_key, name FROM source_files WHERE regexp_matches(name, '^(id_rsa|id_dsa|[.]htpasswd|credentials[.].*|.*[.]pem)$')"
_HEAD = "split_part({0}, ':', 1)"
_SCORE = f"""greatest(5, least(100, CASE confidence WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 45 ELSE 15 END + CASE WHEN coalesce(len(data_flow), 0) >= 2 THEN 15 ELSE 0 END
  + CASE WHEN source IS NOT NULL AND sink IS NOT NULL THEN CASE WHEN {_HEAD.format("source")} <> {_HEAD.format("sink")} THEN 10 ELSE 5 END ELSE 0 END + CASE sev WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 2 ELSE 0 END
  + CASE WHEN evidence IS NULL THEN -15 WHEN length(trim(evidence, ' ')) < 20 THEN -10 ELSE 0 END + CASE WHEN source IS NULL AND sink IS NULL THEN -10 ELSE 0 END))"""
_LABEL = "CASE WHEN {0} >= 70 THEN 'HIGH' WHEN {0} >= 35 THEN 'MEDIUM' ELSE 'LOW' END"
_SCORED = f"SELECT *, {_SCORE} AS score FROM (SELECT *, {_SEVERITY} AS sev FROM findings)"
CNF_SCORES = f"SELECT finding_key, score, {_LABEL.format('score')} AS label FROM ({_SCORED})"
_CR = "coalesce(rule_id, id, '')"
COR_CHAINS = f"""
WITH f AS (SELECT project, {class_of(findings.CHAIN_CLASSES, "name", _CR, _T, "''")} AS vuln_class, {class_of(findings.CHAIN_CLASSES, "cwe", _CR, _T, "''")} AS cwe, regexp_extract(file, '[^/]*$') AS name, file AS path, finding_key, {_RANK} AS rank, score,
  source IS NOT NULL AND sink IS NOT NULL AS traced, data_flow IS NOT NULL AS flows FROM ({_SCORED})),
w AS (SELECT *, traced AND sum(traced::INT) OVER (PARTITION BY project, vuln_class) > 1 AS first_kind FROM f),
g AS (SELECT project, vuln_class, cwe, first_kind, CASE WHEN NOT first_kind THEN name END AS file, count(*) AS n, min(finding_key) AS first_key, max(rank) AS rank, (sum(score) // count(*))::INT AS mean, min(path) <> max(path) AS many, bool_or(flows) AS cross_function FROM w GROUP BY ALL)
SELECT project, vuln_class, file, cwe, n, first_key, CASE rank {" ".join(f"WHEN {v} THEN {quoted(k)}" for k, v in findings.SEVERITY_RANK.items())} END AS severity, score, {_LABEL.format("score")} AS label, cross_file, cross_function
FROM (SELECT *, first_kind AND many AS cross_file, least(100, mean + CASE WHEN first_kind AND many THEN 10 ELSE 0 END) AS score FROM g)
"""
_TRACED = COR_CHAINS.replace("SELECT project, vuln_class, file, cwe,", "SELECT project, vuln_class, file, first_kind, cwe,")
COR_RANKED = f"""
SELECT project, 'CHAIN-' || lpad(CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, vuln_class, coalesce(file, ''), file IS NOT NULL, first_key) AS VARCHAR), 6, '0') AS chain_id, vuln_class, file, score,
  n || CASE WHEN first_kind THEN ' related findings with confirmed taint provenance' || CASE WHEN cross_file THEN ' in several files.' ELSE ' in one file.' END ELSE ' related finding(s) for ' || vuln_class || ' in the same file scope.' END AS rationale
FROM ({_TRACED})
"""
COR_MEMBERS = f"""
WITH f AS (SELECT project, {class_of(findings.CHAIN_CLASSES, "name", _CR, _T, "''")} AS vuln_class, regexp_extract(file, '[^/]*$') AS name, finding_key, source IS NOT NULL AND sink IS NOT NULL AS traced FROM findings)
SELECT project, vuln_class, CASE WHEN NOT (traced AND sum(traced::INT) OVER (PARTITION BY project, vuln_class) > 1) THEN name END AS file, finding_key FROM f
"""
FLT_IGNORED = """
SELECT file_key FROM source_files f WHERE EXISTS (SELECT 1 FROM suppressions s WHERE s.project = f.project AND
  (s.file = f.rel_path OR starts_with(f.rel_path, s.file || '/') OR s.file = regexp_extract(f.rel_path, '[^/]*$') OR s.file = '*' || regexp_extract(regexp_extract(f.rel_path, '[^/]*$'), '[.][^.]+$')))
"""
COR_SCOPE = f"""
WITH f AS (SELECT project, coalesce({_HEAD.format("source")} <> {_HEAD.format("sink")} AND {_HEAD.format("source")} <> '' AND {_HEAD.format("sink")} <> '', false) AS cf, coalesce(len(data_flow), 0) >= 3 AS cx,
  contains(coalesce(rule_id, ''), 'FW-') OR contains({_T}, 'framework') OR regexp_matches(lower(coalesce(description, '')), 'flask|django|fastapi|express|spring') AS fw,
  regexp_matches({_C}, 'configuration|docker') OR regexp_matches(coalesce(file, ''), '[.]env|[.](yml|yaml|toml|ini)$') AS cfg FROM findings)
SELECT project, sum((NOT cf AND NOT cx)::INT)::BIGINT AS intra_function, sum(cx::INT)::BIGINT AS cross_function, sum(cf::INT)::BIGINT AS cross_file, sum(fw::INT)::BIGINT AS framework_aware, sum(cfg::INT)::BIGINT AS config_aware FROM f GROUP BY 1
"""
_PATH = "regexp_replace(regexp_replace(replace({0}, chr(92), '/'), '/+', '/', 'g'), '^([.]/)+', '')"
FLT_CHANGED = f"""
SELECT finding_key FROM findings f WHERE EXISTS (SELECT 1 FROM source_files s WHERE s.project = f.project AND s.rel_path = {_PATH.format("coalesce(f.file, '')")})
"""
SUP_ACTIVE = f"""
SELECT finding_key, project FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.project = f.project
  AND (coalesce(s.rule_id, '') = '' OR s.rule_id = f.id OR s.rule_id = f.title) AND (coalesce(s.file, '') = '' OR ends_with({_PATH.format("coalesce(f.file, '')")}, {_PATH.format("s.file")}))
  AND (coalesce(s.line, 0) <= 0 OR coalesce(f.line, 0) <= 0 OR s.line = f.line) AND (try_cast(s.expires AS DATE) IS NULL OR TIMESTAMP '2026-10-01' <= try_cast(s.expires AS DATE)))
"""
_COUNTS = ", ".join(f"sum((sev = {quoted(s)})::INT)::BIGINT AS {s.lower()}" for s in findings.PENALTY)
_LOST = " - ".join(f"{s.lower()} * {p}" for s, p in findings.PENALTY.items())
RSK_PROJECTS = f"""
WITH c AS (SELECT project, {_COUNTS} FROM (SELECT project, {_SEVERITY} AS sev FROM findings) GROUP BY 1),
r AS (SELECT *, concat_ws(' and ', CASE WHEN critical > 0 THEN critical || ' CRITICAL' END, CASE WHEN high > 0 THEN high || ' HIGH' END) AS w FROM c)
SELECT * EXCLUDE (w), greatest(0, 100 - {_LOST})::INT AS score, CASE WHEN w <> '' THEN 'BLOCKED' ELSE 'PASSED' END AS gate, CASE WHEN w <> '' THEN w || ' detected' ELSE '' END AS reasons FROM r
"""
CAT_ROLLUP = f"SELECT category, severity, count(*) AS n FROM (SELECT lower(category) AS category, {_SEVERITY} AS severity FROM findings) GROUP BY ROLLUP (category, severity)"

_CLEAN = "trim({0}, ' ')"
for _p in ("v", "V", "==", "=", "\\^", "~"):
    _CLEAN = f"regexp_replace({_CLEAN}, '^{_p}', '')"
_CLEAN = f"trim({_CLEAN}, ' ')"
_PARTS = "list_filter(regexp_split_to_array(split_part({0}, '+', 1), '[-._]'), lambda p: trim(p, ' ') <> '')"
_NUM = "CASE WHEN regexp_matches({0}, '^[+-]?[0-9]{{1,19}}$') THEN try_cast({0} AS BIGINT) END"
def _compare(a: str, b: str) -> str:
    """-1, 0 or 1 of two version texts."""
    pa, pb = _PARTS.format(_CLEAN.format(a)), _PARTS.format(_CLEAN.format(b))
    x, y = "coalesce(z[1], '')", "coalesce(z[2], '')"
    m, n = _NUM.format(x), _NUM.format(y)
    one = f"CASE WHEN {m} IS NOT NULL AND {n} IS NOT NULL THEN sign(({m}) - ({n})) WHEN {x} < {y} THEN -1 WHEN {x} > {y} THEN 1 ELSE 0 END"
    return f"coalesce(list_filter(list_transform(list_zip({pa}, {pb}), lambda z: {one}), lambda d: d <> 0)[1], 0)"


_ECO, _PKG = "lower(trim({0}ecosystem, ' '))", "lower(trim({0}name, ' '))"
SCA_DISTINCT = f"""
SELECT eco, pkg, version, x.name AS name, x.ecosystem AS ecosystem, x.source_file AS source_file FROM (
  SELECT {_ECO.format("")} AS eco, {_PKG.format("")} AS pkg, CASE WHEN {_CLEAN.format("version")} <> '' THEN trim(version, ' ') ELSE 'unknown' END AS version, min({{'source_file': source_file, 'name': name, 'ecosystem': ecosystem}}) AS x
  FROM deps WHERE name IS NOT NULL AND ecosystem IS NOT NULL GROUP BY 1, 2, 3)
"""
_ADVISORIES = "SELECT *, lower(trim(ecosystem, ' ')) AS eco, lower(trim(package, ' ')) AS pkg FROM advisories WHERE package IS NOT NULL AND ecosystem IS NOT NULL"
# the events of a range walked in order: an interval is closed by the event itself, its start is the last introduced since the previous close
_PAIRS = f"""
WITH d AS (SELECT eco, pkg, version FROM ({SCA_DISTINCT})), a AS ({_ADVISORIES}),
c AS (SELECT d.eco, d.pkg, d.version, a.adv_key, a.id, a.severity, a.ranges, a.affected_versions, a.fixed_versions FROM d JOIN a USING (eco, pkg)
  UNION ALL SELECT d.eco, d.pkg, d.version, a.adv_key, a.id, a.severity, a.ranges, a.affected_versions, a.fixed_versions FROM d JOIN a USING (pkg) WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.eco = d.eco AND b.pkg = d.pkg)),
e0 AS (SELECT eco, pkg, version, adv_key, r_no, generate_subscripts(r.events, 1) AS e_no, unnest(r.events) AS e FROM (SELECT eco, pkg, version, adv_key, generate_subscripts(ranges, 1) AS r_no, unnest(ranges) AS r FROM c WHERE {_CLEAN.format("version")} NOT IN ('', 'unknown')) WHERE coalesce(r.range_type, '') <> 'GIT'),
e AS (SELECT *, nullif(e.introduced, '') AS intro, nullif(e.fixed, '') AS fix, nullif(e.last_affected, '') AS last FROM e0),
k AS (SELECT *, sum((fix IS NOT NULL OR last IS NOT NULL)::INT) OVER (PARTITION BY eco, pkg, version, adv_key, r_no ORDER BY e_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM e),
s AS (SELECT *, last_value(intro IGNORE NULLS) OVER (PARTITION BY eco, pkg, version, adv_key, r_no, coalesce(closed, 0) ORDER BY e_no) AS low, max(e_no) OVER (PARTITION BY eco, pkg, version, adv_key, r_no) AS top FROM k),
ranged AS (SELECT DISTINCT eco, pkg, version, adv_key FROM s WHERE (low IS NULL OR low = '0' OR {_compare("version", "low")} >= 0) AND
  CASE WHEN fix IS NOT NULL THEN {_compare("version", "fix")} < 0 WHEN last IS NOT NULL THEN {_compare("version", "last")} <= 0 ELSE e_no = top AND low IS NOT NULL END),
bounds AS (SELECT eco, pkg, version, adv_key, unnest(affected_versions) AS b FROM c WHERE {_CLEAN.format("version")} NOT IN ('', 'unknown')),
cut AS (SELECT eco, pkg, version, adv_key, b, unnest(string_split(b, ',')) AS x FROM bounds),
op AS (SELECT *, regexp_extract(x, '^\\s*(<=|<|>=|>|==|=|!=)?', 1) AS o, regexp_replace(x, '^\\s*(<=|<|>=|>|==|=|!=)?', '') AS t FROM cut),
held AS (SELECT eco, pkg, version, adv_key, b, bool_and(CASE WHEN trim(x, ' ') IN ('', '*') THEN true WHEN o = '<=' THEN q <= 0 WHEN o = '<' THEN q < 0 WHEN o = '>=' THEN q >= 0 WHEN o = '>' THEN q > 0 WHEN o = '!=' THEN q <> 0 ELSE q = 0 END) AS ok
  FROM (SELECT *, {_compare("version", "t")} AS q FROM op) GROUP BY 1, 2, 3, 4, 5),
below AS (SELECT eco, pkg, version, adv_key FROM (SELECT eco, pkg, version, adv_key, unnest(fixed_versions) AS f FROM c WHERE {_CLEAN.format("version")} NOT IN ('', 'unknown')) WHERE f <> '' AND {_compare("version", "f")} < 0),
hit AS (SELECT eco, pkg, version, adv_key FROM ranged UNION SELECT eco, pkg, version, adv_key FROM held WHERE ok UNION SELECT eco, pkg, version, adv_key FROM below UNION SELECT eco, pkg, version, adv_key FROM c WHERE lower({_CLEAN.format("version")}) = 'unknown'),
m AS (SELECT c.* FROM c JOIN hit USING (eco, pkg, version, adv_key))
""".replace("\\\\", "\\")
SCA_MATCHES = _PAIRS + "SELECT eco, pkg, version, adv_key FROM m"
SCA_TOP = (
    _PAIRS
    + f""", o AS (SELECT eco, pkg, adv_key, min(id) AS id, min(severity) AS severity FROM m GROUP BY 1, 2, 3), p AS (SELECT *, {_SEVERITY} AS sev FROM o),
q AS (SELECT eco, pkg, row_number() OVER (PARTITION BY eco, pkg ORDER BY {_RANK} DESC, id NULLS FIRST, adv_key) AS place, id, severity, count(*) OVER (PARTITION BY eco, pkg) AS n FROM p) SELECT * FROM q WHERE place <= 2"""
)
SCA_FINDINGS = (
    _PAIRS
    + """, f AS (SELECT m.adv_key, coalesce(m.id, '') AS rule_id, m.pkg, m.version, coalesce(a.description, a.summary, '') AS text, list_filter(a.fixed_versions, lambda x: x <> '') AS fx, a.aliases FROM m JOIN advisories a USING (adv_key))
SELECT adv_key, rule_id, 'dependency' AS category, 'Vulnerable dependency ' || pkg || ' ' || version AS title, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS description, 0 AS line,
  pkg || '@' || version || CASE WHEN coalesce(len(aliases), 0) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END AS evidence, CASE WHEN len(fx) > 0 THEN 'Upgrade to >= ' || fx[-1] ELSE 'Update package' END AS recommendation FROM f"""
)
_w = lambda w: f"regexp_matches(t, '(^|[^a-z0-9_])({w})([^a-z0-9_]|$)')"
_v = lambda *xs: " AND ".join(f"contains(v, '{x}')" for x in xs)
SCA_SEVERITY = f"""
WITH a AS (SELECT adv_key, severity, cvss_score AS s, upper(trim(cvss, ' ')) AS v, lower(concat_ws(' ', coalesce(summary, ''), coalesce(description, ''))) AS t, upper(trim(severity, ' ')) AS g FROM advisories)
SELECT adv_key, severity, CASE WHEN g IN ('CRITICAL', 'HIGH', 'LOW') THEN g WHEN g IN ('MODERATE', 'MEDIUM') THEN 'MEDIUM' WHEN s IS NOT NULL THEN CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN starts_with(v, 'CVSS:') THEN CASE WHEN {_v("AV:N", "AC:L", "PR:N", "UI:N", "C:H", "I:H", "A:H")} THEN 'CRITICAL' WHEN {_v("C:H")} OR {_v("I:H")} OR {_v("A:H")} THEN 'HIGH' WHEN {_v("C:L")} OR {_v("I:L")} OR {_v("A:L")} THEN 'MEDIUM' ELSE 'LOW' END
  WHEN {_w("rce|remote code execution")} THEN 'CRITICAL' WHEN {_w("injection|pollution|bypass|escalation")} THEN 'HIGH' WHEN {_w("xss|redirect|traversal|csrf|dos|ssrf")} THEN 'MEDIUM' WHEN {_w("disclosure")} THEN 'LOW' ELSE 'MEDIUM' END AS derived FROM a
"""
SCA_BEST_FIX = f"""
WITH f AS (SELECT DISTINCT eco, pkg, r.range_type AS kind, e.fixed AS fixed FROM (SELECT eco, pkg, r, unnest(r.events) AS e FROM (SELECT lower(trim(ecosystem, ' ')) AS eco, lower(trim(package, ' ')) AS pkg, unnest(ranges) AS r FROM advisories WHERE package IS NOT NULL)) WHERE e.fixed <> '' AND r.range_type IN ('SEMVER', 'ECOSYSTEM'))
SELECT eco, pkg, arg_max(fixed, ((kind = 'SEMVER')::INT, list_transform({_PARTS.format(_CLEAN.format("fixed"))}, lambda p: (CASE WHEN regexp_matches(p, '^[0-9]{{1,18}}$') THEN 0 ELSE 1 END, coalesce(CASE WHEN regexp_matches(p, '^[0-9]{{1,18}}$') THEN try_cast(p AS BIGINT) END, 0), p)), fixed)) AS best_fix FROM f GROUP BY 1, 2
"""
SCA_UPSERT = "SELECT arg_max(adv_key, (loaded_at >= TIMESTAMPTZ '2026-10-01 00:00:00+00', loaded_at, adv_key)) AS adv_key, id FROM advisories WHERE id IS NOT NULL GROUP BY id"
SCA_STATS = "SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT (lower(trim(ecosystem, ' ')), lower(trim(package, ' ')))) AS packages, array_to_string(list_sort(list_distinct(list(lower(trim(ecosystem, ' '))))), ',') AS ecosystems FROM advisories"
SCA_CACHE = f"""
WITH w AS (SELECT DISTINCT eco, pkg, version FROM ({SCA_DISTINCT})), c AS (SELECT {_ECO.format("")} AS eco, {_PKG.format("")} AS pkg, trim(version, ' ') AS version, max(seen_at) AS last FROM deps WHERE version IS NOT NULL GROUP BY 1, 2, 3)
SELECT eco, pkg, version, left(sha256(eco || ':' || pkg || ':' || version), 24) AS cache_key, CASE WHEN last IS NULL THEN 'missing' WHEN last > TIMESTAMPTZ '2026-10-01 00:00:00+00' - INTERVAL 1440 HOUR THEN 'fresh' ELSE 'stale' END AS state FROM w LEFT JOIN c USING (eco, pkg, version)
"""


SCA_SAVED = f"""
WITH r AS (SELECT {_ECO.format("")} AS eco, {_PKG.format("")} AS pkg, trim(version, ' ') AS version, seen_at AS cached_at, source_file FROM deps WHERE version IS NOT NULL AND seen_at IS NOT NULL)
SELECT eco, pkg, version, max(cached_at) AS cached_at, arg_max(source_file, (cached_at, source_file)) AS source_file FROM r GROUP BY 1, 2, 3
"""
OSV_RATINGS = _DOCUMENTS + f"""
SELECT raw_id, vuln_pos, upper(coalesce(nullif({_text(_of("d", "severity"))}, ''), 'MEDIUM')) AS severity,
  coalesce((SELECT string_agg({_text("t.x")}, ',' ORDER BY t.pos) FROM {_items(_of("d", "cwe"))} t), '') AS cwes,
  coalesce((SELECT arg_min({_text(_of("t.x", "score"))}, t.pos) FROM {_items(_of("x", "severity"))} t WHERE contains(upper({_text(_of("t.x", "type"))}), 'CVSS')), '') AS cvss
FROM (SELECT raw_id, vuln_pos, x, {_of("x", "database_specific")} AS d FROM v)
"""
REP_DOCUMENT = """
WITH r AS (SELECT count(*) AS n FROM findings), u AS (SELECT count(DISTINCT coalesce(rule_id, id, chr(0))) AS n FROM findings)
SELECT part, n, greatest(0, n - 1) * (part IN (1, 3))::INT AS commas FROM (SELECT 0 AS part, 1 AS n UNION ALL SELECT 1, n FROM u UNION ALL SELECT 2, 1 UNION ALL SELECT 3, n FROM r UNION ALL SELECT 4, 1)
"""


def statements() -> dict[str, str]:
    from siftline.plans import sql_code, sql_files

    return sql_files.statements() | sql_code.statements() | {
        "p4_found": P4_FOUND, "p4_vulnerabilities": P4_VULNERABILITIES, "p4_affected": P4_AFFECTED, "p4_ranges": P4_RANGES, "p4_shapes": P4_SHAPES,
        "src_files": SRC_FILES, "src_lines": SRC_LINES,
        "lex_code_hits": LEX_CODE, "lex_secret_hits": LEX_SECRET, "lex_document_hits": LEX_DOCUMENTS, "lex_evidence_hits": LEX_EVIDENCE, "lex_webhooks": LEX_WEBHOOKS, "flt_masked": FLT_MASKED,
        "fnd_canonical": FND_CANONICAL, "ddp_exact": DDP_EXACT, "ddp_merged": DDP_MERGED, "ddp_wide": DDP_WIDE, "dif_secrets": DIF_SECRETS, "git_tracked": GIT_TRACKED, "cnf_scores": CNF_SCORES, "cor_chains": COR_CHAINS, "cor_ranked": COR_RANKED, "cor_members": COR_MEMBERS, "flt_ignored": FLT_IGNORED, "flt_changed": FLT_CHANGED, "cor_scope": COR_SCOPE, "sup_active": SUP_ACTIVE, "rsk_projects": RSK_PROJECTS, "cat_rollup": CAT_ROLLUP,
        "sca_matches": SCA_MATCHES, "sca_distinct": SCA_DISTINCT, "sca_severity": SCA_SEVERITY, "sca_best_fix": SCA_BEST_FIX, "sca_upsert": SCA_UPSERT, "sca_stats": SCA_STATS, "sca_top": SCA_TOP, "sca_findings": SCA_FINDINGS, "sca_cache": SCA_CACHE, "sca_saved": SCA_SAVED, "osv_ratings": OSV_RATINGS, "rep_document": REP_DOCUMENT,
    }
