"""DuckDB statements that give the same rows as the queries of this subpackage."""

# the sequence of runs of a string, and its sorted multiset
_KEY = "lower(trim(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', ' ', 'g')))"
_SORTED = "list_sort(regexp_extract_all(lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+'))"


def key(c: str) -> str:
    return _KEY.format(c)


def multiset(c: str) -> str:
    return _SORTED.format(c)


_P1_ROWS = f"""
WITH f AS (
  SELECT finding_key AS k, project, canonical_rule, line, {key("file")} AS file, detector_ids, scanned_at,
         coalesce((SELECT max(d.trust) FROM detectors d WHERE list_contains(f.detector_ids, d.detector_id)), 0) AS trust,
         CASE WHEN regexp_matches(upper(severity), '^\\s*(CRITICAL|HIGH|MEDIUM|LOW|INFO)\\s*$') THEN upper(regexp_extract(severity, '[A-Za-z]+')) END AS severity,
         CASE WHEN regexp_matches(upper(confidence), '^\\s*(HIGH|MEDIUM|LOW)\\s*(\\(\\s*[0-9]+(\\.[0-9]+)?\\s*\\))?\\s*$') THEN upper(regexp_extract(confidence, '[A-Za-z]+')) END AS confidence,
         CASE WHEN regexp_matches(upper(cwe), '^\\s*(CWE[ _-]?)?0*[1-9][0-9]*\\s*$') THEN 'CWE-' || regexp_extract(cwe, '0*([1-9][0-9]*)\\s*$', 1) END AS cwe
  FROM findings f WHERE line > 0 AND canonical_rule IS NOT NULL AND project IS NOT NULL),
g AS (SELECT *, min(k) OVER w AS group_key, count(*) OVER w AS n_rows FROM f WINDOW w AS (PARTITION BY project, canonical_rule, line, file)),
m AS (SELECT * FROM g WHERE n_rows > 1),
d AS (SELECT group_key, string_agg(DISTINCT x, ',' ORDER BY x) AS detector_ids FROM (SELECT group_key, unnest(detector_ids) AS x FROM m) GROUP BY 1)
"""

P1_FOUND = (
    _P1_ROWS
    + """
SELECT m.group_key, coalesce(arg_max(severity, (trust, scanned_at, k)) FILTER (WHERE severity IS NOT NULL), '') AS severity,
       coalesce(arg_max(confidence, (trust, scanned_at, k)) FILTER (WHERE confidence IS NOT NULL), '') AS confidence,
       coalesce(arg_max(cwe, (trust, scanned_at, k)) FILTER (WHERE cwe IS NOT NULL), '') AS cwe,
       coalesce(max(d.detector_ids), '') AS detector_ids
FROM m LEFT JOIN d USING (group_key) GROUP BY 1
"""
)


def _p1_votes(field: str) -> str:
    return f"""SELECT group_key, arg_max({field}, (votes, lead)) AS {field} FROM (
  SELECT group_key, {field}, sum(vote) AS votes, max((trust, scanned_at, k)) AS lead FROM v WHERE {field} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


P1_VOTES = (
    _P1_ROWS
    + f""", v AS (SELECT *, CASE WHEN scanned_at IS NULL THEN trust::HUGEINT ELSE trust::HUGEINT * (1::HUGEINT << (80 - least(80, greatest(0, date_diff('day', scanned_at::DATE, (SELECT max(scanned_at::DATE) FROM f)) // 30)))::INTEGER) END AS vote FROM m)
SELECT b.group_key, b.n_rows, coalesce(s.severity, '') AS severity, coalesce(c.confidence, '') AS confidence, coalesce(w.cwe, '') AS cwe, coalesce(d.detector_ids, '') AS detector_ids
FROM (SELECT DISTINCT group_key, n_rows FROM m) b LEFT JOIN d USING (group_key)
LEFT JOIN ({_p1_votes("severity")}) s USING (group_key) LEFT JOIN ({_p1_votes("confidence")}) c USING (group_key) LEFT JOIN ({_p1_votes("cwe")}) w USING (group_key)
"""
)

P2_FOUND = f"""
WITH i AS (SELECT inc_key AS k, batch_no AS batch, project, {key("rule_id")} AS rule, {key("file")} AS file, {multiset("evidence")} AS runs, line, received_at FROM incoming_findings WHERE project IS NOT NULL),
a AS (
  SELECT finding_key AS k, -1 AS batch, project, {key("rule_id")} AS rule, {key("file")} AS file, {multiset("evidence")} AS runs, 'findings' AS accepted_in FROM findings WHERE project IS NOT NULL
  UNION ALL SELECT k, batch, project, rule, file, runs, 'incoming_findings' FROM i),
pairs AS (
  SELECT a.k AS accepted_key, i.k AS inc_key, a.accepted_in, a.runs AS x, i.runs AS y FROM i JOIN a USING (project, rule, file)
  WHERE a.batch < i.batch AND len(a.runs) > 0 AND len(i.runs) > 0),
near AS (
  SELECT accepted_key, inc_key, accepted_in FROM pairs
  WHERE 5 * list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) >= 4 * greatest(len(x), len(y))),
s AS (SELECT sup_key, project, CASE WHEN rule_id IS NOT NULL THEN {key("rule_id")} END AS rule, {key("file")} AS tail, line, expires FROM suppressions WHERE project IS NOT NULL)
SELECT min(accepted_key) AS accepted_key, inc_key, accepted_in FROM near GROUP BY inc_key, accepted_in
UNION ALL
SELECT min(sup_key), i.k, 'suppressions' FROM i JOIN s ON s.project = i.project
WHERE (s.rule IS NULL OR s.rule = i.rule) AND (s.tail = '' OR s.tail = i.file OR ends_with(i.file, ' ' || s.tail)) AND (coalesce(s.line, 0) = 0 OR s.line = i.line)
  AND (s.expires IS NULL OR try_cast(s.expires AS DATE) >= CAST(i.received_at AT TIME ZONE 'UTC' AS DATE)) GROUP BY i.k
"""

_P3_IDENTS = """
WITH RECURSIVE said AS (
  SELECT adv_key, id AS x FROM advisories
  UNION ALL SELECT adv_key, unnest(regexp_split_to_array(a, '[,;|\\s]+')) FROM (SELECT adv_key, unnest(aliases) AS a FROM advisories)),
ident AS (SELECT DISTINCT adv_key, lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) AS ident FROM said WHERE regexp_matches(x, '[1-9]')),
"""

P3_FOUND = (
    _P3_IDENTS
    + """
edge AS (SELECT DISTINCT a.adv_key AS v, b.adv_key AS u FROM ident a JOIN ident b USING (ident)),
walk(v, u) AS (SELECT v, u FROM edge UNION SELECT walk.v, edge.u FROM walk JOIN edge ON edge.v = walk.u),
comp AS (SELECT v AS adv_key, min(u) AS group_key FROM walk GROUP BY v)
SELECT group_key, adv_key FROM comp WHERE group_key IN (SELECT group_key FROM comp GROUP BY 1 HAVING count(*) > 1)
"""
)

_P5 = f"""
SELECT project, line, {key("rule_id")} AS rule, {key("file")} AS file, {multiset("evidence")} AS runs, finding_key,
       coalesce(rule_id, chr(1)) || chr(0) || coalesce(file, chr(1)) || chr(0) || coalesce(evidence, chr(1)) AS raw FROM findings
"""

P5_FOUND = f"""
WITH f AS (SELECT finding_key, min(finding_key) OVER w AS group_key, count(*) OVER w AS n FROM ({_P5}) WINDOW w AS (PARTITION BY project, line, rule, file, runs))
SELECT group_key, finding_key FROM f WHERE n > 1
"""

P5_COPIES = f"SELECT min(finding_key) AS group_key, count(DISTINCT raw) AS n_raw, count(*) AS n_rows FROM ({_P5}) GROUP BY project, line, rule, file, runs"
