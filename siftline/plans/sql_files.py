"""DuckDB statements for the queries on configuration and container files."""

from siftline.operators import configs, containers
from siftline.plans.sql import _in, lines, quoted

_LOWER_NAME = "lower(regexp_extract(rel_path, '[^/]*$'))"
_FORMAT = f"""CASE WHEN {_LOWER_NAME} = '.env' OR starts_with({_LOWER_NAME}, '.env.') OR ends_with({_LOWER_NAME}, '.env') THEN 'env' WHEN regexp_matches(lower(rel_path), '[.]ya?ml$') THEN 'yaml'
  WHEN ends_with(lower(rel_path), '.json') THEN 'json' WHEN ends_with(lower(rel_path), '.toml') THEN 'toml' WHEN regexp_matches(lower(rel_path), '[.](ini|cfg|conf)$') THEN 'ini' ELSE 'other' END"""


def _unquoted(x: str) -> str:
    return f"""CASE WHEN length({x}) > 1 AND (regexp_matches({x}, '^".*"$') OR regexp_matches({x}, '^''.*''$')) THEN substring({x}, 2, length({x}) - 2) ELSE {x} END"""


_FLAT = lines(f"(SELECT * FROM (SELECT *, {_FORMAT} AS format FROM source_files) WHERE format IN ('env', 'ini', 'toml'))", "project, rel_path, format", "content")
_EQ, _CO = quoted(r"^\s*([^=\s\[#;][^=]*?)\s*=\s*(.*)$"), quoted(r"^\s*([^:=\s\[#;][^:=]*?)\s*:\s*(.*)$")
_HEADER, _EXPORT, _REMARK = quoted(r"^\s*\[+\s*([^\]]+?)\s*\]+"), quoted(r"^\s*export\s+"), quoted(r"^\s*(?:[#;]|//)")
_ENTRIES = f"""
WITH x AS (SELECT *, CASE WHEN format <> 'env' THEN last_value(nullif(regexp_extract(line, {_HEADER}, 1), '') IGNORE NULLS) OVER (PARTITION BY project, rel_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) END AS section,
  CASE WHEN format = 'env' THEN regexp_replace(line, {_EXPORT}, '') ELSE line END AS t FROM {_FLAT}),
y AS (SELECT *, CASE WHEN regexp_matches(t, {_EQ}) THEN regexp_extract(t, {_EQ}, 1) WHEN format = 'ini' AND regexp_matches(t, {_CO}) THEN regexp_extract(t, {_CO}, 1) END AS k,
  trim(CASE WHEN regexp_matches(t, {_EQ}) THEN regexp_extract(t, {_EQ}, 2) WHEN format = 'ini' AND regexp_matches(t, {_CO}) THEN regexp_extract(t, {_CO}, 2) END, ' ') AS v FROM x WHERE NOT regexp_matches(line, {_REMARK}))
SELECT project, rel_path, line_no, format, section, CASE WHEN section IS NOT NULL THEN section || '.' || k ELSE k END AS key, {_unquoted("v")} AS value, line AS raw_line FROM y WHERE k IS NOT NULL
"""
CFG_ENTRIES = f"SELECT * EXCLUDE (raw_line) FROM ({_ENTRIES})"


def config_hits(entries: str) -> str:
    k, v = "lower(key)", "lower(value)"
    has = lambda *xs: f"regexp_matches({k}, {quoted('|'.join(xs))})"
    off, on = _in(configs.OFF), _in(configs.ON)
    url = f"regexp_extract(value, {quoted(configs.URL_PASSWORD)}, 1)"
    secret = f"regexp_matches(key, {quoted(configs.SECRET_KEY)})"
    star = quoted(r"""'\*'|"\*"|\[\*\]""")
    tests = {
        "VG-CFG-001": f"({has('debug')} AND {v} IN ('true', '1', 'yes', 'on')) OR ({has('env')} AND {v} IN ('development', 'dev') AND contains(lower(raw_line), 'debug'))",
        "VG-CFG-002": f"{has('cors', 'allow_origin', 'allowed_origin')} AND (trim(value, ' ') = '*' OR regexp_matches(value, {star}))",
        "VG-CFG-003": f"{has('host', 'bind', 'address', 'listen')} AND (contains(value, '0.0.0.0') OR contains(value, '::'))",
        "VG-CFG-005": f"{has('url', 'endpoint', 'api_base', 'host')} AND starts_with({v}, 'http://') AND NOT contains({v}, 'localhost') AND NOT contains({v}, '127.0.0.1')",
        "VG-CFG-006": f"({has('cookie_secure', 'cookie_httponly', 'strict_transport_security')} AND {v} = 'false') OR ({has('csrf_enabled', 'csrf_protection')} AND {v} IN ('false', '0')) OR ({has('disable_csrf')} AND {v} IN {on}) OR ({has('samesite')} AND {v} = 'none')",
        "VG-CFG-007": f"({has('ssl_verify', 'tls_verify', 'verify_ssl', 'reject_unauthorized')} AND {v} IN {off}) OR ({has('insecure_skip')} AND {v} IN {on})",
        "VG-CFG-008": f"regexp_matches(value, {quoted(configs.SECRET_VALUE)}) OR ({url} <> '' AND {url} NOT IN ('password', 'root', 'admin')) OR ({secret} AND strlen(value) >= 16 AND NOT regexp_matches({v}, 'dummy|placeholder|example'))",
        "VG-CFG-009": f"{secret} AND {v} IN {_in(configs.COMMON_PASSWORDS)}",
        "VG-CFG-010": f"({has('algorithm')} AND {v} = 'none') OR ({has('jwt', 'token')} AND (({has('verify_signature')} AND {v} IN ('false', '0')) OR ({has('allow_unverified', 'allow_none')} AND {v} IN {on})))",
    }
    return " UNION ALL ".join(f"SELECT project, rel_path, line_no, {quoted(r)} AS rule_id, {quoted(configs.CONFIG_RULES[r])} AS severity, key FROM ({entries}) WHERE {t}" for r, t in tests.items())


CFG_FLAT_HITS = config_hits(_ENTRIES)
_IGNORES = lines("(SELECT * FROM source_files WHERE regexp_extract(rel_path, '[^/]*$') = '.gitignore')", "project", "content")
CFG_ENV_IGNORED = f"""
SELECT project, rel_path FROM source_files WHERE ends_with({_LOWER_NAME}, '.env') AND project NOT IN (SELECT project FROM {_IGNORES} WHERE trim(line, ' ') IN ('.env', '*.env', '/.env', '.env*') AND project IS NOT NULL)
"""
_DOCKERFILES = f"(SELECT * FROM source_files WHERE regexp_matches({_LOWER_NAME}, '^dockerfile([.].+)?$|[.]dockerfile$'))"
_OPS, _REST = quoted(r"(?i)^(FROM|COPY|ADD|ENV|ARG|USER|EXPOSE|HEALTHCHECK)(?:\s|$)"), quoted(r"^\S+\s*")
_ASSIGNED, _NAMED, _FLAGS, _BLANKS = quoted(r"^[A-Za-z_]\w*(?:\s*=\s*|\s+|$)"), quoted(r"^([A-Za-z_]\w*)"), quoted(r"^(?:--\S+\s+)*"), quoted(r"\s+")
DCK_INSTRUCTIONS = f"""
WITH x AS (SELECT project, rel_path, line_no, trim(line, ' ') AS raw FROM {lines(_DOCKERFILES, "project, rel_path", "content")}),
y AS (SELECT *, upper(regexp_extract(raw, {_OPS}, 1)) AS op, trim(regexp_replace(raw, {_REST}, ''), ' ') AS rest FROM x),
z AS (SELECT *, split_part(rest, ' ', 1) AS image, regexp_replace(rest, {_ASSIGNED}, '') AS v FROM y WHERE op <> '')
SELECT project, rel_path, line_no, op, CASE WHEN op IN ('ENV', 'ARG') THEN regexp_extract(rest, {_NAMED}, 1) WHEN op = 'FROM' THEN regexp_replace(image, '(?:@.*|:[^:/]+)$', '')
  WHEN op IN ('COPY', 'ADD') THEN split_part(regexp_replace(rest, {_FLAGS}, ''), ' ', 1) ELSE image END AS key,
  CASE WHEN op IN ('ENV', 'ARG') THEN {_unquoted("v")} WHEN op = 'FROM' THEN CASE WHEN contains(image, '@') THEN regexp_extract(image, '@(.*)$', 1) ELSE regexp_extract(image, ':([^:/]+)$', 1) END
  WHEN op IN ('COPY', 'ADD') THEN regexp_split_to_array(rest, {_BLANKS})[-1] ELSE '' END AS value, raw FROM z
"""
_SECRET = quoted(containers.SECRET_NAME)
_PORTS = "(" + ", ".join(map(str, containers.DATABASE_PORTS)) + ")"
_SEVERITIES = " ".join(f"WHEN {quoted(r)} THEN {quoted(s)}" for r, s in containers.DOCKER_SEVERITY.items())
DCK_HITS = f"""
WITH i AS ({DCK_INSTRUCTIONS}), p AS (SELECT *, try_cast(regexp_extract(key, '^([0-9]+)', 1) AS INT) AS port FROM i), f AS (SELECT project, rel_path FROM {_DOCKERFILES}),
s AS (
  SELECT project, rel_path, line_no, 'VG-DCK-002' AS rule_id FROM p WHERE op = 'ENV' AND regexp_matches(key, {_SECRET}) AND value <> '' AND NOT starts_with(value, '$')
  UNION ALL SELECT project, rel_path, line_no, 'VG-DCK-003' FROM p WHERE op = 'COPY' AND key IN ('.', './') AND value IN ('.', './', '/app', '/app/')
  UNION ALL SELECT project, rel_path, line_no, 'VG-DCK-005' FROM p WHERE op = 'FROM' AND value IN ('', 'latest') AND lower(key) <> 'scratch'
  UNION ALL SELECT project, rel_path, line_no, 'VG-DCK-006' FROM p WHERE op = 'EXPOSE' AND port IN {_PORTS}
  UNION ALL SELECT project, rel_path, line_no, 'VG-DCK-007' FROM p WHERE op = 'EXPOSE' AND port = {containers.CACHE_PORT}
  UNION ALL SELECT project, rel_path, line_no, 'VG-DCK-017' FROM p WHERE op = 'ARG' AND regexp_matches(key, {_SECRET})
  UNION ALL SELECT f.project, f.rel_path, coalesce(max(u.line_no), 1), 'VG-DCK-001' FROM f LEFT JOIN (SELECT * FROM i WHERE op = 'USER') u USING (project, rel_path) GROUP BY 1, 2 HAVING coalesce(arg_max(u.key, u.line_no), 'root') IN ('root', '0')
  UNION ALL SELECT f.project, f.rel_path, 1, 'VG-DCK-004' FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE op = 'HEALTHCHECK' AND i.project = f.project AND i.rel_path = f.rel_path))
SELECT project, rel_path, line_no, rule_id, CASE rule_id {_SEVERITIES} END AS severity FROM s
"""


def statements() -> dict[str, str]:
    return {"cfg_entries": CFG_ENTRIES, "cfg_flat_hits": CFG_FLAT_HITS, "cfg_env_ignored": CFG_ENV_IGNORED, "dck_instructions": DCK_INSTRUCTIONS, "dck_hits": DCK_HITS}
