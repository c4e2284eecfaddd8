"""Core operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import versions
from siftline.functions.text import counted_vector, digest, mask, run_key, run_multiset
from siftline.operators import code, configs, containers, findings, graph, lexical, nested, rules, sca, taint
from siftline.sinks import reports
from siftline.sources import baseline, corpus, manifests


def one(df):
    return df.first()[0]


def files(spark, *rows):
    return spark.createDataFrame([("p", path, path.rpartition("/")[2], text) for path, text in rows], "project string, rel_path string, name string, content string")


def test_text(spark):
    df = spark.createDataFrame([("A-b__C1 é2",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(run_key("x")).collect()] == ["a b c1 2", "", ""]
    assert one(df.select(run_multiset("x"))) == "2 a b c1"
    v = spark.createDataFrame([("a b a c a",), ("a a b",), ("",), (None,)], "x string").select(counted_vector("x").alias("v")).collect()
    assert [len(r.v) for r in v] == [5, 3, 0, 0] and len(set(v[0].v) & set(v[1].v)) == 3
    d = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a")], "x string, y string").select(digest("x", "y")).collect()
    assert len({bytes(r[0]) for r in d}) == 4
    assert [r[0] for r in spark.createDataFrame([("123456789",), ("12345678",), (None,)], "x string").select(mask("x")).collect()] == ["12345678****", "****", None]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("1.0.0", "1.0.0", 0), ("v1.2.3", "1.2.3", 0), ("1.2.3", "1.2.4", -1), ("1.3", "1.2.9", 1), ("4.17.20", "4.17.21", -1), ("2.0.1", "2.2.5", -1), ("v0.3.7", "v0.3.8", -1), ("1.0", "1.0.0", -1), ("1.0.0", "1.0.0-rc1", -1), ("1.10", "1.9", 1), ("1.0+x", "1.0+y", 0), ("^1.2", "~1.2", 0), ("1.99999999999999999999", "1.5", 1)],
)
def test_versions(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(versions.compare_versions(F.col("a"), F.col("b")), versions.compare_versions(F.col("b"), F.col("a")))
    assert tuple(df.first()) == (want, -want)


def test_constraints_and_ranges(spark):
    cases = [("1.5.0", "< 2.0.0", True), ("2.0.0", "<= 2.0.0", True), ("1.5.0", ">= 1.0.0, < 2.0.0", True), ("2.1.0", ">= 1.0.0, < 2.0.0", False), ("1.0", "*", True), ("1.0", "", True), ("1.0", "1.0", True), ("1.0", "!= 1.0", False), ("3", "> 2", True)]
    df = spark.createDataFrame(cases, "v string, c string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", versions.meets(F.col("v"), F.col("c"))).collect())
    kind = "v string, r array<struct<range_type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>, want boolean"
    span = lambda *e, t="SEMVER": [(t, list(e))]
    rows = [
        ("1.5.0", span(("1.0.0", None, None), (None, "2.0.0", None)), True),
        ("2.0.0", span(("1.0.0", None, None), (None, "2.0.0", None)), False),
        ("9", span(("0", None, None)), True),
        ("2.0.0", span(("1.0.0", None, None), (None, None, "2.0.0")), True),
        ("1.5", span(("0", None, None), t="GIT"), False),
        ("3.5", span(("1", None, None), (None, "2", None), ("3", None, None), (None, "4", None)), True),
        ("1", None, False),
        ("1", [], False),
    ]
    df = spark.createDataFrame(rows, kind)
    assert all(r.got == r.want for r in df.withColumn("got", versions.in_ranges(F.col("v"), F.col("r"))).collect())


def test_lookup_falls_back_to_the_name_and_takes_unknown_versions(spark):
    deps = spark.createDataFrame([("A ", "1.0", "npm", "f"), ("a", "1.0", "NPM", "e"), ("b", None, "npm", "f"), ("c", "9", "npm", "f"), (None, "1", "npm", "f")], "name string, version string, ecosystem string, source_file string")
    adv = spark.createDataFrame([(1, "X", "a", "npm", "HIGH", ["< 2"]), (2, "Y", "b", "PyPI", "LOW", ["< 1"]), (3, "Z", "c", "npm", None, ["< 2"])], "adv_key bigint, id string, package string, ecosystem string, severity string, affected_versions array<string>")
    adv = adv.withColumns({"ranges": F.lit(None).cast("array<struct<range_type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"), "fixed_versions": F.array().cast("array<string>")})
    got = {(r.pkg, r.version, r.adv_key) for r in sca.matches(deps, adv).collect()}
    assert got == {("a", "1.0", 1), ("b", "unknown", 2)}
    assert sca.matches(deps.limit(0), adv).count() == 0 and sca.matches(deps, adv.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "rule", "hit"),
    [
        ('q = f"SELECT * FROM notes WHERE user_id = {user_id}"', "VG-SAST-001", True),
        ('subprocess.run(target, shell=True)', "VG-SAST-008", True),
        ("h = hashlib.md5(password)", "VG-AUTH-001", True),
        ("token = base64.b64encode(email)", "VG-AUTH-002", True),
        ("eval(user_input)", "VG-SAST-003", True),
        ("json.loads(user_input)", "VG-SAST-003", False),
        ("db.exec(query)", "VG-SAST-003", False),
        ("requests.get(u, verify=False)", "VG-SAST-004", True),
        ("requests.get(u, verify=True)", "VG-SAST-004", False),
        ("DES.new(key)", "VG-SAST-005", True),
        ("hashlib.sha256()", "VG-SAST-005", False),
        ('u = "http://api.remote.net/x"', "VG-SAST-006", True),
        ('u = "https://api.remote.net/x"', "VG-SAST-006", False),
        ('u = "http://localhost/x"', "VG-SAST-006", False),
        ('password = "hunter2"', "VG-SAST-007", True),
        ('password = os.environ.get("P")', "VG-SAST-007", False),
        ("# eval(user_input)", "VG-SAST-003", False),
        ("k = AKIA" + "A" * 16, "VG-SEC-001", True),
        ("-----BEGIN " + "RSA PRIVATE KEY-----", "VG-SEC-005", True),
    ],
)
def test_rules(spark, line, rule, hit):
    got = {r.rule_id for r in lexical.rule_hits(spark.createDataFrame([(1, 1, line)], "k int, line_no int, line string"), ["k"]).collect()}
    assert (rule in got) == hit


def test_deserialisation_severity_and_masking(spark):
    rows = [(1, "pickle.loads(user_input)"), (2, "pickle.loads(x)"), (3, 'pickle.loads(b"abc")'), (4, "yaml.load(x, Loader=SafeLoader)"), (5, 'password = "abcdefghijkl"'), (6, None)]
    got = {(r.line_no, r.rule_id): r for r in lexical.rule_hits(spark.createDataFrame(rows, "line_no int, line string").withColumn("k", F.lit(1)), ["k"]).collect()}
    assert [got[i, "VG-SAST-009"].severity for i in (1, 2, 3)] == ["CRITICAL", "HIGH", "LOW"] and (4, "VG-SAST-009") not in got
    assert got[5, "VG-SEC-006"].evidence == "password****"


def test_rule_engine_has_no_join(spark):
    df = lexical.rule_hits(spark.createDataFrame([(1, 1, "x")], "k int, line_no int, line string"), ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_every_rule_has_a_weakness():
    assert all(v.startswith("CWE-") for v in rules.CWE_OF.values()) and len(rules.CWE_OF) >= 43


def test_webhook_window(spark):
    text = "@app.route('/webhook')\n" + "x = 1\n" * 30 + "y = request.get_json()\n"
    far = "@app.route('/webhook')\n" + "x = 1\n" * 34 + "y = request.get_json()\n"
    x = corpus.lines(files(spark, ("a.py", text), ("b.py", far), ("c.py", text + "hmac.compare_digest(a, b)\n")), ["rel_path"])
    assert [tuple(r) for r in lexical.missing_webhook_signature(x, ["rel_path"]).collect()] == [("a.py", 1, 32)]


def test_lines_and_gates(spark):
    f = files(spark, ("a.py", "x\r\ny\n"), ("b.py", ""), ("c.py", None), ("vendor/d.py", "x"), ("e.exe", "x"), ("f.bin2", "a\x00b"), ("test_g.py", "x"), ("h/i.md", "x"), ("j", "x"))
    assert [(r.line_no, r.line) for r in corpus.lines(f.where("rel_path = 'a.py'"), ["rel_path"]).collect()] == [(1, "x"), (2, "y")]
    got = {r.rel_path: r.verdict for r in corpus.gated(f, exclude=("*.md",)).collect()}
    assert got == {"a.py": "scanned", "b.py": "scanned", "c.py": "binary", "vendor/d.py": "folder", "e.exe": "binary", "f.bin2": "binary", "test_g.py": "test", "h/i.md": "excluded", "j": "scanned"}


def test_folder_is_gated_before_it_is_read(spark, tmp_path):
    for path, data in (("a/x.py", b"print(1)"), ("node_modules/y.js", b"1"), ("z.png", b"\x89"), ("raw.zzz", b"a\x00b"), ("bad.txt", b"\xff\xfe\xfa")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    f = corpus.from_folder(spark, str(tmp_path))
    assert [(r.rel_path, r.content) for r in f.collect()] == [("a/x.py", "print(1)")]
    scan = f._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 3  # x.py, raw.zzz and bad.txt: the others are pruned before they are opened


JUDGED = """import os, subprocess, shlex
CMD = "ls"
def a(request):
    x = request.args.get("q")
    n = int(x)
    y = "v"
    subprocess.run(["ls", "-l"])
    subprocess.run(["ls", CMD])
    subprocess.run(["ls", shlex.quote(x)])
    subprocess.run(["ls", n])
    subprocess.run(["ls", x])
    subprocess.run(["ls", other])
    os.system("ls")
    os.system(CMD)
    os.system("ls " + CMD)
    os.system("ls " + x)
    os.system("ls " + other)
    cur.execute(f"SELECT a FROM t WHERE b = {n}")
    cur.execute(f"SELECT a FROM t WHERE b = {x}")
    cur.execute(f"SELECT a FROM t WHERE b = {other}")
    subprocess.run("ls " + x, shell=True)
"""


def test_hits_are_judged_by_their_arguments(spark):
    f = files(spark, ("a.py", JUDGED), ("b.rs", "fn a() {}\n#[cfg(test)]\nmod t { fn b() { Command(\"eval(\"); eval(x); } }"))
    facts = code.facts(f)
    edges, starts, _ = taint.flow_graph(facts)
    hits = lexical.rule_hits(corpus.lines(corpus.before_tests(f), ["project", "rel_path"]), ["project", "rel_path"], [r for r in rules.CODE_RULES if r.rule_id in (*lexical.JUDGED, "VG-SAST-003")])
    got = {(r.line_no, r.rule_id[3:]): (r.severity, r.confidence, r.source is not None) for r in lexical.judged(hits, facts, taint.reached_names(taint.reached(edges, starts))).collect()}
    assert got == {
        (11, "CMD-LIST"): ("HIGH", "HIGH", True), (12, "CMD-LIST"): ("HIGH", "MEDIUM", False),
        (16, "SAST-002"): ("CRITICAL", "HIGH", True), (17, "SAST-002"): ("HIGH", "MEDIUM", False),
        (19, "SAST-001"): ("HIGH", "HIGH", True), (20, "SAST-001"): ("HIGH", "MEDIUM", False),
        (21, "SAST-002"): ("CRITICAL", "HIGH", True), (21, "SAST-008"): ("CRITICAL", "HIGH", True),
    }


def test_skipped_files_are_reported(spark):
    f = corpus.gated(files(spark, ("a.py", "x"), ("b.bin2", "a\x00b"), ("c.py", None), ("vendor/d.py", "x")))
    assert {(r.rel_path, r.reason) for r in corpus.warnings(f).collect()} == {("b.bin2", "not a text"), ("c.py", "no text")}


def test_added_lines_of_a_diff(spark):
    rows = [(1, "diff --git a/x b/x"), (2, "+++ b/x.py"), (3, "+key = 1"), (4, " ctx"), (5, "-old"), (6, "+++ b/y.py"), (7, "+z")]
    d = spark.createDataFrame(rows, "line_no int, line string").withColumn("ref", F.lit("r"))
    assert [(r.file, r.text) for r in corpus.diff_added(d, "ref").orderBy("line_no").collect()] == [("x.py", "key = 1"), ("y.py", "z")]


def test_config_entries_and_rules(spark):
    f = files(
        spark,
        (".env", "export DEBUG=true\nSECRET_KEY='abcdefghijklmnop1234'\n# X=1\n"),
        ("a.ini", "[server]\nhost = 0.0.0.0\nalgorithm: none\n"),
        ("b.yaml", "tls:\n  ssl_verify: false\nlist:\n  - a\nurl: http://x.net\n"),
        ("c.json", '{"db": {"password": "admin"}, "hosts": [{"cors_origin": "*"}]}'),
        ("d.json", "{broken"),
    )
    got = {(r.rel_path, r.rule_id, r.line_no) for r in configs.config_hits(configs.entries(f)).collect()}
    assert got == {(".env", "VG-CFG-001", 1), (".env", "VG-CFG-008", 2), ("a.ini", "VG-CFG-003", 2), ("a.ini", "VG-CFG-010", 3), ("b.yaml", "VG-CFG-007", 2), ("b.yaml", "VG-CFG-005", 5), ("c.json", "VG-CFG-009", 1), ("c.json", "VG-CFG-002", 1)}
    assert {r.key for r in configs.entries(f).where("rel_path = 'c.json'").collect()} == {"db.password", "hosts[0].cors_origin"}
    assert [tuple(r) for r in configs.env_not_ignored(f).collect()] == [("p", ".env")]
    assert configs.env_not_ignored(f.unionByName(files(spark, (".gitignore", ".env\n")))).count() == 0


def test_dockerfile_rules(spark):
    bad = "FROM node\nENV API_TOKEN=abc\nARG DB_PASSWORD\nCOPY . .\nEXPOSE 5432\nEXPOSE 6379/tcp\n"
    good = "FROM node:20@sha256:abc\nUSER root\nUSER app\nHEALTHCHECK CMD true\n"
    got = {(r.rel_path, r.rule_id) for r in containers.dockerfile_hits(files(spark, ("Dockerfile", bad), ("x.Dockerfile", good), ("z/Dockerfile", ""))).collect()}
    assert got == {("Dockerfile", f"VG-DCK-{n}") for n in ("001", "002", "003", "004", "005", "006", "007", "017")} | {("z/Dockerfile", "VG-DCK-001"), ("z/Dockerfile", "VG-DCK-004")}


def test_compose_rules(spark):
    text = """services:
  db:
    image: postgres:16
    ports:
      - "5432:5432"
    environment:
      POSTGRES_PASSWORD: postgres
  web:
    image: x
    privileged: true
    user: "1000"
    environment:
      - DSN=postgres://u:postgres@db/x
    cap_add: [SYS_ADMIN]
    volumes:
      - /var/run/docker.sock:/var/run/docker.sock
"""
    got = {(r.service, r.rule_id) for r in containers.compose_hits(containers.services(files(spark, ("docker-compose.yml", text)))).collect()}
    assert got == {("db", "VG-DCK-006"), ("db", "VG-DCK-018"), ("db", "VG-DCK-020"), ("web", "VG-DCK-011"), ("web", "VG-DCK-012"), ("web", "VG-DCK-013")}


def test_sensitive_file_in_build_context(spark):
    f = files(spark, ("Dockerfile", "FROM a:1\nCOPY . /x\n"), (".env", "A=1"))
    assert containers.exposed_context(f).count() == 1
    assert containers.exposed_context(f.unionByName(files(spark, (".dockerignore", "x")))).count() == 0


PY = 'import os\nfrom flask import request\ndef run(cmd):\n    os.system(cmd)\n\ndef handler():\n    host = request.args.get("host")\n    x = "ping " + host\n    run(x)\n'
LIB = "def helper(q):\n    cursor.execute(q)\n"
USE = 'from a.lib import helper\ndef go():\n    t = request.form["t"]\n    helper(t)\n'
SAFE = 'from a.lib import helper\ndef safe():\n    t = request.form["t"]\n    helper(int(t))\n'


def test_code_facts(spark):
    f = {(r.kind, r.name): r for r in code.facts(files(spark, ("a.py", PY), ("b.go", "package m\nfunc (s *T) Do(x string, n int) error {\n\treturn nil\n}\n"), ("c.java", "class A {\n  public int f(String a, int b) {\n    return g(a);\n  }\n}\n"), ("d.js", "const h = async (q) => {\n  return q;\n}\n"), ("e.rb", "def k(z)\n  z\nend\n"), ("x.py", None))).collect()}
    assert f["function", "run"].args == ["cmd"] and (f["function", "run"].line, f["call", "os.system"].func) == (3, "run")
    assert f["function", "Do"].args == ["x", "n"] and f["function", "f"].args == ["a", "b"] and f["function", "h"].args == ["q"] and f["function", "k"].args == ["z"]
    assert f["import", "flask"].args == ["request"] and f["call", "g"].args == ["a"]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("py", "cursor.execute(\n    'SELECT [' + x,  # (\n    y)\nf(z)\n", [("call", 1, "cursor.execute", ["'SELECT [' + x", "y"]), ("call", 4, "f", ["z"])]),
        ("py", "q = ('a'\n     + x)\n", [("assign", 1, "q", [])]),
        ("py", "def f(\n    a,\n    b,\n):\n    g(a)\n", [("function", 1, "f", ["a", "b"]), ("call", 5, "g", ["a"])]),
        ("py", "x = f(1\ny = g(2)\n", [("assign", 1, "x", []), ("call", 1, "f", []), ("assign", 2, "y", []), ("call", 2, "g", ["2"])]),  # never closed
        ("js", "app.get('/x', (q) => {\n  db.query('S' + q, {\n    p: 1\n  });\n}, last);\n", [("call", 1, "app.get", ["'/x'", "(q) => { }", "last"]), ("call", 2, "db.query", ["'S' + q", "{ p: 1 }"])]),
        ("go", "func F(a string) {\n\tdb.Query(\n\t\t\"S\" + a,\n\t)\n}\n", [("function", 1, "F", ["a"]), ("call", 2, "db.Query", ['"S" + a'])]),
    ],
)
def test_statements_of_several_lines(lang, text, want):
    got = code.facts_of(text, lang)
    assert [(x[0], x[2], x[4], x[5]) for x in got] == want
    assert all("+ x" in x[6] for x in got if x[4] == "q")


def test_taint_crosses_functions_and_files(spark):
    facts = code.facts(files(spark, ("a/app.py", PY), ("a/lib.py", LIB), ("b/m.py", USE), ("b/s.py", SAFE)))
    got = {(r.rule_id, r.source_file, r.sink_file, r.severity, r.steps) for r in taint.flows(facts).where("source NOT LIKE 'parameter%'").collect()}
    assert got == {("VG-TAINT-CMD", "a/app.py", "a/app.py", "HIGH", 2), ("VG-TAINT-SQL", "b/m.py", "a/lib.py", "CRITICAL", 1)}
    assert taint.flows(facts.limit(0)).count() == 0


def test_call_paths(spark):
    edges = spark.createDataFrame([("p", *e) for e in (("a", "b"), ("b", "c"), ("c", "b"), ("x", "c"), ("a", "b"))], "project string, a string, b string")
    got = {tuple(r.path) for r in graph.paths_to(edges, spark.createDataFrame([("p", "c")], "project string, node string")).collect()}
    assert got == {("a", "b", "c"), ("x", "c")}
    lv = {r.node: r.depth for r in graph.levels(edges, spark.createDataFrame([("p", "a")], "project string, node string")).collect()}
    assert lv == {"a": 0, "b": 1, "c": 2}


def test_call_paths_begin_at_sources_and_in_rings(spark):
    of = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], "project string, a string, b string")
    node = lambda *names: spark.createDataFrame([("p", n) for n in names], "project string, node string")
    paths = lambda *x, **k: {">".join(r.path) for r in graph.paths_to(*x, **k).collect()}
    assert paths(of(("a", "b"), ("b", "a"), ("b", "s")), node("s")) == {"a>b>s"}
    assert paths(of(("m", "h"), ("h", "s")), node("s"), sources=node("h")) == {"h>s", "m>h>s"}
    line = of(*((f"n{i}", f"n{i + 1}") for i in range(10)))
    assert paths(line, node("n10")) == set() and paths(line, node("n8")) == {">".join(f"n{i}" for i in range(9))}


def test_levels_end_where_nothing_new_is_reached(spark):
    rows = [("p", f"n{i}", f"n{i + 1}") for i in range(18)] + [("p", "n18", "n7"), ("q", "n0", "x")]  # eighteen steps, and a ring
    lv = {r.node: r.depth for r in graph.levels(spark.createDataFrame(rows, "project string, a string, b string"), spark.createDataFrame([("p", "n0")], "project string, node string")).collect()}
    assert lv == {f"n{i}": i for i in range(19)}


def test_taint_has_no_bound_on_hops(spark, hops=18):
    body = "".join(f"    v{i + 1} = v{i}\n" for i in range(hops))
    f = files(spark, ("a.py", f"from b import g\ndef f(request):\n    v0 = request.args.get('q')\n{body}    g(v{hops})\n"), ("b.py", "import os\ndef g(c):\n    os.system(c)\n"))
    got = {(r.source_file, r.sink_file, r.severity) for r in taint.flows(code.facts(f)).where("source NOT LIKE 'parameter%'").collect()}
    assert ("a.py", "b.py", "CRITICAL") in got


def test_taint_goes_on_over_many_variables(spark):
    body = "".join(f"    v{i + 1} = v{i} + '!'\n" for i in range(20))
    facts = code.facts(files(spark, ("a.py", 'def f():\n    v0 = request.args.get("x")\n' + body + "    os.system(v20)\n")))
    assert [(r.rule_id, r.sink_line, r.steps) for r in taint.flows(facts).collect()] == [("VG-TAINT-CMD", 23, 20)]


@pytest.mark.parametrize(
    ("expr", "kinds"),
    [("int(x)", {"sql", "command", "xss"}), ("shlex.quote(x)", {"command"}), ("os.path.basename(x)", {"path"}), ("html.escape(x)", {"xss"}), ("uuid.parse(x)", {"sql", "command", "path"}), ("x", set()), ("render_template('a')", {"template"})],
)
def test_sanitizers(spark, expr, kinds):
    bits = one(spark.createDataFrame([(expr,)], "e string").select(taint.cleared(F.col("e"))))
    assert {k for i, k in enumerate(taint.KINDS) if bits >> i & 1} == kinds


@pytest.mark.parametrize(("callee", "kind"), [("cursor.execute", "sql"), ("tmpl.execute", None), ("os.system", "command"), ("requests.get", "ssrf"), ("pickle.loads", "deserialization"), ("db.query", "sql"), ("print", None), ("render_template_string", "template")])
def test_sinks(spark, callee, kind):
    assert one(spark.createDataFrame([(callee,)], "c string").select(taint.sink_kind(F.col("c")))) == kind


def test_frameworks_and_routes(spark):
    f = files(spark, ("a.py", "from flask import Flask\n@login_required\n@app.route('/x')\n"), ("b.js", "app.get('/y/:id', f);\nimport e from 'express'\n"), ("c.go", 'r := gin.Default()\nr.POST("/z", h)\n'))
    assert {(r.rel_path, r.framework) for r in code.frameworks(f).collect()} == {("a.py", "flask"), ("b.js", "express"), ("c.go", "gin")}
    got = {(r.method, r.route, r.guarded) for r in code.routes(corpus.lines(f, ["project", "rel_path"])).collect()}
    assert got == {("ANY", "/x", True), ("GET", "/y/:id", False), ("POST", "/z", False)}


def test_manifests(spark):
    f = files(
        spark,
        ("a/go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/c v0.1.0 // indirect\n)\n"),
        ("b/package.json", '{"dependencies": {"l": "^4.1.0"}, "devDependencies": {"j": "~2.0.0", "k": ">=3"}}'),
        ("c/requirements.txt", "flask==2.0\nrequests>=2.1 # x\ndjango\n-r other.txt\n"),
        ("d/Cargo.toml", '[package]\nname = "x"\nversion = "1"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n'),
        ("e/package.json", '{"dependencies": {"gone": "1"}}'),
        ("e/package-lock.json", '{"packages": {"": {"version": "0"}, "node_modules/m": {"version": "5.0"}}, "dependencies": {"m": {"version": "4"}, "n": {"version": "6"}}}'),
        ("f/Cargo.lock", '[[package]]\nname = "q"\nversion = "7.0"\n\n[[package]]\nname = "r"\nversion = "8.0"\n'),
        ("g/package.json", "{broken"),
    )
    got = {(r.name, r.version) for r in manifests.dependencies(f).collect()}
    assert got == {("github.com/a/b", "v1.2.3"), ("golang.org/x/c", "v0.1.0"), ("l", "4.1.0"), ("j", "2.0.0"), ("k", "3"), ("flask", "2.0"), ("requests", "2.1"), ("django", "unknown"), ("serde", "1.0"), ("tokio", "1.2"), ("m", "5.0"), ("n", "6"), ("q", "7.0"), ("r", "8.0")}


def test_suppression_files(spark):
    f = files(spark, ("a", '[{"rule_id": "R", "line": 3, "expires": "2026-01-02"}]'), ("b", '{"suppressions": [{"file": "x.py"}, {"reason": "y"}, {"rule_id": "R", "expires": "soon"}]}'), ("c", ""))
    got = [(r.rule_id, r.file, r.line, r.problem) for r in baseline.suppressions_from_json(f).collect()]
    assert sorted(got, key=str) == sorted([("R", None, 3, None), (None, "x.py", None, None), (None, None, None, "neither rule nor file"), ("R", None, None, "bad date"), (None, None, None, "malformed")], key=str)


FINDING = "finding_key bigint, id string, rule_id string, project string, category string, severity string, title string, description string, file string, line int, col_no int, evidence string, confidence string, source string, sink string, data_flow array<string>, cwe string, detector_ids array<string>, evidences array<string>"


def finding(key, **kw):
    base = {"finding_key": key, "id": "I", "rule_id": "R", "project": "p", "category": "sourcecode", "severity": "LOW", "title": "t", "description": "d", "file": "f.py", "line": 1, "col_no": 1, "evidence": "some evidence of a length", "confidence": "LOW", "source": None, "sink": None, "data_flow": None, "cwe": None, "detector_ids": None, "evidences": None}
    return tuple((base | kw).values())


def test_detectors_of_one_line_merge(spark):
    rows = [
        finding(1, rule_id="VG-SEC-001", title="AWS Access Key", category="secret", severity="CRITICAL", file=".env", line=14, evidence="AKIA****"),
        finding(2, rule_id="VG-CFG-008", title="Hardcoded Secret in Configuration File", category="configuration", severity="critical ", file=".ENV", line=14, evidence="AWS_KEY=AKIA****", confidence="HIGH"),
        finding(3, rule_id="VG-CFG-008", title="Hardcoded Secret in Configuration File", category="configuration", severity="CRITICAL", file=".ENV", line=14, evidence="AWS_KEY=AKIA****"),
        finding(4, line=0), finding(5, line=0, title="u", rule_id="S"), finding(6, line=7),
    ]
    got = {r.base_key: r for r in findings.merged(spark.createDataFrame(rows, FINDING)).collect()}
    assert sorted(got) == [1, 4, 5, 6]
    m = got[1]
    assert (m.title, m.canonical_rule, m.confidence, m.evidence, m.detector_ids, m.related_findings, m.n) == ("Exposed AWS Credential", "VG-CANON-CRED-AWS", "HIGH", "AWS_KEY=AKIA****", ["VG-CFG-008", "VG-SEC-001"], ["I"], 2)
    assert findings.merged(spark.createDataFrame([], FINDING)).count() == 0


@pytest.mark.parametrize(
    ("rule", "title", "category", "want"),
    [("VG-AUTH-001", "Weak Password Hashing Algorithm", "sourcecode", "CRED-GENERIC"), ("VG-CFG-010", "JWT Signature Verification Disabled", "configuration", "CRED-JWT"), ("VG-CMD-LIST", "x", "sourcecode", "ARG-INJ"), ("VG-DCK-004", "Missing HEALTHCHECK", "docker", "DOCKER-HEALTH"), ("VG-SAST-010", "Debug Mode", "sourcecode", "CONFIG-DEBUG"), ("VG-SAST-006", "HTTP", "sourcecode", "GENERIC"), (None, None, None, "GENERIC")],
)
def test_canonical_classes(spark, rule, title, category, want):
    df = spark.createDataFrame([(rule, title, category)], "r string, t string, c string")
    assert one(df.select(findings.canonical_class(F.col("r"), F.col("t"), F.col("c")))) == "VG-CANON-" + want


def test_scores_and_gate(spark):
    rows = [finding(i, project=p, severity=s) for i, (p, s) in enumerate([("a", "CRITICAL"), ("b", "CRITICAL"), ("b", "HIGH"), ("b", "MEDIUM"), ("b", "LOW"), *[("c", "CRITICAL")] * 7, ("d", "LOW")])]
    got = {r.project: (r.score, r.gate, r.reasons) for r in findings.project_scores(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {"a": (85, "BLOCKED", "1 CRITICAL detected"), "b": (73, "BLOCKED", "1 CRITICAL and 1 HIGH detected"), "c": (0, "BLOCKED", "7 CRITICAL detected"), "d": (99, "PASSED", "")}


def test_confidence_stays_in_bounds(spark):
    rows = [finding(1, confidence="HIGH", severity="CRITICAL", source="a:1", sink="b:2", data_flow=["x", "y"]), finding(2, evidence=None), finding(3, confidence="HIGH", evidence="short")]
    got = {r.finding_key: (r.score, r.label) for r in findings.scored(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {1: (100, "HIGH"), 2: (5, "LOW"), 3: (55, "MEDIUM")}


def test_suppressions(spark):
    f = spark.createDataFrame([finding(1, id="R1", file="src/a.py", line=3), finding(2, id="R2", file="src/a.py", line=4), finding(3, id="R3", file="b.py")], FINDING)
    s = lambda *rows: spark.createDataFrame(rows, "project string, rule_id string, file string, line int, expires string")
    left = lambda *rows: {r.finding_key for r in findings.unsuppressed(f, s(*rows), "2026-06-01").collect()}
    assert left(("p", "R1", "a.py", None, None)) == {2, 3}
    assert left(("p", None, "src/a.py", 4, "2026-06-02")) == {1, 3}
    assert left(("p", "R1", None, 0, "2026-05-31")) == {1, 2, 3}
    assert left(("q", "R1", None, None, None)) == {1, 2, 3}
    assert left() == {1, 2, 3}


def test_chains(spark):
    rows = [finding(1, title="sql a", source="x:1", sink="y:1", file="a.py"), finding(2, title="sql b", source="x:1", sink="x:2", file="b.py"), finding(3, title="sql c", file="d/c.py"), finding(4, title="sql d", file="e/c.py"), finding(5, title="xss cross-site", source="x", sink="x", file="a.py")]
    got = {(r.vuln_class, r.file): (r.n, r.cross_file) for r in findings.chains(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {("SQL Injection", None): (2, True), ("SQL Injection", "c.py"): (2, False), ("Cross-Site Scripting", "a.py"): (1, False)}


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([finding(1, title="<script>", severity="HIGH", cwe="CWE-89", line=0, data_flow=["a"]), finding(2, cwe="CWE-79")], FINDING)
    r = {x.finding_key: json.loads(x.result) for x in reports.sarif_results(f).collect()}
    assert r[1]["level"] == "error" and r[1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1 and r[1]["message"]["text"].startswith("<script>: d [CWE-89]\nData Flow")
    assert [(x.rule, x.tags) for x in reports.sarif_rules(f).collect()] == [("R", "security,sourcecode,CWE-89,A03:2021-Injection")]
    assert "<script>" not in reports.html_rows(f).first().row
    reports.write_report(f, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/findings")).count() == 2 and spark.read.text(str(tmp_path / "r/sarif")).count() == 2
    parts = sorted((tmp_path / "r/sarif-document").glob("part-*.txt"))
    d = json.loads("".join(x.read_text() for x in parts))["runs"][0]
    assert [x["ruleId"] for x in d["results"]] == ["R", "R"] and [x["id"] for x in d["tool"]["driver"]["rules"]] == ["R"]
    nothing = reports.sarif_document(f.limit(0)).orderBy("part", "key", "text").collect()
    assert json.loads("".join(x.text for x in nothing))["runs"][0]["results"] == []


def test_nested_documents(spark):
    docs = {
        1: {"id": "A", "affected": {"package": {"name": "n"}, "ranges": {"events": {"introduced": 0}}}},
        2: [None, {"Affected": [{"Ranges": [{"type": "GIT", "Events": [{"fixed": "1.10"}, {"limit": "2"}, None, {"introduced": "", "last_affected": "3"}]}]}], "database_specific": {"affected": [{"ranges": [{"events": [{"fixed": "9"}]}]}]}}],
        3: {"vulns": [{"affected": [{"ranges": [{"events": [{"fixed": 1.5}]}]}]}]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(4, json.dumps(json.dumps(docs[3]))), (5, '{"id":'), (6, ""), (7, None), (8, "3"), (9, json.dumps(docs[3]) + " x"), (10, "null"), (11, '{"affected":[{"ranges":[{"events":[{"fixed":1.10}]}]}]}')]
    raw = spark.createDataFrame(rows, "raw_id bigint, payload string").withColumn("state", F.lit("clash"))
    got = {tuple(r) for r in nested.version_bounds(raw).collect()}
    assert got == {(1, 0, 0, 0, 0, "introduced", "0"), (2, 1, 0, 0, 0, "fixed", "1.10"), (2, 1, 0, 0, 3, "last_affected", "3"), (3, 0, 0, 0, 0, "fixed", "1.5"), (4, 0, 0, 0, 0, "fixed", "1.5"), (11, 0, 0, 0, 0, "fixed", "1.10")}
    t = nested.flat_tables(raw)
    assert t["vulnerabilities"].where("raw_id = 2").count() == 2 and t["events"].count() == 8 and t["events_other"].count() == 2
    states = {r.state for r in t["ranges"].collect()}
    assert "range(events=event(introduced))" in states and "range(type,events=[event(),event(fixed),event(last_affected),null])" in states
    assert nested.version_bounds(raw.limit(0)).count() == 0


def test_documents_of_odd_form_are_read_like_regular_ones(spark):
    fix = {"ranges": [{"events": [{"fixed": "1"}]}]}
    odd = [{"affected": "x"}, {"affected": [fix, 3, None]}, {"affected": [[fix]]}, {"id": {"a": 1}, "affected": fix}, {"aliases": "A", "affected": [fix]}, {"vulns": {"affected": fix}}, {"affected": [{"package": "p", **fix}], "rangesForm": "array"}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(odd)]
    deep = "[" * 20_000 + "]" * 20_000
    rows += [(10, json.dumps({"affected": [fix]})[:-1] + f', "database_specific": {deep}}}'), (11, json.dumps({"affected": [fix]})[:-1] + f', "database_specific": {deep[:-1]}}}'), (12, "[" * 700 + "1 2" + "]" * 700), (13, '{"a": ' * 700 + "1" + "}" * 700)]
    raw = spark.createDataFrame(rows, "raw_id bigint, payload string")
    got = {(r.raw_id, r.affected_pos) for r in nested.version_bounds(raw).collect()}
    assert got == {(1, 0), (3, 0), (4, 0), (5, 0), (6, 0), (10, 0)}
    form = {r.raw_id: (r.envelope, [v.state for v in r.vulns]) for r in nested.classified(raw).collect()}
    assert form[0] == ("one", ["vuln(affected=null)"]) and form[2] == ("one", ["vuln(affected=[alien])"]) and form[5] == ("vulns", ["vuln(affected=affected(ranges=[range(events=[event(fixed)])]))"])
    assert form[12][0] == "none" and form[11][0] == "none" and form[13] == ("one", ["vuln(affected=null)"])
    assert form[1][1] == ["vuln(affected=[affected(ranges=[range(events=[event(fixed)])]),alien,null])"]


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    assert baseline.ScanSettings.load(str(p)) == baseline.ScanSettings()
    p.write_text('{"scan_mode": "changed", "block_on": ["LOW"], "other": 1}')
    assert baseline.ScanSettings.load(str(p)).block_on == ("LOW",)
    p.write_text('{"scan_mode": "x"}')
    with pytest.raises(ValueError):
        baseline.ScanSettings.load(str(p))
