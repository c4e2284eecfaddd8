"""Rules on code facts, evidence tiers, secret scores, streams and small sources."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import code, sca, semantic
from siftline.sources import corpus
from siftline.streaming import streams


def facts(spark, text, path="a.py"):
    return code.facts(spark.createDataFrame([("p", path, text)], "project string, rel_path string, content string"))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('    os.system("ls")\n', None),
        ('    os.system("ls" + " -l")\n', None),
        ("    c = 'ls'\n    os.system(c)\n", None),
        ("    c = shlex.quote(x)\n    os.system(c)\n", None),
        ('    c = request.args.get("c")\n    os.system(c)\n', ("VG-CMD-001", "CRITICAL", "HIGH")),
        ("    os.system(x)\n", ("VG-CMD-001", "HIGH", "MEDIUM")),
        ('    os.system("ls " + x)\n', ("VG-CMD-001", "CRITICAL", "HIGH")),
        ('    subprocess.run(f"ls {x}")\n', ("VG-CMD-001", "HIGH", "HIGH")),
        ("    subprocess.run(x, shell=True)\n", ("VG-CMD-001", "HIGH", "MEDIUM")),
        ("    subprocess.run(x)\n", ("VG-CMD-001", "LOW", "LOW")),
        ('    cursor.execute("SELECT 1 WHERE a = %s", (x,))\n', None),
        ('    cursor.execute(f"SELECT {x}")\n', ("VG-SQL-001", "CRITICAL", "HIGH")),
        ('    cursor.execute("SELECT " + str(1))\n', ("VG-SQL-001", "CRITICAL", "HIGH")),
        ("    cursor.execute(int(x))\n", None),
        ("    requests.get(x)\n", ("VG-SSRF-001", "HIGH", "MEDIUM")),
        ("    ok = x in ALLOWED_HOSTS\n    requests.get(x)\n", None),
        ("    open(user_path)\n", ("VG-PATH-001", "HIGH", "MEDIUM")),
        ('    open("../" + name)\n', ("VG-PATH-001", "CRITICAL", "HIGH")),
        ("    user_path = os.path.basename(user_path)\n    open(user_path)\n", None),
        ("    open(config_path)\n", None),
    ],
)
def test_rules_on_calls(spark, body, want):
    got = [(r.rule_id, r.severity, r.confidence) for r in semantic.semantic_hits(facts(spark, "def f(x, user_path):\n" + body)).collect()]
    assert got == ([want] if want else [])


def test_markup(spark):
    rows = [(1, "el.innerHTML = name;"), (2, 'el.innerHTML = "<b>x</b>";'), (3, "el.innerHTML = DOMPurify.sanitize(x);"), (4, "document.write(x)"), (5, "a.innerHTML == b"), (6, None)]
    got = {r.line_no for r in semantic.raw_html_hits(spark.createDataFrame(rows, "line_no int, line string").withColumn("k", F.lit(1)), ["k"]).collect()}
    assert got == {1, 4}


def test_scopes(spark):
    x = facts(spark, "a = g()\ndef f(x):\n    b = h(x)\n\ndef k():\n    def m():\n        c = 1\n    d = 2\n")
    got = {(r.name, r.scope) for r in semantic.enclosing_functions(x).where("kind = 'assign'").collect()}
    assert got == {("a", ""), ("b", "f"), ("c", "k"), ("d", "k")}


def test_tiers(spark):
    rows = [(True, True, True, False, False, "confirmed"), (True, False, True, False, False, "potential"), (True, True, True, True, False, "informational"), (False, False, True, False, False, "potential"), (False, False, False, False, False, "informational"), (True, True, True, False, True, "informational")]
    df = spark.createDataFrame(rows, "s boolean, f boolean, k boolean, c boolean, l boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", semantic.evidence_tier(*(F.col(c) for c in "sfkcl"))).collect())


def test_secret_scores(spark):
    rows = [(1, ".env", 'API_KEY="a1b2!c3d4"'), (2, "a.py", 'password = "x9$kk2"'), (3, "doc.md", '# password = "example"'), (4, "a.py", 'if password == "x":'), (5, "tests/a.py", 'token = "example"'), (6, "a.py", "x = 1"), (7, None, None)]
    got = {r.k: (r.score, r.label) for r in semantic.secret_scores(spark.createDataFrame(rows, "k int, rel_path string, line string").withColumn("line_no", F.lit(1)), ["k", "rel_path"]).collect()}
    assert got == {1: (100, "HIGH"), 2: (95, "HIGH")}


def test_refs(spark):
    z, a, b = "0" * 40, "a" * 40, "b" * 40
    rows = [(f"refs/heads/m {a} refs/heads/m {b}",), (f"(delete) {z} refs/heads/x {a}",), (f"r {a} r {a}",), (f" r\t{a} r {z} more",), ("too few",), ("",), (None,)]
    assert [r.action for r in corpus.push_refs(spark.createDataFrame(rows, "line string")).collect()] == ["update", "delete", "noop", "create"]


def test_store(spark, small, tmp_path):
    a = spark.read.parquet(f"{small}/advisories.parquet")
    sca.write_store(a, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/advisories")).count() == a.count()
    assert spark.read.json(str(tmp_path / "s/metadata")).first().n == a.count()


def test_upsert_keeps_the_last(spark):
    kind = "adv_key bigint, id string, loaded_at timestamp"
    at = spark.sql("SELECT timestamp'2026-01-01' a, timestamp'2026-02-01' b").first()
    old = spark.createDataFrame([(1, "A", at.b), (2, "B", at.a), (3, None, at.a)], kind)
    new = spark.createDataFrame([(4, "A", at.a), (5, "C", at.a), (6, "C", at.a)], kind)
    assert sorted(r.adv_key for r in sca.upserted(old, new).collect()) == [2, 4, 6]
    assert sorted(r.adv_key for r in sca.upserted(old.limit(0), new).collect()) == [4, 6]


def test_cache_states(spark):
    kind = "eco string, pkg string, version string, cached_at timestamp"
    t = spark.sql("SELECT timestamp'2026-01-01 12:00:00' a, timestamp'2025-12-01' b").first()
    cache = spark.createDataFrame([("npm", "a", "1", t.a), ("npm", "a", "1", t.b), ("npm", "b", "1", t.b)], kind)
    want = spark.createDataFrame([("npm", p, "1") for p in "abc"], "eco string, pkg string, version string")
    got = {r.pkg: (r.state, len(r.cache_key)) for r in sca.cache_lookup(want, cache, "2026-01-02").collect()}
    assert got == {"a": ("fresh", 24), "b": ("stale", 24), "c": ("missing", 24)}
    assert {r.pkg: r.state for r in sca.cache_lookup(want, cache, "2026-01-02", offline=True).collect()} == {"a": "fresh", "b": "fresh", "c": "missing"}
    saved = sca.cache_saved(cache, want.where("pkg <> 'a'").withColumn("cached_at", F.to_timestamp(F.lit("2026-01-02"))))
    assert {r.pkg: r.state for r in sca.cache_lookup(want, saved, "2026-01-02").collect()} == {"a": "fresh", "b": "fresh", "c": "fresh"} and saved.count() == 3


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS k, timestamp'2026-01-01' + make_dt_interval(0, cast(id AS int)) AS at FROM range(30)")
    rows.repartition(5).write.parquet(str(tmp_path / "t.parquet"))
    s = lambda: streams.stream_table(spark, str(tmp_path), "t", files=2)
    assert streams.drained(streams.first_seen(s(), "k", "at"), "first", "append").count() == 3
    assert {r.n for r in streams.drained(streams.windowed_counts(s(), "at", "k", "6 hours"), "win").collect()} == {2}
    whole = {tuple(r) for r in streams.drained(streams.windowed_counts(s(), "at", "k", "6 hours"), "win").collect()}
    assert {tuple(r) for r in streams.drained(streams.windowed_counts(s(), "at", "k", "6 hours"), "upd", "update", ("window_start", "k")).collect()} == whole
    seen = []
    streams.each_batch(s(), "each", lambda df, no: seen.append(df.count()))
    assert sum(seen) == 30 and len(seen) > 1
    empty = streams.drained(streams.first_seen(s().where("k > 5"), "k", "at"), "none", "append")
    assert empty.count() == 0


def test_snapshot_and_diff(spark, tmp_path):
    import subprocess

    from siftline.operators.lexical import diff_secrets
    from siftline.sources import repository

    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    (repo / "a.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-qm", "1")
    first = git("rev-parse", "HEAD")
    (repo / "b.py").write_text('password = "hunter22"\nkey = "' + "AKIA" + "A" * 16 + '"\n')
    git("add", "."), git("commit", "-qm", "2")
    second = git("rev-parse", "HEAD")
    assert [r.rel_path for r in repository.snapshot(spark, str(repo), first, str(tmp_path / "s")).collect()] == ["a.py"]
    assert repository.pushed_files(str(repo), second, first) == ["b.py"] and repository.pushed_files(str(repo), first, repository.ZERO) == ["a.py"]
    d = corpus.lines(spark.createDataFrame([(1, repository.pushed_diff(str(repo), second, first))], "ref int, content string"), ["ref"])
    got = {(r.file, r.title, r.evidence) for r in diff_secrets(corpus.diff_added(d, "ref"), ["ref"]).collect()}
    assert got == {("b.py", "Password Assignment in Pushed Commit", "password****"), ("b.py", "AWS Access Key in Pushed Commit", 'key = "A****')}


def test_ignored_files_and_excludes(spark):
    rows = [("p", ".gitignore", "# x\n/build/\n*.log\nsecret.txt\n!keep\n\n"), ("p", "build/a/b.py", ""), ("p", "x/run.log", ""), ("p", "d/secret.txt", ""), ("p", "d/keep.py", ""), ("q", "build/a.py", ""), ("p", None, "")]
    f = spark.createDataFrame(rows, "project string, rel_path string, content string")
    assert {r.rel_path for r in corpus.ignored(f, corpus.ignore_patterns(f)).collect()} == {"build/a/b.py", "x/run.log", "d/secret.txt"}
    assert corpus.effective_excludes(["tests", "docs", "*.md", "x"], include_tests=True) == ["docs", "*.md", "x"]
    assert corpus.effective_excludes(["tests", "docs", "*.md", "x"], include_docs=True) == ["tests", "x"]


def test_config_fallback_to_ini(spark):
    from siftline.operators import configs

    f = spark.createDataFrame([("p", "a.yaml", "debug=true\n"), ("p", "config.rb", "host = 0.0.0.0\n"), ("p", "other.rb", "debug = true\n")], "project string, rel_path string, content string")
    assert {(r.rel_path, r.rule_id) for r in configs.config_hits(configs.entries(f)).collect()} == {("a.yaml", "VG-CFG-001"), ("config.rb", "VG-CFG-003")}


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from siftline import session

    df = session.written(spark.range(3), "t")
    path = session._PATHS[-1].removeprefix("file:").replace("//", "/")
    assert df.count() == 3 and Path(path).exists()
    keep, session._PATHS[:] = session._PATHS[:-1], session._PATHS[-1:]
    session.drop_tables(spark)
    session._PATHS[:] = keep
    assert not Path(path).exists()
