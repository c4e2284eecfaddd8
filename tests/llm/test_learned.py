"""Credentials, packing, blending and stuffed pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import credentials, mixture, packing, stuffing, tokens

AWS = "AKIA" + "Q7ZD2MWXK4PLT8RB"
GH = "ghp_" + "a8Kd92LmQx71ZpVb33TnWe5RyU0oIc6HsJfG"
PEM = "-----BEGIN " + "EC PRIVATE KEY-----"
PUB = "-----BEGIN " + "PUBLIC KEY-----"

SPOTS = [
    (f'key = "{AWS}"', [1]),
    (f'x = 1\n  tmp := "{GH}"\n', [2]),
    ('API_KEY="' + GH[:12] + '" + "' + GH[12:] + '"', [1]),
    ('api_key = (\n    "' + GH[:12] + '"\n    "' + GH[12:] + '"\n)', [2]),
    ("- name: DB_PASSWORD\n  value: 'hunter2x!9'", [2]),
    ("dsn = 'postgres://joe:s3cretpw@db.internal:5432/x'", [1]),
    ("dsn = 'postgres://${U}:${P}@db.internal/x'", []),
    ("dsn = 'postgres://joe:****@db.internal/x'", []),
    ('conn = "Server=a;Database=b;User Id=c;Password=abc1234;"', [1]),
    ("psql -c \"CREATE USER joe WITH PASSWORD 'abc1234!'\"", [1]),
    (f"pem: |\n  {PEM}\n  AAAA\n  BBBB\n  -----END EC PRIVATE KEY-----\nx: 1", [2]),
    (f"{PUB}\nAAAA\n-----END PUBLIC KEY-----", []),
    ('password = os.environ["PASSWORD"]', []),
    ('password = "<your-password>"', []),
    ('token = "AKIAQ7ZD****"', []),
    ('sha256 = "57dd79abbcb2c108774ed243718f710eacf2715e0af8a5d076cdf9d7284a4ac0"', []),
    ('password_label = "Password"', []),
    ("curl -s -u joe:'Pa55word!' https://x.test", [1]),
    ("machine a.test login joe password S3cret99", [1]),
    ("", []),
]


def training(spark):
    r = random.Random(1)
    alnum = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    rnd = lambda n: "".join(r.choices(alnum, k=n))
    rows = []
    for i in range(240):
        rows += [
            f'{r.choice(["api_key", "token", "secret_key", "tmp"])} = "ghp_{rnd(36)}"', f'password = "{rnd(9)}!{r.randint(1, 99)}"', f"conn = 'mysql://u{i}:{rnd(8)}@h{i}.test/x'",
            f'c = "Server=h;Database=d;User Id=u;Pwd={rnd(8)};"', f"CREATE USER u{i} IDENTIFIED BY '{rnd(8)}'", f"machine h{i}.test login u password {rnd(9)}", f"curl -u u{i}:'{rnd(9)}' https://h.test", f"{PEM}\n{rnd(64)}\n-----END EC PRIVATE KEY-----",
            f'{r.choice(["cache", "queue", "folder"])}_{i} = "value{i}"', f'sha256 = "{"".join(r.choices("0123456789abcdef", k=64))}"', 'password_file = "/run/secrets/x"', 'token = "${TOKEN}"', 'secret = "changeme"', f'password = "{rnd(4)}****"', 'token_type = "bearer"', f"def f{i}(a, b):",
        ]
    return spark.createDataFrame([(i, "a/b.py", t) for i, t in enumerate(rows)], "finding_key bigint, file string, evidence string")


@pytest.fixture(scope="module")
def model(spark):
    files = spark.createDataFrame([], "file_key bigint, rel_path string, content string")
    cands = credentials.extracted(credentials.texts(training(spark), files))
    return credentials.train(cands), cands


@pytest.mark.parametrize(("text", "lines"), SPOTS)
def test_spots(spark, model, text, lines):
    m, _ = model
    c = [x for x in credentials.candidates(text) if credentials.weak_label(*x[3:]) not in credentials.RULED_OUT]
    p = m.score(np.array([x[3] for x in c], object), np.array([x[4] for x in c], object), np.array([x[5] for x in c], object), np.array(["x.py"] * len(c), object))
    assert sorted({x[0] for x, s in zip(c, p, strict=True) if s >= credentials.CUT}) == lines


KEY = "MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEA"
CRT, CRT_END = "-----BEGIN " + "CERTIFICATE-----", "-----END " + "CERTIFICATE-----"
NAMED = "DB_PASSWORD = 'hunter2x!9'"


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        (f"if x.startswith('{CRT}'):\n    check(x)\n{NAMED}\n", [3]),  # a header that no block follows
        (f"{PEM}\n{KEY}\n{KEY}\nab=\n{NAMED}\n", [1, 5]),  # a key without its end
        (f" * {PEM}\n * {KEY}\n * ab=\n{NAMED}\n", [1, 4]),
        (f"a = '{CRT}{KEY}{CRT_END}'; {NAMED}", [1]),  # a value beside a public block
        (f"a = `{CRT}\n{KEY}\n{CRT_END}`; {NAMED}", [3]),
        (f"if x.startswith('{CRT}'):\n    {NAMED}\n    check(x, '{CRT_END}')", [2]),  # both ends in code
    ],
)
def test_what_stands_beside_a_block_is_found(spark, model, text, lines):
    test_spots(spark, model, text, lines)
    spans = [(x[1], x[2]) for x in credentials.candidates(text) if credentials.weak_label(*x[3:]).startswith("+")]
    out = credentials.redacted_text(text, spans)
    assert "DB_PASSWORD = '[REDACTED]'" in out and out.count("\n") == text.count("\n") and KEY not in out.replace(CRT + KEY, "").replace(f"{CRT}\n{KEY}", "")


def test_held_out_accuracy(spark, model):
    _, cands = model
    odd, even = cands.where("row_key div 16 % 2 = 1"), cands.where("row_key div 16 % 2 = 0 AND stratum <> ''")
    m = credentials.train(odd).score(*(even.toPandas()[c].to_numpy() for c in ("key", "value", "kind", "path")))
    y = even.toPandas()["stratum"].str.startswith("+").to_numpy()
    assert ((m >= 0.5) == y).mean() > 0.98


def test_redaction_leaves_the_rest(spark, model):
    text = f'a = 1\nkey = "{AWS}"\n{PEM}\nAAAA\n-----END EC PRIVATE KEY-----\nb = 2'
    spans = [(x[1], x[2]) for x in credentials.candidates(text) if credentials.weak_label(*x[3:]).startswith("+")]
    out = credentials.redacted_text(text, spans)
    assert out == 'a = 1\nkey = "[REDACTED]"\n[REDACTED]\n\n\nb = 2'
    assert credentials.redacted_text("abc", []) == "abc" and credentials.redacted_text("abcd", [(1, 3), (2, 3), (1, 2)]) == "a[REDACTED]d"


def test_whole_tables_with_nulls_and_repeats(spark):
    f = training(spark)
    more = spark.createDataFrame([(9001, None, f'k = "{AWS}"'), (9002, "x", None), (None, "x", AWS), (9003, "y.py", "x" * 200_000 + f'\nk = "{AWS}"'), (9004, "y.py", "")], f.schema)
    files = spark.createDataFrame([(1, "c.env", f'TOKEN="{GH}"\r\nX=1\r\n'), (1, "c.env", f'TOKEN="{GH}"\r\nX=1\r\n')], "file_key bigint, rel_path string, content string")
    found = credentials.credential_lines(f.unionByName(more).withColumn("key", F.lit("clash")), files.withColumn("value", F.lit(1)))
    got = {(r.tbl, r.row_key, r.line_no) for r in found.where("row_key > 9000 OR tbl = 'source_files'").collect()}
    assert got == {("findings", 9001, 1), ("findings", 9003, 2), ("source_files", 1, 1)}
    assert credentials.credential_lines(f.limit(0), files.limit(0)).count() == 0


def test_tokens(spark):
    d = spark.createDataFrame([(1, "hello world", "s"), (2, "", "s"), (3, None, "s"), (None, "x", "s"), (4, "ab " * 150_000, "s")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.tokens for r in tokens.sized(d, keep=("source",)).collect()}
    assert got[1] == 2 and got[2] == 0 and set(got) == {1, 2, 4}
    assert abs(got[4] - 150_001) <= 3  # cut into pieces, but counted whole


@pytest.mark.parametrize("seed", range(4))
def test_local_search_never_overfills_and_comes_close(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 400, 600)
    where = packing.fill_bins(sizes, 512)
    fill = np.bincount(where, weights=sizes)
    assert fill.max() <= 512 and len(where) == 600
    assert len(np.unique(where)) <= 1.02 * -(-sizes.sum() // 512) + 1


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = np.array([6, 5, 4, 3, 3, 3])
    worse = np.array([0, 1, 2, 0, 1, 2])  # 9, 8, 7 of 12: two bins are enough
    assert len(np.unique(packing.improve(sizes, worse.copy(), 12))) == 2


def test_pack(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([0, 1, 50, 100, 333, 512, 513, 2000, r.randint(1, 511)])) for i in range(900)]
    d = spark.createDataFrame([*sizes, (9999, None)], "doc_id bigint, tokens int").withColumns({"bin": F.lit("clash"), "shard": F.lit(1)}).select("doc_id", "tokens", "bin", "shard")
    limits = spark.createDataFrame([("s", 512), ("s", 600), ("l", 2048), (None, 5), ("z", 0), ("n", None)], "limit_name string, capacity_tokens int")
    rows = packing.pack(d.select("doc_id", "tokens"), limits, shard_items=200).collect()
    for name, cap in (("s", 512), ("l", 2048)):
        bins, docs, cut = {}, {}, {}
        for x in (x for x in rows if x.limit_name == name):
            bins[x.bin] = bins.get(x.bin, 0) + x.tokens
            docs[x.doc_id] = docs.get(x.doc_id, 0) + x.tokens
            cut[x.doc_id] = cut.get(x.doc_id, 0) + 1
        assert docs == dict(sizes) and max(bins.values()) <= cap
        assert all(cut[k] == max(1, -(-t // cap)) for k, t in sizes)
        assert len(bins) <= 1.03 * -(-sum(t for _, t in sizes) // cap) + 2
    assert packing.pack(d.limit(0).select("doc_id", "tokens"), limits).count() == 0
    assert packing.pack(d.select("doc_id", "tokens"), limits.limit(0)).count() == 0


def brute_exchange(sizes, where, capacity, b):
    """Whether moving one, or exchanging two for one either way, takes tokens out of container b into a fuller one."""
    fill = np.bincount(where, weights=sizes).astype(int)
    inside = [i for i in range(len(sizes)) if where[i] == b and sizes[i]]
    others = [i for i in range(len(sizes)) if where[i] != b and sizes[i] and fill[where[i]] >= fill[b]]
    gap = capacity - fill
    fits = lambda gain, a: 0 < gain <= gap[a]
    one = any(fits(sizes[x], a) for x in inside for a in range(len(fill)) if a != b and fill[a] >= fill[b] and gap[a] > 0)
    swap = any(fits(sizes[x] - sizes[y], where[y]) for x in inside for y in others)
    go = any(fits(sizes[x] + sizes[z] - sizes[y], where[y]) for i, x in enumerate(inside) for z in inside[i + 1 :] for y in others)
    back = any(fits(sizes[x] - sizes[y] - sizes[z], where[y]) for x in inside for i, y in enumerate(others) for z in others[i + 1 :] if where[y] == where[z])
    return one or swap or go or back


def test_search_ends_only_where_no_exchange_helps():
    r = np.random.default_rng(9)
    for _ in range(60):
        capacity = int(r.integers(20, 60))
        sizes = r.integers(1, capacity // 2, int(r.integers(8, 24)))
        where = packing.fill_bins(sizes, capacity)
        fill = np.bincount(where, weights=sizes, minlength=where.max() + 1)
        assert fill.max() <= capacity
        for b in np.flatnonzero(fill):
            w, f = where.copy(), np.bincount(where, weights=sizes).astype(np.int64)
            assert packing._step(sizes, w, f, capacity, int(b)) == brute_exchange(sizes, where, capacity, b)
            assert f.max() <= capacity and (np.bincount(w, weights=sizes, minlength=len(f)) == f).all()


def test_equal_rows_are_packed_apart(spark):
    d = spark.createDataFrame([(1, 25), (1, 25), (1, None)], "doc_id bigint, tokens int")
    limits = spark.createDataFrame([("s", 10)], "limit_name string, capacity_tokens int")
    got = packing.pack(d, limits).groupBy("bin").agg(F.sum("tokens").alias("t")).collect()
    assert sorted(x.t for x in got) == [10] * 5


def test_blend(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["a", "a", "a", "b", "c"]), r.randint(1, 300)) for i in range(3000)] + [(5000, None, 10), (5001, "a", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens int")
    t = spark.createDataFrame([("m", "A ", 0.5, 2), ("m", "b", 0.3, 3), ("m", "c", 0.2, 1), ("k", "a", 0.9, 1), ("k", "nowhere", 0.1, 1), (None, "a", 1.0, 1), ("m", "a", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    out = mixture.blend(d, t, 256).cache()
    used = {}
    for x in out.collect():
        used[x.mix_name, x.doc_id] = used.get((x.mix_name, x.doc_id), 0) + 1
    most = {"m": {"a": 2, "b": 3, "c": 1}, "k": {"a": 1}}
    source = {i: s for i, s, _ in docs}
    assert all(n <= most[m][source[i]] for (m, i), n in used.items())
    got = {(x.mix_name, x.source): x for x in mixture.shares(out, t).collect()}
    assert all(abs(got["m", s].actual_share - w) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert got["k", "nowhere"].tokens == 0 and got["k", "a"].actual_share == 1.0 and got["m", "c"].most_copies == 1
    total = sum(k for _, s, k in docs if s == "c")
    assert got["m", "c"].tokens > 0.95 * total  # the scarcest source is used up
    assert mixture.blend(d.limit(0), t).count() == 0 and mixture.blend(d, t.limit(0)).count() == 0


def test_running_total(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, i // 7, r.randint(0, 9)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, i int, c int, v int")
    got = {(x.g, x.i): x.t for x in mixture.running_total(df, ["g"], "c", ["i"], "v", "t").collect()}
    for g in "ab":
        s = 0
        for x in sorted(x for x in rows if x[0] == g):
            assert got[g, x[1]] == s
            s += x[3]


PROSE = [
    "We moved the cache check ahead of the queue so that a slow worker no longer reaches the index.", "Nobody on the team had looked at the old router since the service was split off last year.",
    "If the table is larger than 40 entries, load it in smaller pieces before you start the next run.", "Users of the early build should upgrade, because the older parser trusts any header it is given.",
    "It took us almost nine minutes to restore the volume, and the report was back on the desk before noon.", "Please note that the default of ten seconds is enough for most of the setups that we have seen.",
]


def page(r, n):
    return "\n\n".join(" ".join(r.choices(PROSE, k=3)) for _ in range(n))


def corpus(spark):
    r = random.Random(4)
    spam = [
        " ".join(r.choices(["cheap firewall", "best scanner", "buy vpn client"], k=120)),
        "\n".join(f"- [free scanner](http://x{i}.test/a)" for i in range(40)),
        " ".join(f"#tag{r.randint(1, 9)}" for _ in range(100)),
        page(r, 1) + "\n\n" + ", ".join(f"Zork scanner X{i}" for i in range(200)),
    ]
    good = [page(r, r.randint(2, 6)) for _ in range(60)] + [
        "import os\n\ndef f(a):\n    return a + 1\n\nclass B:\n    x = 3\n" * 8,
        "HIGH  VG-1  a/b.py:3  Query text built\n" * 30,
        page(r, 4) + "\n\nKeywords: a, b, c, d, e, f, g, h, i",
        page(r, 3) + "\n\n" + "\n".join(f"- [n{i}](http://x.test/{i}): {PROSE[i % 6]}" for i in range(9)),
        "", " \n", "one",
    ]
    rows = [(i, t, r.choice(["en", "en", None])) for i, t in enumerate(spam + good)]
    return spark.createDataFrame([*rows, (9998, None, "en"), (None, spam[0], "en")], "doc_id bigint, text string, lang string"), len(spam)


def test_stuffed_pages(spark):
    df, n = corpus(spark)
    df = df.withColumns({"word": F.lit(1), "n": F.lit(2), "rank": F.lit(3), "p": F.lit(4)})
    assert sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect()) == list(range(n))
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0
    c = {r.doc_id: r for r in stuffing.page_curves(df).collect()}
    assert c[0].slope > -0.5 and c[0].n_types == 7 and c[0].z_divergence > 3
    assert not stuffing.page_curves(df.limit(0)).count()


def test_curve_of_known_counts(spark):
    rows = spark.createDataFrame([(1, "en", "a " * 8 + "b " * 4 + "c " * 2 + "d")], "doc_id bigint, lang string, text string")
    model = spark.createDataFrame([("a", ["en"], True), ("b", [""], False), ("c", ["de"], False)], "word string, langs array<string>, common boolean")
    r = stuffing.curves(rows, model).first()
    x, y = np.log([1, 2, 3, 4]), np.log([8, 4, 2, 1])
    slope, cut = np.polyfit(x, y, 1)
    u = 3 / 15  # c belongs to another language, d to none
    assert r.slope == pytest.approx(slope) and r.residual == pytest.approx(np.sqrt(((y - slope * x - cut) ** 2).mean()))
    assert r.divergence == pytest.approx(u * np.log(u / 0.01) + (1 - u) * np.log((1 - u) / 0.99))
    assert stuffing.curves(rows.withColumn("lang", F.lit("?")), model).first().divergence == pytest.approx(np.log(1 / 15 / 0.01) / 15 + 14 / 15 * np.log(14 / 15 / 0.99))


def test_fences_and_ends():
    common = frozenset("it took us to the and a of on".split())
    links = "\n".join(f"[scanner](http://x.test/{i})" for i in range(20))
    assert stuffing.stuffed_share(f"```\n{links}\n```", common) == 0  # what is fenced is code
    assert stuffing.stuffed_share(f"x = 1\n```\n{links}", common) > 0.9  # a fence that none follows
    assert stuffing.stuffed_share(f"```\na = 1\n```\n{links}\n```\n", common) > 0.9
    assert [stuffing.ends(x) for x in ("Done.", "done (#12)", "Done. (#12)", 'Done!" ) ', "so:", "a.b", "", "." + " " * 5000)] == [True, False, True, True, True, False, False, True]
