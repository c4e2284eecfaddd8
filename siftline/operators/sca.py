"""Dependencies against advisories: lookup, version ranges, severity, fixes and the upkeep of the advisory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.versions import clean_version, is_vulnerable, version_parts


def package_key(ecosystem: str, name: str) -> tuple[Column, Column]:
    """Ecosystem and name as they are compared: case and outer blanks aside."""
    return F.lower(F.trim(ecosystem)), F.lower(F.trim(name))


def _versioned(deps: DataFrame, *more: str) -> DataFrame:
    """Dependencies as they are compared: (eco, pkg, name, version, ecosystem, source_file) and `more` columns."""
    eco, pkg = package_key("ecosystem", "name")
    v = F.when(clean_version("version") != "", F.trim("version"))
    return deps.where("name IS NOT NULL AND ecosystem IS NOT NULL").select(eco.alias("eco"), pkg.alias("pkg"), "name", F.coalesce(v, F.lit("unknown")).alias("version"), "ecosystem", "source_file", *more)


def distinct_deps(deps: DataFrame) -> DataFrame:
    """(eco, pkg, name, version, ecosystem, source_file): one row for each package, version and ecosystem, the first source file and spelling by order."""
    return _versioned(deps).groupBy("eco", "pkg", "version").agg(F.min(F.struct("source_file", "name", "ecosystem")).alias("x")).select("eco", "pkg", "version", "x.name", "x.ecosystem", "x.source_file")


def places(deps: DataFrame) -> DataFrame:
    """(project, eco, pkg, version, source_file): where each package version is used; unknown files are 'dependencies'."""
    d = _versioned(deps, "project")
    return d.select(F.coalesce("project", F.lit("")).alias("project"), "eco", "pkg", "version", F.coalesce("source_file", F.lit("dependencies")).alias("source_file")).distinct()


def matches(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """(eco, pkg, version, adv_key, id, severity) of each distinct dependency and advisory that affects it.

    Advisories are looked up by ecosystem and name; a package that has none there takes those of its name in
    any ecosystem. An unknown version matches every one of them. Both lookups are equality joins; the version
    predicate is evaluated in the join's stage, on distinct dependencies.
    """
    d = distinct_deps(deps).select("eco", "pkg", "version")
    eco, pkg = package_key("ecosystem", "package")
    a = advisories.where("package IS NOT NULL AND ecosystem IS NOT NULL").select(eco.alias("eco"), pkg.alias("pkg"), "adv_key", "id", "severity", "ranges", "affected_versions", "fixed_versions")
    near = d.join(a, ["eco", "pkg"])
    lost = d.join(a.select("eco", "pkg").distinct(), ["eco", "pkg"], "left_anti")
    far = lost.join(a.drop("eco"), "pkg").select(near.columns)
    hit = (F.lower(clean_version("version")) == "unknown") | is_vulnerable(F.col("version"), F.col("ranges"), F.col("affected_versions"), F.col("fixed_versions"))
    return near.unionByName(far).where(hit).select("eco", "pkg", "version", "adv_key", "id", "severity")


def severity_of(score: Column, vector: Column, text: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW from a number, else a vector, else words of the text, else MEDIUM.

    The vector's parts are searched as texts, so that AC:H also counts as C:H and AC:L as C:L.
    """
    # Bounds, parts and words.
    v = F.upper(F.trim(vector))
    has = lambda *xs: _all(v, xs)
    by_vector = F.when(has("AV:N", "AC:L", "PR:N", "UI:N", "C:H", "I:H", "A:H"), "CRITICAL").when(has("C:H") | has("I:H") | has("A:H"), "HIGH").when(has("C:L") | has("I:L") | has("A:L"), "MEDIUM").otherwise("LOW")
    t = F.lower(F.coalesce(text, F.lit("")))
    word = lambda w: t.rlike(rf"(?:^|[^a-z0-9_])(?:{w})(?:[^a-z0-9_]|$)")
    by_text = F.when(word("rce|remote code execution"), "CRITICAL").when(word("injection|pollution|bypass|escalation"), "HIGH").when(word("xss|redirect|traversal|csrf|dos|ssrf"), "MEDIUM").when(word("disclosure"), "LOW").otherwise("MEDIUM")
    by_score = F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")
    return F.when(score.isNotNull(), by_score).when(F.startswith(v, F.lit("CVSS:")), by_vector).otherwise(by_text)


def _all(c: Column, texts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for x in texts:
        out = out & F.contains(c, F.lit(x))
    return out


def derived_severity(advisories: DataFrame) -> DataFrame:
    """(adv_key, severity, derived): the given severity and the one derived from score, vector and texts."""
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit("")))
    given = F.upper(F.trim("severity"))
    known = F.when(given.isin("CRITICAL", "HIGH", "LOW"), given).when(given.isin("MODERATE", "MEDIUM"), "MEDIUM")
    return advisories.select("adv_key", "severity", F.coalesce(known, severity_of(F.col("cvss_score"), F.col("cvss"), text)).alias("derived"))


def version_order(c: Column) -> Column:
    """An array that orders versions part by part: numbers by value and before words."""
    part = lambda p: F.struct(F.when(p.rlike("^[0-9]{1,18}$"), 0).otherwise(1).alias("k"), F.coalesce(F.when(p.rlike("^[0-9]{1,18}$"), p.try_cast("bigint")), F.lit(0)).alias("n"), p.alias("t"))
    return F.transform(version_parts(clean_version(c)), part)


def best_fixes(advisories: DataFrame) -> DataFrame:
    """(eco, pkg, best_fix): the highest fixed version in a package's SEMVER ranges, else in its ECOSYSTEM ranges."""
    eco, pkg = package_key("ecosystem", "package")
    f = advisories.where("package IS NOT NULL").select(eco.alias("eco"), pkg.alias("pkg"), F.explode("ranges").alias("r")).select("eco", "pkg", "r.range_type", F.explode("r.events").alias("e"))
    f = f.where("e.fixed <> '' AND range_type IN ('SEMVER', 'ECOSYSTEM')").select("eco", "pkg", "range_type", F.col("e.fixed").alias("fixed")).distinct()
    key = F.struct((F.col("range_type") == "SEMVER").cast("int"), version_order(F.col("fixed")), F.col("fixed"))
    return f.groupBy("eco", "pkg").agg(F.max_by("fixed", key).alias("best_fix"))


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "id", at: str = "loaded_at", tie: str = "adv_key") -> DataFrame:
    """The advisory table after an import: of each key the incoming row wins over the stored one, later ones over earlier ones. Null keys are left out."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).where(F.col(key).isNotNull())
    last = both.groupBy(key).agg(F.max(F.struct("_new", at, tie)).alias("w")).select(F.col(f"w.{tie}").alias(tie))
    return both.drop("_new").join(last, tie, "left_semi")


def stats(advisories: DataFrame) -> DataFrame:
    """(n, ids, packages, ecosystems): rows, distinct ids and packages, and the sorted names of the ecosystems."""
    eco, pkg = package_key("ecosystem", "package")
    return advisories.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(eco, pkg).alias("packages"), F.array_join(F.array_sort(F.collect_set(eco)), ",").alias("ecosystems"))


def top_advisories(found: DataFrame, k: int = 2) -> DataFrame:
    """(eco, pkg, place, id, severity, n): each package's k worst advisories and its number of affecting ones."""
    from siftline.operators.findings import clean_severity, severity_rank

    one = found.groupBy("eco", "pkg", "adv_key").agg(F.min("id").alias("id"), F.min("severity").alias("severity"))
    rank = severity_rank(clean_severity("severity"))
    w = Window.partitionBy("eco", "pkg")
    x = one.withColumn("place", F.row_number().over(w.orderBy(rank.desc(), "id", "adv_key"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where(F.col("place") <= k).select("eco", "pkg", "place", "id", "severity", "n")


def dep_findings(found: DataFrame, advisories: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches as findings: title, description of 200 characters at most, last fixed version, evidence with aliases, and the columns of `found` that are to be kept."""
    a = advisories.select("adv_key", "summary", "description", "fixed_versions", "aliases")
    text = F.coalesce("description", "summary", F.lit(""))
    last = F.try_element_at(F.filter("fixed_versions", lambda x: x != ""), F.lit(-1))
    j = found.join(a, "adv_key")
    return j.select(
        "adv_key",
        F.coalesce("id", F.lit("")).alias("rule_id"),
        F.lit("dependency").alias("category"),
        F.concat(F.lit("Vulnerable dependency "), "pkg", F.lit(" "), "version").alias("title"),
        F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text).alias("description"),
        F.lit(0).alias("line"),
        F.concat("pkg", F.lit("@"), "version", F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ("), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")).alias("evidence"),
        F.when(last.isNotNull(), F.concat(F.lit("Upgrade to >= "), last)).otherwise("Update package").alias("recommendation"),
        *keep,
    )


def cache_saved(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache (eco, pkg, version, cached_at, ...) after `results` were saved: of each identity the latest row of `results`, else of `cache`; ties go to the largest row."""
    cols = cache.columns
    both = cache.withColumn("_new", F.lit(0)).unionByName(results.select(cols).withColumn("_new", F.lit(1)))
    ident = ["eco", "pkg", "version"]
    rest = [c for c in cols if c not in (*ident, "cached_at")]
    last = both.groupBy(*ident).agg(F.max(F.struct("_new", "cached_at", *rest)).alias("w"))
    return last.select(*(c if c in ident else F.col(f"w.{c}").alias(c) for c in cols))


def cache_lookup(wanted: DataFrame, cache: DataFrame, as_of: str, hours: int = 24, offline: bool = False) -> DataFrame:
    """(eco, pkg, version, cache_key, state): fresh, stale or missing, by the latest cached row of each identity.

    Offline, whatever is cached is fresh. A stale row may be used where the service can't be reached. The key is the first 24 hexadecimal digits of the identity's SHA-256.
    """
    ident = F.concat_ws(":", "eco", "pkg", "version")
    last = cache.groupBy("eco", "pkg", "version").agg(F.max("cached_at").alias("cached_at"))
    j = wanted.select("eco", "pkg", "version").distinct().join(last, ["eco", "pkg", "version"], "left")
    age = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(hours))
    state = F.when(F.col("cached_at").isNull(), "missing").when((F.col("cached_at") > age) | F.lit(offline), "fresh").otherwise("stale")
    return j.select("eco", "pkg", "version", F.substring(F.sha2(ident, 256), 1, 24).alias("cache_key"), state.alias("state"))


def write_store(advisories: DataFrame, path: str) -> None:
    """The advisory table as Parquet by ecosystem, with its package list and its counts beside it."""
    eco, pkg = package_key("ecosystem", "package")
    keyed = advisories.withColumn("eco", eco)
    keyed.write.mode("overwrite").partitionBy("eco").parquet(f"{path}/advisories")
    advisories.select(eco.alias("eco"), pkg.alias("pkg")).distinct().write.mode("overwrite").parquet(f"{path}/packages")
    stats(advisories).write.mode("overwrite").json(f"{path}/metadata")
