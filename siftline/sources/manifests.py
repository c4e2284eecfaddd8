"""Package manifests and lock files as dependencies, format by format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.corpus import basename, lines

# Ecosystems by file name, and the manifests that a lock file in the same folder replaces.
FORMATS = {"go.mod": "Go", "go.sum": "Go", "package.json": "npm", "package-lock.json": "npm", "requirements.txt": "PyPI", "Cargo.toml": "crates.io", "Cargo.lock": "crates.io"}
LOCKED = {"package.json": "package-lock.json", "Cargo.toml": "Cargo.lock"}
_KEYS = ["project", "rel_path"]


def _of(files: DataFrame, name: str) -> DataFrame:
    return files.where((basename(F.col("rel_path")) == name) & F.col("content").isNotNull())


def _rows(df: DataFrame, name: Column, version: Column, eco: str) -> DataFrame:
    return df.select(*_KEYS, name.alias("name"), version.alias("version"), F.lit(eco).alias("ecosystem")).where("name <> ''")


def _bare(version: Column) -> Column:
    """Without the prefixes ^ ~ >= = and blanks."""
    return F.regexp_replace(version, r"^[\s^~>=]+", "")


def go_mod(files: DataFrame) -> DataFrame:
    x = lines(_of(files, "go.mod"), _KEYS)
    p = r"^\s*(?:require\s+)?([^\s/(]\S*)\s+v(\d\S*)"
    return _rows(x.where(F.col("line").rlike(p)), F.regexp_extract("line", p, 1), F.concat(F.lit("v"), F.regexp_extract("line", p, 2)), "Go")


def go_sum(files: DataFrame) -> DataFrame:
    x = lines(_of(files, "go.sum"), _KEYS).withColumn("p", F.split(F.trim("line"), r"\s+")).where(F.size("p") >= 2)
    return _rows(x, F.get("p", 0), F.regexp_replace(F.get("p", 1), "/go\\.mod$", ""), "Go").distinct()


def package_json(files: DataFrame) -> DataFrame:
    kinds = "dependencies map<string,string>, devDependencies map<string,string>"
    x = _of(files, "package.json").select(*_KEYS, F.from_json("content", kinds).alias("j"))
    none = F.create_map().cast("map<string,string>")
    both = [F.map_entries(F.coalesce(F.col(f"j.{k}"), none)) for k in ("dependencies", "devDependencies")]
    return _rows(x.select(*_KEYS, F.explode(F.concat(*both)).alias("e")), F.col("e.key"), _bare(F.col("e.value")), "npm")


def package_lock(files: DataFrame) -> DataFrame:
    """Versions 1 to 3: names under node_modules/ first, then the older list; the first of a name counts."""
    entry = "map<string,struct<version:string>>"
    x = _of(files, "package-lock.json").select(*_KEYS, F.from_json("content", f"packages {entry}, dependencies {entry}").alias("j"))
    none = F.create_map().cast(entry)
    new = F.transform(F.filter(F.map_entries(F.coalesce("j.packages", none)), lambda e: F.startswith(e["key"], F.lit("node_modules/"))), lambda e: F.struct(F.lit(1).alias("p"), F.substring(e["key"], 14, 1 << 20).alias("name"), e["value"]["version"].alias("version")))
    old = F.transform(F.map_entries(F.coalesce("j.dependencies", none)), lambda e: F.struct(F.lit(2).alias("p"), e["key"].alias("name"), e["value"]["version"].alias("version")))
    x = x.select(*_KEYS, F.explode(F.concat(new, old)).alias("e")).select(*_KEYS, "e.*").where("version <> ''")
    best = x.groupBy(*_KEYS, "name").agg(F.min_by("version", F.struct("p", "version")).alias("version"))
    return _rows(best, F.col("name"), F.col("version"), "npm")


def requirements(files: DataFrame) -> DataFrame:
    """name==version or name>=version; a bare name has the version unknown; options are left out."""
    x = lines(_of(files, "requirements.txt"), _KEYS).withColumn("t", F.trim(F.regexp_replace("line", r"\s*(?:#|;).*$", "")))
    x = x.where(~F.col("t").rlike(r"^(?:-|#|$)"))
    pinned = r"^([^=<>!~\[\s]+)(?:\[[^\]]*\])?\s*(?:==|>=)\s*([^\s,]+)"
    name = F.when(F.col("t").rlike(pinned), F.regexp_extract("t", pinned, 1)).otherwise(F.regexp_extract("t", r"^([^=<>!~\[\s]+)", 1))
    return _rows(x, name, F.when(F.col("t").rlike(pinned), F.regexp_extract("t", pinned, 2)).otherwise("unknown"), "PyPI")


def cargo_toml(files: DataFrame) -> DataFrame:
    """Entries of any section whose name holds `dependencies`; the section is carried down."""
    w = Window.partitionBy(*_KEYS).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1)
    x = lines(_of(files, "Cargo.toml"), _KEYS).withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    plain, table = r"""^\s*([\w-]+)\s*=\s*["']([^"']+)["']""", r"""^\s*([\w-]+)\s*=\s*\{.*?version\s*=\s*["']([^"']+)["']"""
    p = F.when(F.col("line").rlike(plain), 1).when(F.col("line").rlike(table), 2)
    x = x.where(F.col("section").contains("dependencies") & p.isNotNull())
    pick = lambda i: F.when(p == 1, F.regexp_extract("line", plain, i)).otherwise(F.regexp_extract("line", table, i))
    return _rows(x, pick(1), _bare(pick(2)), "crates.io")


def cargo_lock(files: DataFrame) -> DataFrame:
    """One dependency for each [[package]] block; the block's number is a running sum."""
    w = Window.partitionBy(*_KEYS).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(_of(files, "Cargo.lock"), _KEYS).withColumn("block", F.sum((F.trim("line") == "[[package]]").cast("int")).over(w)).where("block > 0")
    field = lambda k: F.max(F.when(F.col("line").rlike(rf"^\s*{k}\s*="), F.regexp_extract("line", r'"([^"]*)"', 1)))
    b = x.groupBy(*_KEYS, "block").agg(field("name").alias("name"), field("version").alias("version"))
    return _rows(b.where("version <> ''"), F.col("name"), F.col("version"), "crates.io")


def dependencies(files: DataFrame) -> DataFrame:
    """(project, rel_path, name, version, ecosystem) of all manifests but go.sum; a lock file in the same folder replaces its manifest."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    locks = files.where(basename(F.col("rel_path")).isin(*LOCKED.values())).select("project", folder(F.col("rel_path")).alias("dir"), basename(F.col("rel_path")).alias("lock")).distinct()
    lock_of = F.element_at(F.create_map(*(F.lit(x) for kv in LOCKED.items() for x in kv)), basename(F.col("rel_path")))
    kept = files.withColumn("dir", folder(F.col("rel_path"))).withColumn("lock", lock_of).join(locks, ["project", "dir", "lock"], "left_anti").drop("dir", "lock")
    return reduce(DataFrame.unionByName, [f(kept) for f in (go_mod, package_json, package_lock, requirements, cargo_toml, cargo_lock)])


def rendered(deps: DataFrame) -> DataFrame:
    """(project, rel_path, content): manifests written from dependencies, one for each file name that FORMATS knows; the inverse of dependencies() but for distinctness."""
    d = deps.where(basename(F.col("source_file")).isin(*FORMATS) & (F.trim("name") != "")).select("project", F.col("source_file").alias("rel_path"), F.trim("name").alias("n"), F.trim("version").alias("v")).distinct()
    in_json = basename(F.col("rel_path")).isin("package.json", "package-lock.json")  # a key occurs once: the highest version, as text
    d = d.where(~in_json).unionByName(d.where(in_json).groupBy("project", "rel_path", "n").agg(F.max("v").alias("v")))
    name, quoted = basename(F.col("rel_path")), F.to_json(F.struct("n", "v"))
    key = F.regexp_extract(quoted, r'"n":("(?:[^"\\]|\\.)*")', 1)
    val = F.coalesce(F.concat(F.lit('"'), F.regexp_replace("v", r'(["\\])', r"\\$1"), F.lit('"')), F.lit('""'))
    entry = (
        F.when(name == "go.mod", F.concat(F.lit("\t"), "n", F.lit(" "), F.col("v")))
        .when(name == "requirements.txt", F.when(F.col("v").isNull(), F.col("n")).otherwise(F.concat("n", F.lit("=="), "v")))
        .when(name == "Cargo.toml", F.concat("n", F.lit(' = "'), "v", F.lit('"')))
        .when(name == "Cargo.lock", F.concat(F.lit('[[package]]\nname = "'), "n", F.lit('"\nversion = "'), "v", F.lit('"\n')))
        .when(name == "package.json", F.concat(key, F.lit(": "), val))
        .otherwise(F.concat(F.regexp_replace(key, '^"', '"node_modules/'), F.lit(': {"version": '), val, F.lit("}")))
    )
    g = d.withColumn("e", entry).where("e IS NOT NULL").groupBy("project", "rel_path").agg(F.array_sort(F.collect_set("e")).alias("es"))
    name = basename(F.col("rel_path"))
    body = F.array_join("es", "\n")
    listed = F.array_join("es", ",\n")
    text = (
        F.when(name == "go.mod", F.concat(F.lit("module x\n\nrequire (\n"), body, F.lit("\n)\n")))
        .when(name == "Cargo.toml", F.concat(F.lit("[package]\nname = \"x\"\n\n[dependencies]\n"), body, F.lit("\n")))
        .when(name == "package.json", F.concat(F.lit('{"dependencies": {'), listed, F.lit("}}")))
        .when(name == "package-lock.json", F.concat(F.lit('{"packages": {'), listed, F.lit("}}")))
        .otherwise(body)
    )
    return g.select("project", "rel_path", text.alias("content"))
