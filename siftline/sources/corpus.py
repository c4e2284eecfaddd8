"""Files and their lines, from tables or folders, with the gates that decide what is scanned."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import rules as R

MAX_BYTES = 8 * 1024 * 1024
#: Bytes at a file's head that are searched for a NUL.
SNIFFED = 1024


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case text after the last dot of the base name; null without one."""
    e = F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))
    return F.when(e != "", e)


def from_folder(spark: SparkSession, folder: str, project: str = "") -> DataFrame:
    """(project, rel_path, name, ext, size_bytes, content) of a folder's files, gated by path and size before they are read.

    Files in skipped folders, with binary extensions, with a NUL in the head where the extension is unknown,
    above MAX_BYTES or with invalid UTF-8 are left out.
    """
    root = folder.rstrip("/")
    path = F.col("_metadata.file_path")  # a constant of each file: what it rules out is never opened
    below = F.regexp_replace(F.element_at(F.split(path, F.lit("\\Q" + quote(root) + "/\\E"), 2), -1), r"\\", "/")
    names = ~below.rlike(_in_dir(R.SKIPPED_DIRS)) & ~F.coalesce(extension(below), F.lit("")).isin(*R.SKIPPED_EXTENSIONS)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(names)
    rel = F.regexp_replace(F.element_at(F.split("path", F.lit("\\Q" + root + "/\\E"), 2), -1), r"\\", "/")
    f = f.withColumn("rel_path", rel).withColumn("ext", extension(F.col("rel_path")))
    gate = F.col("length") <= MAX_BYTES
    f = f.where(gate).where(F.coalesce(F.col("ext"), F.lit("")).isin(*R.TEXT_EXTENSIONS) | ~F.contains(F.substring("content", 1, SNIFFED), F.lit(b"\x00")))
    f = f.where(F.is_valid_utf8(F.col("content").cast("string")))
    return f.select(F.lit(project).alias("project"), "rel_path", basename(F.col("rel_path")).alias("name"), "ext", F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("content"))


def _in_dir(names: Sequence[str]) -> str:
    quoted = "|".join(n.replace(".", r"\.") for n in names)
    return rf"(?:^|/)(?:{quoted})/"


def gated(files: DataFrame, include_tests: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """`files` with the column verdict: scanned, or why not (first of: excluded, folder, test, binary, size).

    An exclusion is `*.ext`, a whole path, a folder or a base name. Null paths and contents are 'binary'.
    """
    path, ext = F.col("rel_path"), F.coalesce(extension(F.col("rel_path")), F.lit(""))
    hit = F.lit(False)
    for p in exclude:
        hit = hit | (F.endswith(path, F.lit(p[1:])) if p.startswith("*.") else (path == p) | F.startswith(path, F.lit(p.rstrip("/") + "/")) | (basename(path) == p))
    test = F.lower(path).rlike(R.TEST_FILES) if not include_tests else F.lit(False)
    nul = F.contains(F.substring("content", 1, SNIFFED), F.lit("\x00"))
    verdict = (
        F.when(path.isNull() | F.col("content").isNull(), "binary")
        .when(hit, "excluded")
        .when(path.rlike(_in_dir(R.SKIPPED_DIRS)), "folder")
        .when(test, "test")
        .when(ext.isin(*R.SKIPPED_EXTENSIONS) | (~ext.isin(*R.TEXT_EXTENSIONS) & nul), "binary")
        .when(F.octet_length("content") > MAX_BYTES, "size")
        .otherwise("scanned")
    )
    return files.withColumn("verdict", verdict)


def lines(files: DataFrame, keys: Sequence[str], text: str = "content") -> DataFrame:
    """(keys, line_no, line): one row for each line from 1 on; a line end is \\n or \\r\\n, what follows the last one only if it isn't empty.

    Null texts have no lines.
    """
    parts = F.split(F.col(text), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    x = files.where(F.col(text).isNotNull()).select(*keys, F.posexplode(kept).alias("p", "raw"))
    return x.select(*keys, (F.col("p") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("line"))


def before_tests(files: DataFrame, text: str = "content") -> DataFrame:
    """`files` with the text up to the line that opens a module of tests (`#[cfg(test)]`)."""
    return files.withColumn(text, F.when(F.contains(text, F.lit("#[cfg(test)]")), F.get(F.split(text, r"(?m)^[ \t]*#\[cfg\(test\)\]", 2), 0)).otherwise(F.col(text)))


def warnings(files: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(project, rel_path, reason) for every file of gated() that isn't scanned because of its size or its bytes."""
    size = F.concat(F.lit("larger than "), F.lit(MAX_BYTES).cast("string"), F.lit(" bytes"))
    reason = F.when(F.col(verdict) == "size", size).when(F.col(verdict) == "binary", F.when(F.col("content").isNull(), "no text").otherwise("not a text"))
    return files.select("project", "rel_path", reason.alias("reason")).where("reason IS NOT NULL")


def diff_added(diff_lines: DataFrame, by: str, order: str = "line_no", line: str = "line") -> DataFrame:
    """(by, order, file, text) of the added lines of unified diffs; the current file is carried down from its `diff --git` or +++ line."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col(line).rlike(r"^diff --git a/"), F.regexp_extract(line, r"^diff --git a/.* b/(.*)$", 1)).when(F.col(line).rlike(r"^\+\+\+ "), F.regexp_replace(F.regexp_extract(line, r"^\+\+\+ (\S+)", 1), r"^b/", ""))
    d = diff_lines.withColumn("file", F.last(named, ignorenulls=True).over(w))
    return d.where(F.col(line).rlike(r"^\+(?!\+\+ )")).select(by, order, "file", F.substring(line, 2, 1 << 30).alias("text"))


def push_refs(lines_: DataFrame, line: str = "line") -> DataFrame:
    """(local_ref, local_sha, remote_ref, remote_sha, action) of pre-push lines with four fields or more: delete, create, noop or update."""
    p = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")
    x = lines_.where(F.size(p) >= 4).select(*(F.get(p, i).alias(n) for i, n in enumerate(("local_ref", "local_sha", "remote_ref", "remote_sha"))))
    zero = "^0+$"
    action = F.when(F.col("local_sha").rlike(zero), "delete").when(F.col("local_sha") == F.col("remote_sha"), "noop").when(F.col("remote_sha").rlike(zero), "create").otherwise("update")
    return x.withColumn("action", action)


def ignore_patterns(files: DataFrame) -> DataFrame:
    """(project, pattern) of the .gitignore files: trimmed, without outer slashes; blank lines, remarks and negations are left out."""
    x = lines(files.where(basename(F.col("rel_path")) == ".gitignore"), ["project"]).select("project", F.regexp_replace(F.trim(F.regexp_replace("line", r"\\\\", "/")), "^/+|/+$", "").alias("pattern"))
    return x.where((F.col("pattern") != "") & ~F.col("pattern").rlike("^[#!]")).distinct()


def ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of `files` that a pattern of their project names: the whole path, a folder above, the base name, or *.ext.

    Each file asks for the few texts that could name it, so that the join is by equality.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ext = F.regexp_extract(basename(F.col("rel_path")), r"(\.[^.]+)$", 1)
    asked = F.array_distinct(F.concat(above, F.array(basename(F.col("rel_path"))), F.when(ext != "", F.array(F.concat(F.lit("*"), ext))).otherwise(F.array().cast("array<string>"))))
    hit = files.where("rel_path IS NOT NULL").select("project", "rel_path", F.explode(asked).alias("pattern")).join(patterns, ["project", "pattern"]).select("project", "rel_path").distinct()
    return files.join(hit, ["project", "rel_path"], "left_semi")


def effective_excludes(patterns: Sequence[str], include_tests: bool = False, include_docs: bool = False) -> list[str]:
    """The exclusions without those on tests or documents, where these are asked for."""
    def kept(p: str) -> bool:
        low = p.lower().replace("\\", "/")
        document = "doc" in low or "report" in low or low.endswith((".md", ".markdown", ".rst", ".adoc"))
        return not (include_tests and "test" in low) and not (include_docs and document)

    return [p for p in patterns if kept(p)]
