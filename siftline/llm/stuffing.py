"""Pages made of repeated keywords, links or product tags, found by their rank-frequency curves.

The words of each page are ranked by frequency in SQL windows and a line is fitted through the logarithms.
Slope and residual of the fit and the page's divergence from reference text are compared with those of prose
pages of the same language and of comparable length; what is extreme in any of the three is flagged.
Reference text is the prose of the page's language, code and tables, learned apart from all pages: code and
tables are no prose, but their words are as few and as often repeated everywhere, while stuffing consists of
words that none of the three has. An exact check of the flagged pages follows, since a page counts by its
characters: more than half of them have to lie in lines that are links, tags or keywords.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import written

#: Standard deviations from prose of comparable length, in the direction of stuffing, beyond which a page is extreme.
EXTREME = {"slope": 6.0, "residual": 9.0, "divergence": 3.0}
#: A word of the reference occurs in at least this share of the pages of its kind: at most 1 / share words for each word of a mean page.
MODEL_SHARE = 0.005
#: A common word occurs in at least this share of a language's prose pages.
COMMON_SHARE = 0.2
#: Words of a sentence that teaches the prose model.
SENTENCE_WORDS = 7
#: A page of prose has at least this share of its words in such sentences.
PROSE_SHARE = 0.8
#: Lines of code or of a table that a page has at least, to teach that model.
LINES = 3

_WORDS = r"\p{L}+(?:['’]\p{L}+)?"
_LINKS = r"https?://|www\."
#: A line of code or configuration: brackets, assignments, calls, remarks, `key: value`, an instruction or an item of one word.
_CODE_LINE = r"[{}=;$\\]|\w\(|^\s*(?:#|//|--\s|/\*|<\w)|^\s*[\w.-]+:(?:\s|$)|^[A-Z]+ \S+$|^\s*-\s\S+$"
#: A row of a table: at least three columns between bars or wide gaps.
_TABLE_ROW = r"\S\s{2,}\S.*\S\s{2,}\S|\|[^|]+\|"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORDS), 0)


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text); an unknown language is '?'. Rows with a null doc_id or text are left out."""
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), "text")


def lessons(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, prose_words, prose, code, table): the distinct words of a page's sentences, lines of code and
    rows of tables, and the number of words in its sentences.

    Sentences have at least SENTENCE_WORDS words and no link. Lines of code teach where a page has LINES of
    them and they are half of its lines, rows of a table where it has LINES.
    """
    sentences = F.filter(F.split("text", r"\n|(?<=[.?!])\s+"), lambda s: s.rlike(r"^[\s\-*#>0-9.()\[\]:]*\p{Lu}[^\n]*[.?!]\s*$") & ~s.rlike(_LINKS))
    prose = F.filter(F.transform(sentences, _words), lambda w: F.size(w) >= SENTENCE_WORDS)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    x = rows.select("doc_id", "lang", prose.alias("prose"), lines.alias("lines"))
    like = lambda pattern: F.filter("lines", lambda x: x.rlike(pattern) & ~x.rlike(_LINKS))
    x = x.select("doc_id", "lang", F.flatten("prose").alias("prose"), F.size("lines").alias("n"), like(_CODE_LINE).alias("code"), like(_TABLE_ROW).alias("table"))
    taught = lambda c, enough: F.when(enough & (F.size(c) >= LINES), F.array_distinct(_words(F.array_join(c, " "))))
    return x.select("doc_id", "lang", F.size("prose").alias("prose_words"), F.array_distinct("prose").alias("prose"), taught("code", 2 * F.size("code") >= F.col("n")).alias("code"), taught("table", F.lit(True)).alias("table"))


def reference(taught: DataFrame) -> DataFrame:
    """(word, langs, common): the words of prose of each language, code and tables that occur in at least MODEL_SHARE
    of the pages that teach their kind, and in two of them.

    langs are the languages whose prose has the word, and '' if code or tables have it; `common` if it is in
    COMMON_SHARE of a language's prose pages. Bounded: the shares of all words of a kind add up to the distinct
    words of a mean page.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("words")) for k in ("prose", "code", "table")))
    t = taught.select("lang", F.explode(kinds).alias("k")).select(F.when(F.col("k.kind") == "prose", F.col("lang")).otherwise("").alias("lang"), "k.kind", "k.words").where("size(words) > 0")
    n = t.groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("pages"))
    w = t.select("kind", "lang", F.explode("words").alias("word")).groupBy("kind", "lang", "word").agg(F.count(F.lit(1)).alias("k"))
    w = w.join(F.broadcast(n), ["kind", "lang"]).where("k >= 2").where(F.col("k") >= F.col("pages") * MODEL_SHARE)  # one row for each language
    common = (F.col("kind") == "prose") & (F.col("lang") != "?") & (F.col("k") >= F.col("pages") * COMMON_SHARE)
    return w.groupBy("word").agg(F.collect_set("lang").alias("langs"), F.max(common).alias("common"))


def curves(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, n_types, slope, residual, divergence) of every page with a word.

    slope and residual are those of ln(frequency) over ln(rank); a page with a single word has slope 0.
    divergence is the relative entropy, in nats, of the page's words to the reference of its language, words of
    the reference being one class of 99 parts in 100 and all others the other; 0 where they are fewer than that.
    An unknown language has the words of all.
    Texts are spread by doc_id once, and all that follows happens where they lie.
    """
    words = rows.repartition("doc_id").select("doc_id", "lang", F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.join(F.broadcast(model.select("word", "langs")), "word", "left")  # bounded by MODEL_SHARE
    ranked = ranked.withColumn("known", F.coalesce(F.array_contains("langs", F.col("lang")) | F.array_contains("langs", "") | ((F.col("lang") == "?") & F.col("langs").isNotNull()), F.lit(False))).drop("langs")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")))
    x, y = F.ln("rank"), F.ln("n")
    fit = ranked.groupBy("doc_id", "lang").agg(
        F.sum("n").cast("bigint").alias("n_words"),
        F.count(F.lit(1)).alias("n_types"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), (F.regr_syy(y, x) - F.coalesce(F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)), F.lit(0.0))) / F.count(F.lit(1)))).alias("residual"),
        (F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("u"),
    )
    u, q = F.col("u"), 0.01
    kl = u * F.ln(u / q) + F.when(u < 1, (1 - u) * F.ln((1 - u) / (1 - q))).otherwise(0.0)
    return fit.select("doc_id", "lang", "n_words", "n_types", "slope", "residual", F.when(u > q, kl).otherwise(0.0).alias("divergence"))


def extremes(fits: DataFrame, taught: DataFrame) -> DataFrame:
    """curves() with z_slope, z_residual, z_divergence and extreme, against prose pages of the language and of
    comparable length (a factor of two); where there are fewer than 8 of them, of the language, else of all."""
    measures = ("slope", "residual", "divergence")
    f = fits.withColumns({"size_class": F.floor(F.log2("n_words")).cast("int"), "all": F.lit(1)})
    ref = f.join(taught.select("doc_id", "prose_words"), "doc_id").where(F.col("prose_words") >= PROSE_SHARE * F.col("n_words"))
    stats = [s for m in measures for s in (F.avg(m).alias(f"m_{m}"), F.stddev_pop(m).alias(f"s_{m}"))]
    n = F.count(F.lit(1)).alias("n")
    # the statistics have one row for each language and length class at most
    j = f
    for p, by in (("a", ["lang", "size_class"]), ("b", ["lang"]), ("c", ["all"])):
        s = ref.groupBy(*by).agg(n, *stats).where("n >= 8").drop("n")
        s = F.broadcast(s.select(*by, *(F.col(c).alias(p + c) for c in s.columns if c not in by)))
        j = j.join(s, by, "left")
    of = lambda what, m, rest: F.coalesce(*(F.col(f"{p}{what}_{m}") for p in "abc"), F.lit(rest))
    z = {m: (F.col(m) - of("m", m, 0.0)) / F.greatest(F.lit(0.02), of("s", m, 1.0)) for m in measures}
    out = j.select("doc_id", "lang", "n_words", "n_types", *measures, *(v.alias(f"z_{m}") for m, v in z.items()))
    far = (-F.col("z_slope") > EXTREME["slope"]) | (F.col("z_residual") > EXTREME["residual"]) | (F.col("z_divergence") > EXTREME["divergence"])
    return out.withColumn("extreme", far)


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>[^<]*</a>|https?://[^\s|,<>\"')\]]+|www\.\S+")
_CODE = re.compile(r"^#!|\"|[\[\]]|^\s*(?:fi|done|esac|else|end|then|pass)\s*$|^\s*\w+ -\w|[{}=<>_$\\]|;\s*$|\s/\w|\s--\w|^[A-Z]+\s\d+$|\w\(|\)\s*$|^\s*(?://|--|\*\s|/\*)|[a-z][A-Z]|:\s*$|\w/\w|^\s*-\s\w+$")
_HEADING = re.compile(r"^#{1,6}\s")
_NUMBER = re.compile(r"\(#[0-9]+\)\Z")


def ends(text: str) -> bool:
    """Whether a mark that ends sentences stands after the last word, a number in brackets aside."""
    text = _NUMBER.sub("", text.rstrip())
    at = len(text)
    while at and not (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    return any(c in ".?!:" for c in text[at:])


def is_sentence(text: str, common: frozenset[str]) -> bool:
    """At least six words, two fifths of them common ones, and an end."""
    w = _WORD.findall(text.lower())
    return len(w) >= 6 and 5 * sum(x in common for x in w) >= 2 * len(w) and ends(text)


def _kind(line: str, common: frozenset[str]) -> str:
    rest = _LINK.sub(" ", line)
    n = len(_WORD.findall(rest))
    good = sum(len(_WORD.findall(s)) for s in re.split(r"(?<=[.?!])\s+", rest) if is_sentence(s, common))
    if good and 2 * good >= n:
        return "prose"
    if len(rest) < len(line):
        return "link"
    if all(t[0] == "#" and len(t) > 1 for t in line.split()):
        return "tag"
    if _HEADING.match(line):
        return "heading"
    return "code" if _CODE.search(line) else "words"


def stuffed_share(text: str, common: frozenset[str]) -> float:
    """The share of a text's characters, blank lines aside, in lines that are links, tags or keywords.

    A line of plain words is one of keywords if its paragraph has no sentence, little code and at least eight
    such words; headings and captions are shorter. What stands between two fences is code; a fence that none
    follows opens nothing.
    """
    stuffed = total = 0
    fenced, marks = False, sum(x.strip().startswith("```") for x in text.split("\n"))
    pairs = marks - marks % 2
    for paragraph in re.split(r"\n\s*\n", text):
        lines = [x.strip("\r") for x in paragraph.split("\n") if x.strip()]
        kinds = []
        for line in lines:
            mark = line.strip().startswith("```")
            kinds.append("code" if mark or fenced else _kind(line, common))
            fenced ^= mark and pairs > 0
            pairs -= mark
        code = kinds.count("code")
        code += kinds.count("heading") if code else 0
        words = sum(len(_WORD.findall(x)) for x, k in zip(lines, kinds, strict=True) if k == "words")
        keywords = words >= 8 and 10 * code <= 3 * len(lines) and "prose" not in kinds
        for line, kind in zip(lines, kinds, strict=True):
            n = len(line.strip())
            total += n
            stuffed += n if kind in ("link", "tag") or kind == "words" and keywords else 0
    return stuffed / total if total else 0.0


def checked(rows: DataFrame, flagged: DataFrame, model: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, stuffed): the flagged pages of which more than `share` is stuffed. Only the common words are collected: at most some hundreds."""
    common = frozenset(r["word"] for r in model.where("common").select("word").distinct().collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"doc_id": b["doc_id"], "stuffed": [stuffed_share(t, common) for t in b["text"]]})
            yield out[out["stuffed"] > share]

    return rows.join(flagged.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInPandas(run, "doc_id bigint, stuffed double")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, stuffed) of the stuffed pages. Empty pages and pages without a word aren't; an empty table gives no rows.

    A page without a word other than its links' parts has no prose to compare with, but those parts are words.
    """
    rows = pages(documents)
    fits, model = _measured(rows)
    return checked(rows, fits.where("extreme"), model)


def page_curves(documents: DataFrame) -> DataFrame:
    """extremes() of all pages."""
    return _measured(pages(documents))[0]


def _measured(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """extremes() and the reference. Lessons, reference and curves are written, since each is read several times."""
    taught = written(lessons(rows), "lessons")
    model = written(reference(taught), "reference")
    return extremes(written(curves(rows, model), "curves"), taught), model
