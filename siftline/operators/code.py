"""Facts of source files as one flat table: functions, classes, imports, assignments, calls and returns; frameworks and routes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.sources.corpus import MAX_BYTES, extension

# Languages by extension.
LANGUAGES = {"py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "go": "go", "java": "java", "rb": "rb", "php": "php"}
_FUNCTION = {
    "py": re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)?"),
    "js": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(?([\w\s,:=]*)\)?\s*=>\s*\{"),
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)"),
    "java": re.compile(r"^\s*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+?\s(\w+)\s*\(([^)]*)\)\s*(?:throws [\w, ]+)?\{"),
    "rb": re.compile(r"^\s*def\s+(?:self\.)?(\w+[?!]?)\s*(?:\(([^)]*)\))?"),
    "php": re.compile(r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)\s*\(([^)]*)\)"),
}
_CLASS = re.compile(r"^\s*(?:export\s+)?(?:public\s+|abstract\s+|final\s+)*(?:class|interface|type)\s+(\w+)(?:\s+struct)?")
_IMPORTS = (
    (re.compile(r"^\s*from\s+([\w.]+)\s+import\s+(.+)$"), 1, 2),
    (re.compile(r"^\s*import\s+(?:\{([^}]*)\}|\*\s+as\s+(\w+)|(\w+))\s+from\s+['\"]([^'\"]+)['\"]"), 4, 1),
    (re.compile(r"(?:const|let|var)\s+\{?([\w\s,]+)\}?\s*=\s*require\(['\"]([^'\"]+)['\"]\)"), 2, 1),
    (re.compile(r"^\s*(?:import|use)\s+(?:static\s+)?([\w.\\*/]+)(?:\s+as\s+(\w+))?\s*;?\s*$"), 1, 2),
    (re.compile(r"^\s*(?:import\s+)?(?:(\w+)\s+)?\"([\w./-]+)\"\s*$"), 2, 1),
    (re.compile(r"^\s*(?:require|require_relative|include|require_once)\s*\(?['\"]([^'\"]+)['\"]"), 1, 1),
)
_ASSIGN = re.compile(r"^\s*(?:const\s+|let\s+|var\s+|final\s+|private\s+|public\s+|static\s+|int\s+|String\s+|auto\s+|\$)*([A-Za-z_]\w*)(?:\s*:\s*[\w<>\[\]]+|\s+string)?\s*(?::=|=)(?![=>])\s*(.+?);?\s*$")
_CALL = re.compile(r"([A-Za-z_$][\w.$]*)\s*\(")
_RETURN = re.compile(r"^\s*return\b\s*(.*?);?\s*$")
_KEYWORDS = frozenset("if for while switch catch return def function func elif and or not in new class with except print".split())


def _arguments(text: str) -> list[str]:
    """The arguments up to the closing bracket, split at top-level commas."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                out.append(text[start:i])
                break
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [a.strip() for a in out if a.strip()]


def _parameters(text: str | None) -> list[str]:
    """The parameters' names; a language that writes the type first has the name last."""
    names = []
    for p in (text or "").split(","):
        words = re.findall(r"[A-Za-z_]\w*", p.split("=")[0].split(":")[0])
        if words and words[-1] not in ("self", "this", "cls"):
            names.append(words[0] if len(words) == 2 and words[1] in ("string", "int", "bool", "error", "float64", "byte") else words[-1])
    return names


_OPEN = {"(": ")", "[": "]", "{": "}"}
_TOKEN = re.compile(r"""\"\"\"|\'\'\'|["'`#()\[\]{}]|//|/\*""")
_REMARKS = {"py": ("#",), "rb": ("#",), "php": ("#", "//", "/*")}


def _is_literal(lang: str, before: str) -> bool:
    """Whether the brace after `before` opens a value rather than a body."""
    b = before.rstrip()
    return lang == "py" or b.endswith(tuple("=([,:?&|]")) or b.endswith("return") or lang == "go" and b == before and re.search(r"[\w\]}]$", b) is not None


def joined_lines(rows: list[str], lang: str) -> tuple[dict[int, str], set[int]]:
    """The statements of several lines by their first line, counted from 1, and the lines that only go on with one.

    A statement goes on while a bracket or a long literal is open. The body of a function within it has its own
    statements and isn't a part of its text. A bracket that nothing closes doesn't count.
    """
    out: dict[int, str] = {}
    inside: set[int] = set()
    wrong: set[tuple[int, int]] = set()
    stack: list[tuple] = []  # (bracket, its place, is a body, first line of its statement, brackets open there, the statement that a body interrupts)
    quotes = ('"""', "'''") if lang == "py" else ("`",) if lang in ("js", "go") else ()
    remarks = _REMARKS.get(lang, ("//", "/*"))
    i, start, base, parts, quote, began = 0, 0, 0, [], "", (0, 0)
    while i <= len(rows):
        bad = []
        if i == len(rows):
            bad = [s for s in stack if not s[2]]
            if quote and not bad:
                bad = [("", began, False, start, base, None)]
            if not bad:
                break
        else:
            line, at, from_ = rows[i], 0, 0
            goes_on = bool(quote) or bool(parts)
            if not goes_on:
                start, base = i, len(stack)
            resumed = False
            while not bad:
                if quote:
                    end = line.find(quote, at)
                    while end > 0 and line[end - 1] == "\\":
                        end = line.find(quote, end + 1)
                    if end < 0:
                        break
                    at, quote = end + len(quote), ""
                    continue
                m = _TOKEN.search(line, at)
                if not m:
                    break
                c, at = m[0], m.end()
                place = (i, m.start())
                if c in ("#", "//", "/*"):
                    if c in remarks:
                        end = line.find("*/", at) if c == "/*" else -1
                        line = line[: m.start()] + (" " * (end + 2 - m.start()) + line[end + 2 :] if end >= 0 else "")
                elif place in wrong:
                    continue
                elif c in quotes:
                    quote, began = c, place
                elif c[0] in "\"'`":
                    if len(c) == 3:
                        at = m.start() + 1
                    end = line.find(c[0], at)
                    while end > 0 and line[end - 1] == "\\":
                        end = line.find(c[0], end + 1)
                    at = end + 1 if end >= 0 else at
                elif c in _OPEN:
                    body = c == "{" and not _is_literal(lang, line[: m.start()])
                    if body and stack and not stack[-1][2]:  # a body within a statement
                        stack.append((c, place, True, start, base, [*parts, line[from_:at]]))
                        parts, start, base, from_ = [], i, len(stack), len(line)
                    else:
                        stack.append((c, place, body, start, base, None))
                elif any(_OPEN[s[0]] == c for s in stack):
                    while _OPEN[stack[-1][0]] != c:
                        bad.append(stack.pop())
                    if bad:
                        bad = [s for s in bad if not s[2]]
                        if not bad:
                            stack.pop()
                        continue
                    s = stack.pop()
                    if s[5] is not None:
                        resumed = not line[: m.start()].strip()
                        parts, start, base, from_ = s[5], s[3], s[4], m.start()
                        goes_on = True
        if bad:  # once more from the statement of the lowest, without them
            wrong |= {s[1] for s in bad}
            low = min(bad, key=lambda s: s[1])
            i, stack, parts, quote = low[3], stack[: low[4]], [], ""
            out = {k: v for k, v in out.items() if k <= i}
            inside = {k for k in inside if k <= i}
            continue
        if goes_on and (resumed or i > start and not any(s[5] is not None and s[1][0] == i for s in stack) and (from_ == 0)):
            inside.add(i + 1)
        text = line[from_:]
        open_ = bool(quote) or bool(stack) and not stack[-1][2] or lang == "py" and line.endswith("\\")
        if open_ or parts:
            parts.append(text.rstrip("\\") if lang == "py" else text)
        if not open_ and parts:
            if i > start:
                out[start + 1] = " ".join([parts[0].rstrip(), *(p.strip() for p in parts[1:] if p.strip())])
            parts = []
        i += 1
    return out, inside


def facts_of(text: str, lang: str) -> list[tuple[str, str, int, int, str, list[str], str]]:
    """(kind, func, line, end_line, name, args, text) of a file. func is the enclosing function, '' at the top.

    A function ends before the next line that isn't deeper (Python, Ruby) or where its braces close.
    """
    out: list[tuple[str, str, int, int, str, list[str], str]] = []
    rows = [x.rstrip("\r") for x in text.split("\n")]
    opened: list[list] = []  # [name, depth of the line or of the braces, place in out]
    braces = 0
    joined, inside = joined_lines(rows, lang)
    for no, row in enumerate(rows, 1):
        line = joined.get(no, row)
        bare = line.strip()
        if no in inside:
            if lang not in ("py", "rb"):
                braces += row.count("{") - row.count("}")
                while opened and braces <= opened[-1][1] and "}" in row:
                    _close(out, opened.pop(), no)
            continue
        if not bare or bare.startswith(("//", "#", "*", "/*", "--")):
            continue
        indent = len(line) - len(line.lstrip())
        if lang in ("py", "rb"):
            while opened and indent <= opened[-1][1] and not (lang == "rb" and bare == "end"):
                _close(out, opened.pop(), no - 1)
        m = _FUNCTION[lang].match(line)
        if m:
            g = [x for x in m.groups() if x is not None] or [""]
            out.append(("function", opened[-1][0] if opened else "", no, no, g[0], _parameters(g[1] if len(g) > 1 else ""), bare))
            opened.append([g[0], indent if lang in ("py", "rb") else braces, len(out) - 1])
        elif c := _CLASS.match(line):
            out.append(("class", "", no, no, c[1], [], bare))
        else:
            here = opened[-1][0] if opened else ""
            found = next(((p.match(line) if i != 2 else p.search(line), a, b) for i, (p, a, b) in enumerate(_IMPORTS) if (p.match(line) if i != 2 else p.search(line))), None)
            if found and (lang != "go" or '"' in line and "=" not in line):
                mm, a, b = found
                symbols = re.findall(r"\w+", " ".join(x for k, x in enumerate(mm.groups(), 1) if x and (k == b or (a == 4 and k < 4))))
                out.append(("import", here, no, no, mm[a], [s for s in symbols if s != "as"], bare))
            else:
                if r := _RETURN.match(line):
                    out.append(("return", here, no, no, "", [], r[1]))
                elif s := _ASSIGN.match(line):
                    out.append(("assign", here, no, no, s[1], [], s[2]))
                for k in _CALL.finditer(line):
                    if k[1] not in _KEYWORDS:
                        out.append(("call", here, no, no, k[1], _arguments(line[k.end() :]), bare))
        if lang not in ("py", "rb"):
            braces += row.count("{") - row.count("}")
            while opened and braces <= opened[-1][1] and (row.count("}") or no > out[opened[-1][2]][2]):
                _close(out, opened.pop(), no)
    while opened:
        _close(out, opened.pop(), len(rows))
    return out


def _close(out: list, entry: list, line: int) -> None:
    kind, func, start, _, name, args, text = out[entry[2]]
    out[entry[2]] = (kind, func, start, max(line, start), name, args, text)


_FACTS = "project string, rel_path string, kind string, func string, line int, end_line int, name string, args array<string>, text string"


def facts(files: DataFrame) -> DataFrame:
    """The facts of all files of a known language up to MAX_BYTES, in one Arrow pass. Null contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, r, *x) for p, r, lang, t in zip(b["project"], b["rel_path"], b["lang"], b["content"], strict=True) for x in facts_of(t, lang)]
            yield pd.DataFrame(rows, columns=["project", "rel_path", "kind", "func", "line", "end_line", "name", "args", "text"])

    lang = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.coalesce(extension(F.col("rel_path")), F.lit("")))
    f = files.where(F.col("content").isNotNull() & (F.octet_length("content") <= MAX_BYTES)).withColumn("lang", lang).where("lang IS NOT NULL")
    return f.select("project", "rel_path", "lang", "content").mapInPandas(run, _FACTS)


def module_name(path: Column) -> Column:
    """The path without its extension, with dots for slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "[/\\\\]", ".")


# Texts that show a framework (extensions, any of the texts), and how its routes are written (verb or '', pattern with the path).
FRAMEWORKS = {
    "flask": (("py",), ("from flask import", "import flask", "Flask(__name__)", "Blueprint(")),
    "django": (("py",), ("from django", "import django", "django.")),
    "fastapi": (("py",), ("from fastapi import", "import fastapi", "FastAPI(", "APIRouter(")),
    "express": (("js", "ts", "mjs", "cjs"), ("require('express')", 'require("express")', "from 'express'", 'from "express"', "express()", "express.Router()")),
    "nestjs": (("ts", "js"), ("@nestjs/", "@Controller(", "@Injectable(")),
    "spring": (("java", "kt"), ("org.springframework.", "@RestController", "@Controller", "@SpringBootApplication", "@RequestMapping")),
    "gin": (("go",), ("github.com/gin-gonic/gin", "gin.Default()", "gin.New()", "*gin.Context")),
}
ROUTES = (
    r"""(?i)\b(?:app|router|server)\.(get|post|put|delete|patch|all)\(\s*["'`]([^"'`]+)["'`]""",
    r"""(?i)@(?:\w+\.)?(get|post|put|delete|patch|route)(?:Mapping)?\(\s*(?:value\s*=\s*|path\s*=\s*)?["']([^"']*)["']""",
    r"""\b\w+\.(GET|POST|PUT|DELETE|PATCH|Any)\(\s*"([^"]+)\"""",
    r"""\b(path|re_path|url)\(\s*r?["']([^"']*)["']\s*,""",
)
AUTH_WORDS = r"(?i)login_required|jwt_required|@auth|authenticate|passport|requireauth|isauthenticated|permission_classes|preauthorize|@secured|useguards|depends\(get_current_user|authmiddleware"


def frameworks(files: DataFrame) -> DataFrame:
    """(project, rel_path, framework): every framework that a file shows."""
    ext = F.coalesce(extension(F.col("rel_path")), F.lit(""))
    hits = []
    for name, (exts, texts) in FRAMEWORKS.items():
        shown = F.lit(False)
        for t in texts:
            shown = shown | F.contains("content", F.lit(t))
        hits.append(F.when(ext.isin(*exts) & shown, F.lit(name)))
    return files.select("project", "rel_path", F.explode(F.array_compact(F.array(*hits))).alias("framework"))


def routes(lines: DataFrame) -> DataFrame:
    """(project, rel_path, line_no, method, route, guarded): route declarations; guarded if their line or one of the two around it asks for a login."""
    from pyspark.sql import Window

    w = Window.partitionBy("project", "rel_path").orderBy("line_no").rowsBetween(-2, 2)
    x = lines.withColumn("guarded", F.max(F.col("line").rlike(AUTH_WORDS)).over(w))
    hits = [F.when(F.col("line").rlike(p), F.struct(F.upper(F.regexp_extract("line", p, 1)).alias("method"), F.regexp_extract("line", p, 2).alias("route"))) for p in ROUTES]
    x = x.select("project", "rel_path", "line_no", "guarded", F.coalesce(*hits).alias("h")).where("h IS NOT NULL")
    method = F.when(F.col("h.method").isin("ROUTE", "PATH", "RE_PATH", "URL", "ALL", "ANY"), "ANY").otherwise(F.col("h.method"))
    return x.select("project", "rel_path", "line_no", method.alias("method"), "h.route", "guarded")
