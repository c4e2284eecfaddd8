"""Live credentials in source code and configuration: found by a trained classifier, and redacted.

Each line's literal values are candidates, with the identifier that names them. Patterns that are sure label a
part of the candidates weakly; their word lists are no features. Character Markov chains of both classes are counted over all weakly labelled candidates,
a logistic regression over the chains' likelihood ratio, the surrounding identifiers, the form of the value
and the path is fitted on a bounded sample of them, calibrated on rows it hasn't seen, and scores every
candidate. Values with a calibrated score of at least CUT are credentials, unless an exact check shows that
they are masked, a placeholder, a reference, a checksum or an address without a login.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import drop_tables, written

CUT = 0.5
#: At most so many weakly labelled rows of each stratum (label and reason) are used to fit and calibrate.
SAMPLE_PER_STRATUM = 1200
#: At most so many identifier parts are features.
WORDS = 300
REDACTED = "[REDACTED]"

# Public formats of tokens.
TOKEN = re.compile(
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30,}|xox[abprs]-[0-9A-Za-z-]{20,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|[srp]k_(?:live|test)_[A-Za-z0-9]{20,}|AIza[\w-]{30,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,})(?![\w*]|\.\.\.)"
)
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----")
#: Words that say that a name holds a secret, and words that say that it speaks about one or is something else.
SECRET_WORDS = frozenset("pass password passwd pwd passphrase pw secret token key apikey credential credentials creds auth authorization bearer hmac signing private userpass dbpass dbpassword".split())
ABOUT_WORDS = frozenset("label header file path name ttl type min max length len days age ring izer tokenizer rotation public id uuid hash checksum sha sha256 sha1 sha512 md5 digest integrity commit revision ref git build trace correlation request icon logo pixel url hint policy count size field".split())
PLACEHOLDER = re.compile(r"(?i)^(?:<[^>]*>|\[[^\]]*\]|[x*.#_-]{3,}|todo|tbd|fixme|none|null|nil|true|false|n/?a|undefined|change[ _-]?me|(?:.*[^a-z])?(?:your|example|placeholder|replace|dummy|insert|redacted|masked)(?:[^a-z].*)?|.*not[ _-]real.*)$")
REFERENCE = re.compile(r"(?i)\$\s*[{(]|\{\s*\{|^\$[A-Za-z_]\w*$|^%\w+%$|\bprocess\.env\b|\bos\.environ|getenv|\bvar\.\w|\bvault[.:/]|^(?:env|file|ssm|arn|secret|vault):|\blocal\.\w|\bsecrets?\.\w|\bconfig\.\w|\bsettings\.\w")
MASK = re.compile(r"\*{3,}|•{3,}|(?<=\w)\.{3}$|…$|(?i:x{6,})|\[REDACTED\]|<(?:masked|redacted)>")
PATHLIKE = re.compile(r"^(?:\.{0,2}/)?(?:[a-z][a-z0-9_.-]*/)+[a-z][a-z0-9_.-]*$")
HEX, UUID = re.compile(r"^[0-9a-f]+$"), re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")

_Q = "\"'`“”‘’"
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`|[“”]([^“”"\n]*)[“”]|[‘’]([^‘’\'\n]*)[‘’]')
_GLUE = re.compile(r"^\s*(?:\+|\.\.?|&|\|\|)?\s*$")
_IDENT = re.compile(r"[A-Za-z_][\w-]*")
_BARE = re.compile(r"^\s*(?:[-*#;/<!]+\s*)?(?:(?:export|const|let|var|set|local|readonly|declare|ENV|ARG|run:)\s+)*([A-Za-z_/][\w./:-]*?)\s*(?::=|=>|=|:)\s*(.*)$")
_SPACED = re.compile(r"^\s*(?:ENV|ARG|set|SET)\s+([A-Za-z_]\w*)\s+(\S.*)$")
_PAIR = re.compile(r"(?<![\w-])([A-Za-z_][\w-]*)\s*(?:=|:\s?)\s*(?!//)([^\s\"'`“”‘’;,(){}<>=\[\]]{3,}+)(?!\s*=)")
#: A line that ends before its value: `name = (`, `name =` or a call with the name as its first argument.
_OPENING = re.compile(r"(?:\(\s*[\"']([\w.-]+)[\"']\s*,|[=:]\s*\(?)\s*$")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>]+)</")
#: (kind, what the line in lower case has to hold for the pattern to be tried, pattern)
_FORMS = (
    ("userinfo", "://", re.compile(r"(?<![\w+.-])[a-zA-Z][\w+.-]*://[^\s/:@\"'`]*:([^\s/\"'`]+)@(?=[\w.$-])")),
    ("dsn", "pwd=|password=|pwd =|password =", re.compile(r"(?i);\s*(?:password|pwd)\s*=\s*([^;\"'`]+)")),
    ("sql", "password|identified", re.compile(r"(?i)\b(?:password|identified\s+by)\s+'([^'\n]+)'")),
    ("login", "login", re.compile(r"(?i)\blogin\s+\S+\s+password\s+(\S+)")),
    ("flag", " -u|--user", re.compile(r"(?:\s-u\s*|--user[ =])\S*?:'([^'\n]+)'")),
    ("flag", " -u|--user", re.compile(r"(?:\s-u\s*|--user[ =])[\w.-]+:([^\s'\"]+)")),
    ("flag", " -p", re.compile(r"\b(?:mysql|mysqldump|mariadb|sshpass|mongo|psql)\b[^|;]*?\s-p\s?'([^'\n]+)'")),
    ("flag", " --", re.compile(r"(?i)\s--(?:password|token|secret|api-key)[ =]['\"]?([^\s'\"-][^\s'\"]*)")),
    ("stdin", "echo", re.compile(r"\becho\s+(?:-n\s+)?'([^'\n]+)'\s*\|[^|]*password")),
    ("header", "bearer|basic|token", re.compile(r"(?i)\b(?:bearer|basic|token)\s+([A-Za-z0-9+/_.=~-]{8,})")),
)
_HINT = re.compile("|".join(re.escape(h) for _, hints, _ in _FORMS for h in hints.split("|")))
_FORMS = tuple((kind, tuple(hints.split("|")), form) for kind, hints, form in _FORMS)
_SKIP = frozenset(
    "string String final static private public const var let export readonly set ENV ARG value setProperty builder exports process env os environ client connect property name props s self this new echo run RUN was old rotate me todo remove".split()
)


#: Fixed value: words that are written together with one of SECRET_WORDS.
_JOINED = re.compile(r"^(access|admin|api|auth|client|db|encryption|ftp|hmac|master|private|refresh|root|secret|service|session|signing|smtp|ssh|user)(password|passwd|passphrase|token|secret|key|pass|pwd)$")


def words_of(key: str) -> list[str]:
    """The lower-case parts of an identifier in any style, common compounds included."""
    out: list[str] = []
    for w in re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key).lower()):
        m = _JOINED.match(w)
        out += m.groups() if m else (w,)
    return out


def _key(prefix: str, before: str) -> str:
    """The identifier that names the value after `prefix`; `before` is the name given on the line above."""
    for m in reversed(_IDENT.findall(prefix)):
        if m not in _SKIP:
            return m
    return before


#: Within a key block: header fields, what parts its pieces, and the pieces themselves; what of a block follows its header on the same line.
_FIELD = re.compile(r"(?:Proc-Type|DEK-Info|Content-Domain|Key-Info|MIC-Info|Originator-[\w-]+|Recipient-[\w-]+|Version|Comment|Hash|Charset|MessageID)\s*:")
_PARTS = re.compile(r"(?:\\+[nrt]|[\s\"'`“”,;()\\|>#&])+")
_PIECE = re.compile(r"(?:[A-Za-z0-9+/=*•…-]|\.{3})+|\[[A-Za-z ]*\]|<[A-Za-z ]*>?")
_INLINE = re.compile(r"(?:(?:\\+[nrt]|\s)*(?:[A-Za-z0-9+/=*•…]{16,}|[*•.…]{3,}))*(?:(?:\\+[nrt]|\s)*[A-Za-z0-9+/]*=+)?")
_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_CLOSED = re.compile(r"(?:\\+[nrt])*[\"'`]*")


def _material(line: str) -> int:
    """2 if a line can only be a part of a key block, 1 if it may be one (blank, glue, a short piece), 0 if not."""
    pieces = [w for w in _PARTS.split(line.replace(" + ", "+")) if w.strip("+-*/.") or MASK.search(w)]
    if pieces and _FIELD.match(line.lstrip(" \t\"'`+#*")):
        return 2
    if not all(map(_PIECE.fullmatch, pieces)) or TOKEN.search(line):
        return 0
    long = [w for w in pieces if len(w) >= 16 or MASK.search(w)]
    return 2 if long and len(pieces) - len(long) <= pieces[-1].endswith("=") else 1 if len(pieces) < 2 else 0


def _block_end(lines: list[str], at: int, label: str) -> tuple[int, int, set[int]]:
    """(last line, column after it, lines within that aren't key material) of the block whose header is on line `at`.

    A block ends at its END if most of its lines are material, else with the last line that is surely material;
    without any it is its header's line alone, and the column is -1.
    """
    sure, last, run, odd = 0, at, True, set()
    for i in range(at + 1, len(lines)):
        line = lines[i]
        end, begin = line.find("-----END"), line.find("-----BEGIN")
        if end >= 0 and not 0 <= begin < end:
            if len(odd) <= sure and (not odd or line.startswith(label, end + 8)):
                tail = line.find("-----", end + 8)
                return i, tail + 5 if tail >= 0 else len(line), odd
            break
        if begin >= 0:
            break
        kind = _material(line)
        if not kind:
            odd.add(i)
        sure += kind == 2
        # without an END, the block goes on to the first line that isn't material; a short piece may follow the last long one
        run = run and kind > 0
        if run and (kind == 2 or last == i - 1 > at and line.strip()):
            last = i
    return last, len(lines[last]) if last > at else -1, set()


def candidates(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(line_no, start, end, key, value, kind) for the literal values of a text; offsets in its characters.

    Values in several quoted pieces, on one line or on the lines after an opening bracket, are one value at
    their first piece. A key block is one value from its first to its last line; what stands beside it on those
    lines is searched like any other text.
    """
    out: list[tuple[int, int, int, str, str, str]] = []
    at, before, opened, pending = 0, "", "", None
    lines = text.split("\n")
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0)) if "-----BEGIN" in text else []
    until, after, odd = -1, 0, set()  # the key block that is open: its last line, the column after it, lines to be searched all the same
    for no, line in enumerate(lines, 1):
        here, at = at, at + len(line) + 1
        if no - 1 < until and no - 1 not in odd:  # inside a key block
            continue
        whole, pos = True, 0
        if no - 1 == until:
            pos = _CLOSED.match(line, after).end()
            line, whole = " " * pos + line[pos:], False
        while starts and (m := BLOCK.search(line, pos)):
            end, begin = line.find("-----END", m.end()), line.find("-----BEGIN", m.end())
            key = _key(line[: m.start()], before)
            if end >= 0 and not 0 <= begin < end:
                tail = line.find("-----", end + 8)
                pos = tail + 5 if tail >= 0 else len(line)
                out.append((no, here + m.start(), here + pos, key, line[m.start() : pos], "block"))
                if not _material(line[m.end() : end]):  # the two ends may be two literals: what is between is searched
                    line, whole = line[: m.start()] + " " * (m.end() - m.start()) + line[m.end() : end] + " " * (pos - end) + line[pos:], False
                    continue
            else:
                until, after, odd = _block_end(lines, no - 1, m[1] and " " + m[1]) if begin < 0 else (no - 1, -1, set())
                if after < 0:  # a header without a block
                    pos = _INLINE.match(line, m.end()).end()
                    out.append((no, here + m.start(), here + pos, key, line[m.start() : pos], "block"))
                else:
                    pos = len(line)
                    rest = [x.strip() for x in lines[no : until + 1]]
                    out.append((no, here + m.start(), starts[until] + after, key, "\n".join([line[m.start() :], *rest]), "block"))
            line, whole = line[: m.start()] + " " * (pos - m.start()) + line[pos:], False
        if starts and "-----END" in line:  # an end without a block
            line, whole = _END.sub(lambda m: " " * len(m[0]), line), False
        bare_line = line.strip().rstrip(",;)")
        lone = bool(pending is not None or opened) and len(bare_line) > 2 and bare_line[0] in _Q and bare_line[-1] in _Q and not _QUOTED.sub("", bare_line).strip(" +\\")
        last = None
        for m in _QUOTED.finditer(line):
            v = next((g for g in m.groups() if g is not None), "")
            if line[m.end() : m.end() + 1] in ("]", ":"):  # the name itself
                continue
            if last is not None and _GLUE.match(line[last[2] : m.start()]):  # "a" + "b"
                row = out[last[0]]
                out[last[0]] = (row[0], row[1], here + m.end() - 1, row[3], row[4] + v, row[5])
                last = (last[0], last[1], m.end())
                continue
            if lone and pending is not None:
                row = out[pending]
                out[pending] = (row[0], row[1], here + m.end() - 1, row[3], row[4] + v, row[5])
                continue
            if len(v) >= 3 and (whole or v.strip()):
                out.append((no, here + m.start() + 1, here + m.end() - 1, opened if lone else _key(line[: m.start()], before), v, "quoted"))
                last = (len(out) - 1, m.start(), m.end())
                if lone:
                    pending = last[0]
        if not lone:
            pending = None
            m = _OPENING.search(line)
            opened = m[1] or _key(line[: m.start()], "") if m else ""
        low = line.lower()
        for kind, hints, form in _FORMS if _HINT.search(low) else ():
            if not any(h in low for h in hints):
                continue
            for m in form.finditer(line):
                if not whole and not m[1].strip():
                    continue
                named = line[: m.start(0 if kind == "header" else 1)]  # the scheme isn't the name
                out.append((no, here + m.start(1), here + m.end(1), _key(named, before), m[1], kind))
        if m := _BARE.match(line) or _SPACED.match(line):
            v = re.sub(r"\s+[#;].*$|\s*-->.*$", "", m[2]).strip().rstrip(";,")
            key = m[1].rpartition(":")[2]
            inner = re.match(r"([A-Za-z_]\w*)\s*=\s*(?=\S)", v)
            if inner and SECRET_WORDS.isdisjoint(words_of(key)):  # a remark before an assignment
                key, v = inner[1], v[inner.end() :]
            if len(v) >= 3 and v[0] not in _Q and (whole or " " * 16 not in v):
                at_ = here + line.index(v, m.start(2))
                out.append((no, at_, at_ + len(v), before if key == "value" and before else key, v, "bare"))
        for m in _PAIR.finditer(line):
            out.append((no, here + m.start(2), here + m.end(2), m[1], m[2], "pair"))
        for m in _ELEMENT.finditer(line):
            if whole or m[2].strip():
                out.append((no, here + m.start(2), here + m.end(2), m[1], m[2], "element"))
        for m in TOKEN.finditer(line):
            out.append((no, here + m.start(), here + m.end(), _key(line[: m.start()], before), m[0], "token"))
        m = re.match(r"\s*-?\s*name:\s*[\"']?([\w.-]+)[\"']?\s*$", line)
        before = m[1] if m else ""
    return out


def excluded(value: str) -> str:
    """Why a value can't be a live credential as it stands; '' if nothing says so."""
    if MASK.search(value):
        return "masked"
    if PLACEHOLDER.match(value.strip()):
        return "placeholder"
    return "reference" if REFERENCE.search(value) else ""


#: What only a number, a checksum, an id or an address without a login looks like.
_NUMERIC, _HASH = re.compile(r"[0-9:.,/ x-]+"), re.compile(r"[0-9A-Fa-f]{16,}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ADDRESS, _ALPHA = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s@]*"), re.compile(r"[A-Za-z_ -]+|[0-9.]+")


def weak_label(key: str, value: str, kind: str, words: list[str] | None = None) -> str:
    """A stratum '+reason' or '-reason' where patterns are sure; '' where they aren't. `words` are those of the key, if known.

    A name that speaks of a secret is sure only with a value of ten characters or more that has a digit and no blank, one
    that speaks about a secret only with plain words or numbers. The rest is left to the classifier.
    """
    words = words_of(key) if words is None else words
    if kind == "block":
        return "-masked" if MASK.search(value) else "+block" if "PRIVATE" in value[:60] else "-block"
    if why := excluded(value):
        return "-" + why
    if len(value) > 18 and (t := TOKEN.search(value)) and len(t[0]) > 0.6 * len(value):
        return "+token"
    if kind in ("userinfo", "dsn", "sql", "login", "flag", "stdin"):
        return "+" + kind
    about, secret = not ABOUT_WORDS.isdisjoint(words), not SECRET_WORDS.isdisjoint(words)
    strong = secret and len(value) >= 10 and re.search(r"[0-9]", value) and not re.search(r"[(){}\[\]\s]|://", value)
    if kind == "header":
        return "+header" if strong else ""
    if "://" in value and _ADDRESS.fullmatch(value):
        return "-url"
    if len(value) >= 16 and (about or not secret) and _HASH.fullmatch(value):
        return "-hash"
    if "/" in value and PATHLIKE.match(value) or value.startswith(("data:", "sha256:", "sha512-")):
        return "-path"
    if about:
        return "-about" if _ALPHA.fullmatch(value) else ""
    if secret:
        return "+named" if words[-1] in SECRET_WORDS and strong else ""
    if _NUMERIC.fullmatch(value) or re.fullmatch(r"[A-Za-z_]+[0-9]{0,2}|v?[0-9][0-9.]*(?:-(?:alpha|beta|rc)[0-9.]*)?", value):
        return "-plain"
    return "-code" if re.search(r"[(){}]|\s", value) else ""


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 32
    return np.where((c < 0) | (c > 94), 95, c)


def _pairs(values: pd.Series) -> np.ndarray:
    """Counts of neighbouring characters, 96 x 96: printable ASCII and one place for the rest."""
    v = list(values)
    if not v:
        return np.zeros(96 * 96, np.int64)
    c = _codes("".join(v))
    pair = c[:-1] * 96 + c[1:]
    inner = np.ones(len(pair), bool)
    ends = np.cumsum([len(x) for x in v])[:-1]
    inner[ends - 1] = False  # the last character of one value and the first of the next
    return np.bincount(pair[inner], minlength=96 * 96)


def _ratio(value: str, table: np.ndarray) -> float:
    """The mean log-likelihood ratio of the value's transitions."""
    c = _codes(value)
    return float(table[c[:-1] * 96 + c[1:]].mean()) if len(c) > 1 else 0.0


_KINDS = ("quoted", "bare", "pair", "element", "token", "block", "userinfo", "dsn", "sql", "login", "flag", "stdin", "header")


def _form(value: str, kind: str, why: str | None = None) -> list[float]:
    """What the value looks like; `why` is excluded(value), if known."""
    n = len(value)
    digits, upper, lower = sum(map(str.isdigit, value)), sum(map(str.isupper, value)), sum(map(str.islower, value))
    hexa = bool(HEX.match(value))
    why = excluded(value) if why is None else why
    return [
        *(float(kind == k) for k in _KINDS),
        float(why == "masked"), float(why == "placeholder"), float(why == "reference"),
        float(hexa and n >= 32), float(hexa and n == 40), float(bool(UUID.match(value))), float(value.isdigit()), float("/" in value), float("://" in value),
        float(" " in value), float(bool(re.search(r"[(){}\[\]]", value))), float(value.isalpha()), float("PRIVATE KEY" in value[:60]), float("PUBLIC" in value[:60]),
        min(n, 64) / 64, digits / max(n, 1), upper / max(n, 1), lower / max(n, 1), min(len(set(value)), 32) / 32,
    ]


class Model:
    """A fitted classifier: small enough to travel with the tasks."""

    def __init__(self, table: np.ndarray, words: dict[str, int], exts: dict[str, int]) -> None:
        self.table, self.words, self.exts = table, words, exts
        self.weights, self.mean, self.scale, self.platt = np.zeros(0), np.zeros(0), np.ones(0), (1.0, 0.0)

    def dense(self, key: np.ndarray, value: np.ndarray, kind: np.ndarray, why: str | None = None) -> tuple[np.ndarray, list[list[str]]]:
        """The features of the value and of the name as a whole; the parts of the names."""
        rows, parts = [], []
        for k, v, d in zip(key, value, kind, strict=True):
            words, ratio = words_of(k), _ratio(v, self.table)
            rows.append([*_form(v, d, why), ratio, ratio * min(len(v), 40) / 40, float(not words), float(bool(words) and words[-1] in self.words)])
            parts.append(words)
        return np.array(rows, float), parts

    def named(self, parts: list[list[str]], path: np.ndarray) -> list[list[int]]:
        """The places of the features that the parts of a name and the file's extension switch on."""
        out = []
        for words, p in zip(parts, path, strict=True):
            on = {self.words[w] for w in words if w in self.words}
            e = self.exts.get((p or "").rpartition(".")[2].lower()[:8])
            out.append([*on, *([len(self.words) + e] if e is not None else [])])
        return out

    def features(self, key: np.ndarray, value: np.ndarray, kind: np.ndarray, path: np.ndarray) -> np.ndarray:
        x, parts = self.dense(key, value, kind)
        more = np.zeros((len(x), len(self.words) + len(self.exts)))
        for row, on in zip(more, self.named(parts, path), strict=True):
            row[on] = 1
        return np.c_[x, more]

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, ridge: float = 2.0, rounds: int = 12) -> Model:
        """Newton steps on the rows not held out, then Platt's scaling on those held out."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.weights = _newton(z[~held], y[~held], ridge, rounds)
        s = z[held] @ self.weights
        if held.sum() > 20 and 0 < y[held].sum() < held.sum():
            a = _newton(np.c_[s, np.ones(len(s))], y[held], 1e-2, 12)
            self.platt = (float(a[0]), float(a[1]))
        return self

    def score(self, key: np.ndarray, value: np.ndarray, kind: np.ndarray, path: np.ndarray, why: str | None = None) -> np.ndarray:
        """Calibrated probabilities; the same as over features(), without building the wide rows. `why` is '' if the values are known not to be excluded."""
        if not len(key) or not len(self.weights):
            return np.zeros(len(key))
        x, parts = self.dense(key, value, kind, why)
        w = self.weights[:-1] / self.scale
        base = self.weights[-1] - float(self.mean @ w)
        tail = w[x.shape[1] :].tolist()
        s = x @ w[: x.shape[1]] + base + np.array([sum(tail[i] for i in on) for on in self.named(parts, path)])
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * s + self.platt[1], -30, 30)))


def _newton(z: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


#: The weak labels that are exact: nothing with one of them is a credential.
RULED_OUT = ("-masked", "-placeholder", "-reference", "-block", "-plain", "-url", "-hash", "-about")
_CANDIDATES = "tbl string, row_key bigint, path string, line_no int, start int, end int, key string, value string, kind string, stratum string"


#: So many labels, of values of up to so many characters, are remembered by a task: most values occur again and again.
_REMEMBERED, _SHORT = 100_000, 200


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, list[str]] = {}
    labels: dict[tuple[str, str, str], str] = {}

    def label(what: tuple[str, str, str]) -> str:
        key = what[0]
        if (known := labels.get(what)) is not None:
            return known
        if len(words) > _REMEMBERED:
            words.clear()
        if len(labels) > _REMEMBERED:
            labels.clear()
        if key not in words:
            words[key] = words_of(key)
        out = weak_label(*what, words[key])
        if len(what[1]) <= _SHORT:
            labels[what] = out
        return out

    for b in batches:
        rows = [(t, r, p, *c, label(c[3:])) for t, r, p, text in zip(b["tbl"], b["row_key"], b["path"], b["text"], strict=True) for c in candidates(text)]
        yield pd.DataFrame(rows, columns=["tbl", "row_key", "path", "line_no", "start", "end", "key", "value", "kind", "stratum"])


def texts(findings: DataFrame, source_files: DataFrame) -> DataFrame:
    """(tbl, row_key, path, text) of both tables; rows with a null key or text are left out."""
    a = findings.select(F.lit("findings").alias("tbl"), F.col("finding_key").alias("row_key"), F.col("file").alias("path"), F.col("evidence").alias("text"))
    b = source_files.select(F.lit("source_files").alias("tbl"), F.col("file_key").alias("row_key"), F.col("rel_path").alias("path"), F.col("content").alias("text"))
    return a.unionAll(b).where("row_key IS NOT NULL AND text IS NOT NULL")


def extracted(rows: DataFrame) -> DataFrame:
    """The candidates of all texts with their weak labels, written once."""
    return written(rows.mapInPandas(_extract, _CANDIDATES), "candidates")


def train(cands: DataFrame, per_stratum: int = SAMPLE_PER_STRATUM) -> Model:
    """The classifier from weak labels. Chains and strata are counted over all candidates; at most
    `per_stratum` rows of each stratum, taken by hash, are fitted."""
    labelled = cands.where("stratum <> ''")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {True: np.zeros(96 * 96, np.int64), False: np.zeros(96 * 96, np.int64)}
        for b in batches:
            good = b["stratum"].str.startswith("+")
            totals[True] += _pairs(b["value"][good])
            totals[False] += _pairs(b["value"][~good])
        for good, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"good": good, "pair": at, "n": n[at]})

    counts = labelled.select("value", "stratum").mapInPandas(count, "good boolean, pair int, n bigint").groupBy("good", "pair").agg(F.sum("n").alias("n")).collect()
    n = {True: np.ones(96 * 96), False: np.ones(96 * 96)}
    for r in counts:
        n[r["good"]][r["pair"]] += r["n"]
    chain = {g: np.log(v.reshape(96, 96) / v.reshape(96, 96).sum(1, keepdims=True)).ravel() for g, v in n.items()}
    strata = {r["stratum"]: r["n"] for r in labelled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not strata:
        return Model(chain[True] - chain[False], {}, {})
    share = F.create_map(*(F.lit(x) for s, c in strata.items() for x in (s, min(1.0, per_stratum / c))))
    u = F.pmod(F.xxhash64("tbl", "row_key", "start", "kind"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.where(u < F.element_at(share, F.col("stratum"))).select("key", "value", "kind", "path", "stratum", u.alias("u")).limit(2 * per_stratum * len(strata)).toPandas()
    sample = sample.sort_values(["stratum", "u", "key", "value"], ignore_index=True)
    seen: dict[str, int] = {}
    exts: dict[str, int] = {}
    for k in sample["key"]:
        for w in set(words_of(k)):
            seen[w] = seen.get(w, 0) + 1
    for p in sample["path"]:
        e = (p or "").rpartition(".")[2].lower()[:8]
        exts[e] = exts.get(e, 0) + 1
    words = {w: i for i, w in enumerate(sorted(seen, key=lambda w: (-seen[w], w))[:WORDS])}
    model = Model(chain[True] - chain[False], words, {e: i for i, e in enumerate(sorted(exts, key=lambda e: (-exts[e], e))[:16])})
    x = model.features(sample["key"], sample["value"], sample["kind"], sample["path"])
    y = sample["stratum"].str.startswith("+").to_numpy(float)
    held = (np.arange(len(sample)) * 2654435761 % 1000) < 200
    return model.fit(x, y, held)


def scored(cands: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(tbl, row_key, line_no, start, end, kind, score) of the candidates that are credentials.

    What the exact check rules out isn't scored: what is masked, a placeholder, a reference, a public key, an
    address without a login, a plain word or number under a name that speaks about a secret, and under one that
    speaks of none also a checksum or an id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                # equal values under equal names are scored once
                codes, _ = pd.factorize(b["key"] + "\0" + b["kind"] + "\0" + b["path"].fillna("").str.rpartition(".")[2] + "\0" + b["value"])
                u = b.iloc[np.unique(codes, return_index=True)[1]]
                b = b.assign(score=model.score(u["key"], u["value"], u["kind"], u["path"], why="")[codes])
                yield b.loc[b["score"] >= cut, ["tbl", "row_key", "line_no", "start", "end", "kind", "score"]]

    open_ = cands.where(~F.col("stratum").isin(*RULED_OUT))
    return open_.select("tbl", "row_key", "path", "line_no", "start", "end", "key", "value", "kind").mapInPandas(run, "tbl string, row_key bigint, line_no int, start int, end int, kind string, score double")


def credentials(findings: DataFrame, source_files: DataFrame) -> DataFrame:
    """scored() over both tables, with a classifier trained on them; written. Empty tables give no rows.

    The candidates, which hold the values in clear, are deleted from the shared folder once they are scored.
    """
    cands = extracted(texts(findings, source_files))
    found = written(scored(cands, train(cands)), "credentials")
    drop_tables(cands.sparkSession, cands)
    return found


def credential_lines(findings: DataFrame, source_files: DataFrame) -> DataFrame:
    """(tbl, row_key, line_no): the lines on which at least one live credential starts."""
    return credentials(findings, source_files).select("tbl", "row_key", "line_no").distinct()


def redacted_text(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with each span replaced by a mark; overlapping spans are one, line ends within a span stay."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], REDACTED, "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, row_key, n_credentials, text): the texts that hold credentials, with those redacted and all else as it was."""
    spans = found.groupBy("tbl", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [[(int(s["start"]), int(s["end"])) for s in x] for x in b["spans"]]
            new = [redacted_text(t, p) for t, p in zip(b["text"], pairs, strict=True)]
            yield pd.DataFrame({"tbl": b["tbl"], "row_key": b["row_key"], "n_credentials": [t.count(REDACTED) - o.count(REDACTED) for t, o in zip(new, b["text"], strict=True)], "text": new})

    return rows.select("tbl", "row_key", "text").join(spans, ["tbl", "row_key"]).mapInPandas(run, "tbl string, row_key bigint, n_credentials int, text string")
