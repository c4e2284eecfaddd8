"""Helpers for JSON documents of varying form: texts made plain, and the VARIANT type."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _refuse(x: str) -> None:
    raise ValueError(x)


_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')
#: Levels that are kept of a document; parsers have a bound of about a thousand.
LEVELS = 500


def shallow(text: str, levels: int = LEVELS) -> str:
    """`text` with null for every list or object below `levels` levels; ValueError if it isn't valid JSON, however deep."""
    if text.count("[") + text.count("{") <= levels:
        return text
    top, queue = None, [text]
    while queue:
        part = queue.pop()
        out, stack, at = [], [], 0
        for m in _MARK.finditer(part):
            c = m[0]
            if c in "[{":
                stack.append(c)
                if len(stack) == levels + 1:
                    out.append(part[at : m.start()])
                    at = m.start()
            elif c in "]}":
                if not stack or stack.pop() + c not in ("[]", "{}"):
                    raise ValueError("brackets")
                if len(stack) == levels:
                    queue.append(part[at : m.end()])
                    out.append("null")
                    at = m.end()
        kept = "".join([*out, part[at:]])
        if top is None:
            top = kept
        else:
            json.loads(kept)  # what is left out has to be valid, too
    return top


def read_document(payload: str | None, shape: Callable[[dict], bool] | None = None, unwrap: bool = True) -> tuple[str | None, bool]:
    """(text, regular): the document again with keys in lower case and each number as a string of its own text.

    text is null if it isn't valid JSON. Of keys that coincide, the last one's value counts. `unwrap`: a
    document that is one string is read once more. `shape` is called with every object and may change it; if it
    is true for all, and the document is an object or a list of objects, that is regular, else nothing is changed.
    """
    if payload is None:
        return None, False
    regular = shape is not None

    def lower(pairs: list[tuple[str, object]]) -> dict:
        nonlocal regular
        x = {k.lower(): v for k, v in pairs}
        regular = regular and shape(x)
        return x

    read = lambda text: json.loads(shallow(text), object_pairs_hook=lower, parse_float=str, parse_int=str, parse_constant=_refuse)
    try:
        x = read(payload)
        if unwrap and isinstance(x, str):
            x = read(x)
        if regular and (isinstance(x, dict) or isinstance(x, list) and all(isinstance(e, dict) for e in x)):
            return json.dumps(x), True
        return (json.dumps(x), False) if shape is None else read_document(payload, None, unwrap)
    except ValueError:
        return None, False


def plain_json_text(payload: str | None, unwrap: bool = True) -> str | None:
    """The text of read_document()."""
    return read_document(payload, None, unwrap)[0]


@F.pandas_udf(StringType())
def plain_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """plain_json_text() over a column."""
    for b in batches:
        yield b.map(plain_json_text, na_action="ignore").astype("object").where(lambda s: s.notna(), None)


def as_object(v: Column) -> Column:
    """A variant object as a map; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_array(v: Column) -> Column:
    """A variant array as an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_list(v: Column) -> Column:
    """A variant array as an array; an object as an array of it alone; otherwise empty."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(as_object(v).isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def member(v: Column, key: str) -> Column:
    """The value of the object's key (without dots); null if there is none."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_of(v: Column) -> Column:
    """A scalar's text; null for null, objects and arrays."""
    return F.when(as_object(v).isNull() & F.try_variant_get(v, "$", "array<variant>").isNull(), F.try_variant_get(v, "$", "string"))
