"""Deeply nested advisory documents as flat tables, one for each level and structural variant.

A bottom-up tree automaton gives each object a state from its own level and the states of its parts. The
states are written as text: a scalar is `null` or `text`, an object is `level(part, ...)` over the parts that
the level knows, a list is `[state, ...]` over its distinct states and an object in place of a list is its
state alone. Rows are then routed by state to the tables of their type; all keep the keys of the common
supertype (the positions on the way down), which are the links to the parent.

A document in which every list is one of objects (or an object in its place) and every text is a scalar is
read into typed records at once; any other is taken apart node by node. Both give the same records and states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from siftline.functions.documents import as_array, as_object, member, read_document, text_of
from siftline.functions.text import let

#: The bounds an event may give. Fixed values.
BOUNDS = ("introduced", "fixed", "last_affected")
#: The keys that every table of a level has: those of the levels above and its own position.
KEYS = {
    "vulnerabilities": ["raw_id", "vuln_pos"],
    "affected": ["raw_id", "vuln_pos", "affected_pos"],
    "ranges": ["raw_id", "vuln_pos", "affected_pos", "range_pos"],
    "events": ["raw_id", "vuln_pos", "affected_pos", "range_pos", "event_pos"],
}


def _listing(v: Column) -> Column:
    """(form, items): `array` or `object` and the elements; null and no element for anything else. Each cast is evaluated once."""
    none = F.struct(F.lit(None).cast("string").alias("form"), F.array().cast("array<variant>").alias("items"))
    one = F.struct(F.lit("object").alias("form"), F.array(v).alias("items"))
    return let(as_array(v), lambda a: F.when(a.isNotNull(), F.struct(F.lit("array").alias("form"), a.alias("items"))).when(as_object(v).isNotNull(), one).otherwise(none))


def _list_state(form: Column, states: Column) -> Column:
    """The state of a list (or of an object in its place) from those of its elements."""
    inner = F.array_join(F.array_sort(F.array_distinct(states)), ",")
    return F.when(form == "object", inner).when(form == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise("null")


def _state(level: str, v: Column, parts: list[Column]) -> Column:
    """δ(level, states of the parts); a thing that is no object has the state `null` or `alien`."""
    named = F.concat(F.lit(level + "("), F.array_join(F.array(*parts), ","), F.lit(")"))
    return F.when(as_object(v).isNotNull(), named).when(text_of(v).isNull() & as_array(v).isNull(), F.lit("null")).otherwise("alien")


def _event(v: Column) -> Column:
    def typed(texts: Column) -> Column:
        each = [(b, texts[i]) for i, b in enumerate(BOUNDS)]
        return F.struct(_state("event", v, [F.when(t != "", F.lit(b)) for b, t in each]).alias("state"), *(t.alias(b) for b, t in each))

    return let(F.array(*(text_of(member(v, b)) for b in BOUNDS)), typed)


def _parent(v: Column, key: str, child: Callable[[Column], Column], typed: Callable[[Column, Column], Column]) -> Column:
    """`typed(state of the list under key, its typed elements)`, both computed once."""
    return let(_listing(member(v, key)), lambda x: let(F.transform(x["items"], child), lambda c: typed(_list_state(x["form"], F.transform(c, lambda e: e["state"])), c)))


def _range(v: Column) -> Column:
    def typed(state: Column, events: Column) -> Column:
        kind = lambda k: F.struct(_state("range", v, [F.when(k.isNotNull(), F.lit("type")), F.concat(F.lit("events="), state)]).alias("state"), k.alias("range_type"), events.alias("events"))
        return let(text_of(member(v, "type")), kind)

    return _parent(v, "events", _event, typed)


def _affected(v: Column) -> Column:
    def typed(state: Column, ranges: Column) -> Column:
        package = member(v, "package")
        return F.struct(
            _state("affected", v, [F.when(as_object(package).isNotNull(), F.lit("package")), F.concat(F.lit("ranges="), state)]).alias("state"),
            text_of(member(package, "name")).alias("package"),
            text_of(member(package, "ecosystem")).alias("ecosystem"),
            F.transform(_listing(member(v, "versions"))["items"], text_of).alias("versions"),
            ranges.alias("ranges"),
        )

    return _parent(v, "ranges", _range, typed)


def _vulnerability(v: Column) -> Column:
    def typed(state: Column, affected: Column) -> Column:
        ident = text_of(member(v, "id"))
        return F.struct(
            _state("vuln", v, [F.when(ident.isNotNull(), F.lit("id")), F.concat(F.lit("affected="), state)]).alias("state"),
            ident.alias("vuln_id"),
            text_of(member(v, "summary")).alias("summary"),
            F.transform(_listing(member(v, "aliases"))["items"], text_of).alias("aliases"),
            affected.alias("affected"),
        )

    return _parent(v, "affected", _affected, typed)


# The parts of a document that are lists of objects, lists of texts, and texts.
_LISTS, _TEXT_LISTS, _TEXTS = ("vulns", "affected", "ranges", "events"), ("aliases", "versions"), ("id", "summary", "name", "ecosystem", "type", *BOUNDS)
_EVENT = "introduced: string, fixed: string, last_affected: string"
_RANGE = f"type: string, eventsForm: string, events: array<struct<{_EVENT}>>"
_TYPED = f"id: string, summary: string, aliases: array<string>, affectedForm: string, affected: array<struct<package: struct<name: string, ecosystem: string>, versions: array<string>, rangesForm: string, ranges: array<struct<{_RANGE}>>>>"


def shaped(x: dict) -> bool:
    """Whether the parts of an object, whose keys are in lower case, can be read as typed records.

    An object in place of a list becomes a list of it, which is noted under a key that no other can be equal to.
    """
    for k, v in tuple(x.items()):
        if v is None or type(v) is str:
            if k in _LISTS or k in _TEXT_LISTS or k == "package":
                if v is not None:
                    return False
        elif k in _LISTS:
            if type(v) is dict:
                x[k], x[f"{k}Form"] = [v], "object"
            elif type(v) is not list or not all(e is None or type(e) is dict for e in v):
                return False
        elif k in _TEXT_LISTS:
            if type(v) is not list or any(isinstance(e, list | dict) for e in v):
                return False
        elif k == "package":
            if type(v) is not dict:
                return False
        elif k in _TEXTS and isinstance(v, list | dict):
            return False
    return True


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("regular", BooleanType())]))
def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([read_document(p if isinstance(p, str) else None, shaped) for p in b], columns=["text", "regular"])


def _typed_list(form: Column, items: Column, typed: Callable[[Column], Column], then: Callable[[Column, Column], Column]) -> Column:
    """`then(state, elements)` of a list of records, typed."""
    how = F.when(items.isNotNull(), F.coalesce(form, F.lit("array")))
    return let(F.transform(items, typed), lambda c: then(_list_state(how, F.transform(c, lambda e: e["state"])), c))


def _records(items: Column) -> Column:
    """The same as _vulnerability() over an array of typed records."""
    named = lambda x, level, *parts: F.when(x.isNull(), "null").otherwise(F.concat(F.lit(level + "("), F.concat_ws(",", *parts), F.lit(")")))

    def event(e: Column) -> Column:
        return F.struct(named(e, "event", *(F.when(e[b] != "", F.lit(b)) for b in BOUNDS)).alias("state"), *(e[b].alias(b) for b in BOUNDS))

    def range_(r: Column) -> Column:
        def done(state: Column, events: Column) -> Column:
            return F.struct(named(r, "range", F.when(r["type"].isNotNull(), F.lit("type")), F.concat(F.lit("events="), state)).alias("state"), r["type"].alias("range_type"), _or_empty(events, _EVENTS).alias("events"))

        return _typed_list(r["eventsForm"], r["events"], event, done)

    def affected(a: Column) -> Column:
        def done(state: Column, ranges: Column) -> Column:
            p = a["package"]
            return F.struct(
                named(a, "affected", F.when(p.isNotNull(), F.lit("package")), F.concat(F.lit("ranges="), state)).alias("state"),
                p["name"].alias("package"), p["ecosystem"].alias("ecosystem"), _or_empty(a["versions"], "array<string>").alias("versions"), _or_empty(ranges, _RANGED).alias("ranges"),
            )

        return _typed_list(a["rangesForm"], a["ranges"], range_, done)

    def vulnerability(v: Column) -> Column:
        def done(state: Column, parts: Column) -> Column:
            return F.struct(
                named(v, "vuln", F.when(v["id"].isNotNull(), F.lit("id")), F.concat(F.lit("affected="), state)).alias("state"),
                v["id"].alias("vuln_id"), v["summary"].alias("summary"), _or_empty(v["aliases"], "array<string>").alias("aliases"), _or_empty(parts, _AFFECTED).alias("affected"),
            )

        return _typed_list(v["affectedForm"], v["affected"], affected, done)

    return F.transform(items, vulnerability)


_EVENTS = "array<struct<state: string, introduced: string, fixed: string, last_affected: string>>"
_RANGED = f"array<struct<state: string, range_type: string, events: {_EVENTS}>>"
_AFFECTED = f"array<struct<state: string, package: string, ecosystem: string, versions: array<string>, ranges: {_RANGED}>>"


def _or_empty(items: Column, kind: str) -> Column:
    return F.coalesce(items, F.array().cast(kind))


def classified(raw: DataFrame) -> DataFrame:
    """(raw_id, envelope, vulns): each payload's vulnerabilities as typed nested records with their states.

    envelope is `one`, `list`, `vulns` or `none` (invalid JSON, a scalar or null). Key case doesn't matter, a
    number counts as its text, a payload that is a JSON string of a payload is opened once. Null raw_ids stay
    as they are; other columns of `raw` don't matter.
    """
    d = raw.select("raw_id", _read("payload").alias("d")).select("raw_id", "d.text", "d.regular")
    is_list = F.startswith("text", F.lit("["))
    root = F.from_json("text", f"array<struct<vulns: array<struct<{_TYPED}>>, {_TYPED}>>")
    d = d.select("raw_id", "text", "regular", F.when(F.col("regular"), F.when(is_list, F.lit("list")).when(F.get(root, 0)["vulns"].isNotNull(), "vulns").otherwise("one")).alias("form"), F.when(F.col("regular"), root).alias("root"), F.when(~F.col("regular"), F.try_parse_json("text")).alias("v"))
    own = F.transform("root", lambda r: r.dropFields("vulns"))
    fast = _records(F.when(F.col("form") == "vulns", F.get("root", 0)["vulns"]).otherwise(own))
    w, l = _listing(member(F.col("v"), "vulns")), _listing(F.col("v"))
    slow = let(w, lambda w: let(l, lambda l: F.struct(
        F.when(w["form"].isNotNull(), "vulns").when(l["form"] == "object", "one").when(l["form"] == "array", "list").otherwise("none").alias("envelope"),
        F.transform(F.when(w["form"].isNotNull(), w["items"]).otherwise(l["items"]), _vulnerability).alias("vulns"),
    )))
    both = d.select("raw_id", F.when(F.col("regular"), F.struct(F.col("form").alias("envelope"), fast.alias("vulns"))).otherwise(slow).alias("x"))
    return both.select("raw_id", "x.envelope", "x.vulns")


def flat_tables(raw: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of each level, and of each variant of events. `docs`: classified(raw), where it is at hand.

    vulnerabilities, affected, ranges and events hold every list element, null entries included, with its
    state and the keys of KEYS. events_introduced, events_fixed and events_last_affected are the subtypes of
    events by the bound they give, with version_text; events_other are those that give none. All narrow: a
    document is taken apart where it lies, without a shuffle.
    """
    docs = classified(raw) if docs is None else docs
    # outer, so that no filter on the list's size makes the plan build the list twice
    vulns = docs.select("raw_id", "envelope", F.posexplode_outer("vulns").alias("vuln_pos", "x")).where("vuln_pos IS NOT NULL").select("raw_id", "envelope", "vuln_pos", "x.*")
    aff = vulns.select("raw_id", "vuln_pos", F.posexplode("affected").alias("affected_pos", "x")).select(*KEYS["affected"], "x.*")
    ranges = aff.select(*KEYS["affected"], F.posexplode("ranges").alias("range_pos", "x")).select(*KEYS["ranges"], "x.*")
    events = ranges.select(*KEYS["ranges"], F.posexplode("events").alias("event_pos", "x")).select(*KEYS["events"], "x.*")
    out = {"vulnerabilities": vulns.drop("affected"), "affected": aff.drop("ranges"), "ranges": ranges.drop("events"), "events": events}
    routed = route(events)
    out |= {f"events_{b}": routed.where(F.col("bound") == b).drop("bound") for b in BOUNDS}
    out["events_other"] = events.where(~F.coalesce(F.col("state").rlike("|".join(BOUNDS)), F.lit(False))).select(*KEYS["events"], "state")
    return out


def route(events: DataFrame) -> DataFrame:
    """One row for each subtype that an event's state names: the supertype's keys, bound and version_text."""
    texts = F.array(*(F.struct(F.lit(b).alias("bound"), F.col(b).alias("version_text")) for b in BOUNDS))
    held = F.filter(texts, lambda x: F.array_contains(F.split(F.regexp_extract("state", r"^event\((.*)\)$", 1), ","), x["bound"]))
    return events.select(*KEYS["events"], F.explode(held).alias("x")).select(*KEYS["events"], "x.*")


def version_bounds(raw: DataFrame) -> DataFrame:
    """(raw_id, vuln_pos, affected_pos, range_pos, event_pos, bound, version_text): the three event subtypes together."""
    return route(flat_tables(raw)["events"])
