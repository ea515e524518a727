"""Nested rule sets of smart albums, compiled to one Column.

Logic is two-valued: each leaf is true or false also where the field is null, so groups and
negations need no third value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.operators.filters import all_of, any_of, holds

TEXT = {"name", "caption", "camera", "lens", "city", "country", "folder"}
NUMBER = {"rating", "iso", "aperture", "width", "height", "size"}
DATE = {"captured", "imported"}
CHOICE = {"flag", "label", "kind"}
BOOL = {"edited", "deleted"}
OPS = {
    "text": ("contains", "notContains", "is", "isNot", "startsWith", "endsWith", "isEmpty", "isNotEmpty"),
    "number": ("is", "isNot", "gt", "gte", "lt", "lte", "between"),
    "date": ("is", "isNot", "after", "before", "between", "inLast", "notInLast", "isEmpty", "isNotEmpty"),
    "choice": ("is", "isNot"),
    "bool": ("is", "isNot"),
    "keywords": ("is", "isNot", "contains", "notContains", "isEmpty", "isNotEmpty"),
    "album": ("is", "isNot"),
}
_SECONDS = {"hours": 3600.0, "days": 86400.0, "weeks": 7 * 86400.0, "months": 30.4375 * 86400, "years": 365.25 * 86400}
_SYNONYMS = {"picked": "pick", "rejected": "reject"}


def kind_of(field: str) -> str | None:
    for kind, names in (("text", TEXT | {"text"}), ("number", NUMBER), ("date", DATE), ("choice", CHOICE), ("bool", BOOL), ("keywords", {"keywords"}), ("album", {"album"})):
        if field in names:
            return kind
    return None


def problems(rules: dict) -> list[str]:
    """What is wrong with a rule set, depth first."""
    found = []
    for r in rules.get("rules", []):
        if "rules" in r:
            found += problems(r)
        elif (kind := kind_of(r["field"])) is None:
            found.append(f"unknown field {r['field']}")
        elif r["op"] not in OPS[kind]:
            found.append(f"{r['field']}: unknown operator {r['op']}")
    return found


def _number(value) -> float | None:
    """Numbers may come as ``f/2.8`` or ``50mm``."""
    try:
        return float(str(value).strip().lower().removeprefix("f/").removesuffix("mm"))
    except ValueError:
        return None


def _text(c: Column, op: str, value) -> Column:
    own, words = F.lower(F.trim(F.coalesce(c, F.lit("")))), str(value or "").lower().split()
    v = str(value or "").strip().lower()
    if op == "contains":
        return all_of([F.contains(own, F.lit(w)) for w in words])
    if op == "notContains":
        return ~any_of([F.contains(own, F.lit(w)) for w in words])
    return {"is": own == v, "isNot": own != v, "startsWith": own.startswith(v), "endsWith": own.endswith(v), "isEmpty": own == "", "isNotEmpty": own != ""}[op]


def _numbers(c: Column, op: str, value) -> Column:
    c = c.cast("double")
    if op == "between":
        a, b = (_number(x) for x in value)
        if a is None or b is None:
            return F.lit(False)
        return holds((c >= min(a, b)) & (c <= max(a, b)))
    n = _number(value)
    if n is None:
        # Without a number to compare with, only an absent value can differ.
        return c.isNull() if op == "isNot" else F.lit(False)
    if op == "isNot":
        return F.coalesce(F.abs(c - n) >= 1e-6, F.lit(True))
    return holds({"is": F.abs(c - n) < 1e-6, "gt": c > n, "gte": c >= n - 1e-9, "lt": c < n, "lte": c <= n + 1e-9}[op])


def _dates(c: Column, op: str, value, now: str) -> Column:
    if op in ("isEmpty", "isNotEmpty"):
        return c.isNull() if op == "isEmpty" else c.isNotNull()
    if op in ("inLast", "notInLast"):
        span = value if isinstance(value, dict) else {"n": value, "unit": "days"}
        seconds = F.lit(float(span["n"]) * _SECONDS[span["unit"]])
        at = F.unix_timestamp(F.to_timestamp(F.substring(c, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
        edge = F.unix_timestamp(F.to_timestamp(F.lit(now), "yyyy-MM-dd'T'HH:mm:ss"))
        recent = holds(at.cast("double") >= edge - seconds)
        return recent if op == "inLast" else ~recent
    if op == "between":
        a, b = value
        return holds((c >= a) & ((c <= b) | c.startswith(b)))
    same = c.startswith(value)
    return holds({"is": same, "isNot": ~same, "after": (c > value) & ~same, "before": c < value}[op])


def _keywords(op: str, value) -> Column:
    keys, v = F.split("keywords", ";"), str(value or "").lower()
    if op in ("isEmpty", "isNotEmpty"):
        empty = F.size(keys) == 0
        return empty if op == "isEmpty" else ~empty
    if op in ("contains", "notContains"):
        found = F.exists(keys, lambda k: all_of([F.contains(F.lower(k), F.lit(w)) for w in v.split()]))
        return found if op == "contains" else ~found
    level = F.exists(keys, lambda k: (F.lower(k) == v) | F.array_contains(F.split(F.lower(k), r"\|"), v))
    return level if op == "is" else ~level


_JOINED = ("name", "caption", "camera", "lens", "city", "country", "folder", "keywords", "label", "kind")


def compile_rules(rules: dict, now: str = "1998-08-02T00:00:00", smart_albums: frozenset[int] = frozenset()) -> Column:
    """``{"match": all|any|none, "rules": [...]}`` -> a predicate. ``now`` is fixed by the caller,
    so a query that depends on the clock can be repeated. ``album`` is a row's regular album; nothing is in an
    album that is smart, or named by no number."""
    if found := problems(rules):
        raise ValueError("; ".join(found))
    parts = []
    for r in rules.get("rules", []):
        if "rules" in r:
            parts.append(compile_rules(r, now, smart_albums))
            continue
        field, op, value = r["field"], r["op"], r.get("value")
        kind = kind_of(field)
        if field == "text":
            part = _text(F.concat_ws(" ", *_JOINED), op, value)
        elif kind == "text":
            part = _text(F.col(field), op, value)
        elif kind == "number":
            part = _numbers(F.col(field), op, value)
        elif kind == "date":
            part = _dates(F.col(field), op, value, now)
        elif kind == "keywords":
            part = _keywords(op, value)
        elif kind == "album":
            number = _number(value)
            known = number is not None and number >= 0 and int(number) not in smart_albums
            held = (F.col(field) == int(number)) if known else F.lit(False)
            part = holds(held) if op == "is" else ~holds(held)
        elif kind == "bool":
            same = holds(F.col(field) == bool(value))
            part = same if op == "is" else ~same
        else:
            same = holds(F.lower(field) == _SYNONYMS.get(str(value).lower(), str(value).lower()))
            part = same if op == "is" else ~same
        parts.append(part)
    match = rules.get("match", "all")
    return {"all": all_of, "any": any_of, "none": lambda p: ~any_of(p)}[match](parts)
