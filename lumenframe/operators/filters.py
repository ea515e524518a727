"""Filters of a media library, each compiled to one Column. Nulls never pass a filter."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """An unknown filter or a value that it does not accept."""


def holds(c: Column) -> Column:
    """Two-valued: an unknown predicate is false."""
    return F.coalesce(c, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _day_bounds(text: str, upper: bool) -> str:
    """A plain date as an upper bound covers its whole day."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ].*)?", text):
        raise FilterError(f"not a date: {text}")
    if upper and len(text) == 10:
        return (date.fromisoformat(text) + timedelta(days=1)).isoformat()
    return text


def _contains(c: str, value: str) -> Column:
    return holds(F.contains(F.lower(c), F.lit(value.lower())))


LIBRARY = ("taken_after", "taken_before", "year", "month", "place", "folder", "camera", "orientation", "min_megapixels", "has_gps", "frames")


def library_predicates(filters: dict) -> dict[str, Column]:
    """Name -> predicate over the columns of a photo table."""
    out = {}
    for name, value in filters.items():
        if name not in LIBRARY:
            raise FilterError(f"unknown filter {name}; accepted: {', '.join(LIBRARY)}")
        if name == "taken_after":
            p = F.col("captured") >= _day_bounds(value, False)
        elif name == "taken_before":
            bound = _day_bounds(value, True)
            p = F.col("captured") < bound if len(value) == 10 else F.col("captured") <= bound
        elif name == "year":
            if not 1800 <= value <= 2200:
                raise FilterError("year: 1800 to 2200")
            p = F.substring("captured", 1, 4) == f"{value:04d}"
        elif name == "month":
            if not 1 <= value <= 12:
                raise FilterError("month: 1 to 12")
            p = F.substring("captured", 6, 2) == f"{value:02d}"
        elif name == "place":
            p = any_of([_contains(c, value) for c in ("city", "region", "country")])
        elif name == "folder":
            p = F.contains(F.translate(F.col("path"), "\\", "/"), F.lit(value.replace("\\", "/")))
        elif name == "camera":
            p = _contains("camera", value)
        elif name == "orientation":
            if value not in ("landscape", "portrait"):
                raise FilterError("orientation: landscape, portrait")
            p = F.col("width") > F.col("height") if value == "landscape" else F.col("height") > F.col("width")
        elif name == "min_megapixels":
            p = F.col("width").cast("double") * F.col("height") / 1e6 >= value
        elif name == "has_gps":
            p = F.col("lat").isNotNull() if value else F.col("lat").isNull()
        else:
            if value not in ("include", "exclude", "only"):
                raise FilterError("frames: include, exclude, only")
            p = {"include": F.lit(True), "exclude": F.col("video_id").isNull(), "only": F.col("video_id").isNotNull()}[value]
        out[name] = holds(p)
    return out


def library_filter(photos: DataFrame, filters: dict) -> DataFrame:
    """Rows that pass all filters and are not missing."""
    return photos.where(~F.col("missing")).where(all_of(list(library_predicates(filters).values())))


def relaxation(photos: DataFrame, filters: dict) -> DataFrame:
    """For each filter, how many rows come back when it alone is dropped: one pass over the rows."""
    tests = library_predicates(filters)
    passing = [F.count_if(all_of([p for k, p in tests.items() if k != name])).alias(name) for name in tests]
    wide = photos.where(~F.col("missing")).agg(*passing)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n_rows")) for n in tests]))
    return wide.select(pairs.alias("p")).select("p.filter", "p.n_rows")


def merged_kind(name: Column) -> Column:
    """The kind of a merged picture, from its name's suffix without trailing digits, dashes, spaces."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[0-9 \-]+$", "")
    return F.when(stem.endswith("-HDR-Pano"), "hdr_pano").when(stem.endswith("-HDR"), "hdr").when(stem.endswith("-Pano"), "pano")


def in_folder(path: Column, folder: str, deep: bool = True) -> Column:
    """Below a folder, at any depth or as a direct child."""
    prefix = folder.rstrip("/") + "/"
    below = path.startswith(prefix)
    return below if deep else below & ~F.contains(F.substring(path, len(prefix) + 1, 100_000), F.lit("/"))


def under_keyword(keywords: Column, path: str) -> Column:
    """A keyword equal to ``path`` or below it, ignoring case."""
    p = path.lower()
    return F.exists(keywords, lambda k: (F.lower(k) == p) | F.lower(k).startswith(p + "|"))


TEXT_FIELDS = ("name", "caption", "camera", "lens", "city", "kind")
_NUMBERS = {"rating": "rating", "iso": "iso", "f": "aperture"}


def _free_token(token: str) -> Column:
    hits = [_contains(c, token) for c in TEXT_FIELDS]
    return any_of([*hits, F.exists(F.split("keywords", ";"), lambda k: F.contains(F.lower(k), F.lit(token)))])


def text_filter(text: str) -> Column:
    """White-space tokens, all of which must match: ``field:value`` with ``>``, ``<``, ``=`` for
    numbers, or a substring of any text field. An unknown field matches nothing."""
    parts = []
    for token in text.lower().split():
        field, sep, value = token.partition(":")
        if not sep:
            parts.append(_free_token(token))
        elif field in _NUMBERS:
            op = value[0] if value[:1] in "><=" else "="
            try:
                n = float(value.lstrip("><="))
            except ValueError:
                parts.append(F.lit(False))
                continue
            c = F.col(_NUMBERS[field])
            parts.append(holds({">": c > n, "<": c < n, "=": F.abs(c - n) < 1e-9}[op]))
        elif field in ("flag", "label", "kind"):
            parts.append(holds(F.lower(field) == value))
        elif field == "type":
            parts.append(holds(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)) == value))
        elif field in ("camera", "lens", "name"):
            parts.append(_contains(field, value))
        elif field == "keyword":
            parts.append(under_keyword(F.split("keywords", ";"), value))
        elif field == "edited":
            parts.append(F.col("edited") == (value in ("yes", "true", "1")))
        elif field == "date":
            parts.append(holds(F.col("captured").startswith(value)))
        else:
            parts.append(F.lit(False))
    return all_of(parts)


CATALOG = (
    "deleted", "folder", "subfolders", "rating", "rating_op", "flag", "label", "labels", "kind", "edited", "merged",
    "album", "date_from", "date_to", "date", "imported_from", "imported", "keyword", "camera", "lens", "text",
)


def catalog_filter(f: dict) -> Column:
    """The catalog's filter record as one predicate."""
    if unknown := set(f) - set(CATALOG):
        raise FilterError(f"unknown filter {sorted(unknown)}; accepted: {', '.join(CATALOG)}")
    parts = [F.col("deleted") == f.get("deleted", False)]
    if "folder" in f:
        parts.append(in_folder(F.col("path"), f["folder"], f.get("subfolders", True)))
    if f.get("rating", 0) > 0:
        c, n = F.col("rating"), f["rating"]
        parts.append({"at_least": c >= n, "exactly": c == n, "at_most": c <= n}[f.get("rating_op", "at_least")])
    for name in ("flag", "label", "kind", "edited", "album"):
        if name in f:
            parts.append(F.col(name) == f[name])
    if "labels" in f:
        parts.append(F.col("label").isin(list(f["labels"])))
    if "merged" in f:
        parts.append(merged_kind(F.col("name")) == f["merged"])
    moment = F.coalesce("captured", "imported")
    if "date_from" in f:
        parts.append(moment >= f["date_from"])
    if "date_to" in f:
        parts.append(F.substring(moment, 1, len(f["date_to"])) <= f["date_to"])
    if "date" in f:
        parts.append(moment.startswith(f["date"]))
    if "imported_from" in f:
        parts.append(F.col("imported") >= f["imported_from"])
    if "imported" in f:
        parts.append(F.col("imported").startswith(f["imported"]))
    if "keyword" in f:
        parts.append(under_keyword(F.split("keywords", ";"), f["keyword"]))
    if "camera" in f:
        parts.append(F.lower("camera") == f["camera"].lower())
    if "lens" in f:
        parts.append(_contains("lens", f["lens"]))
    if "text" in f:
        parts.append(text_filter(f["text"]))
    return all_of([holds(p) for p in parts])
