"""Queries of filters, rules, sorting and paging over the photo table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import filters as flt
from lumenframe.operators.rules import compile_rules
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos

OPEN = "NOT missing"


def _library(name: str, filters: dict, where: str) -> None:
    sql = f"{PHOTOS_SQL} SELECT id, captured FROM photos WHERE {OPEN} AND {where}"
    query(name, sql)(lambda spark, d: flt.library_filter(photos(spark, d), filters).select("id", "captured"))


_library("F01_taken_range", {"taken_after": "1995-03-01", "taken_before": "1995-03-31"}, "captured >= '1995-03-01' AND captured < '1995-04-01'")
_library("F02_year_month", {"year": 1996, "month": 7}, "captured LIKE '1996-07%'")
_library("F03_place", {"place": "rom"}, "(lower(city) LIKE '%rom%' OR lower(coalesce(region, '')) LIKE '%rom%' OR lower(country) LIKE '%rom%')")
_library("F04_folder", {"folder": "lib\\3"}, "contains(path, 'lib/3')")
_library("F05_camera", {"camera": "NIKON"}, "lower(camera) LIKE '%nikon%'")
_library("F06_orientation", {"orientation": "portrait"}, "height > width")
_library("F07_megapixels_gps", {"min_megapixels": 12.5, "has_gps": True}, "CAST(width AS DOUBLE) * height / 1e6 >= 12.5 AND lat IS NOT NULL")
_library("F08_frames_only", {"frames": "only", "year": 1997}, "video_id IS NOT NULL AND captured LIKE '1997%'")

_RELAX = {"year": 1996, "place": "roma", "camera": "canon", "orientation": "landscape"}
_RELAX_SQL = {"year": "captured LIKE '1996%'", "place": "(lower(city) LIKE '%roma%' OR lower(region) LIKE '%roma%' OR lower(country) LIKE '%roma%')", "camera": "lower(camera) LIKE '%canon%'", "orientation": "width > height"}


@query(
    "F10_relaxation",
    PHOTOS_SQL + " UNION ALL ".join(
        f"SELECT '{k}' AS filter, CAST(count(*) AS BIGINT) AS n_rows FROM photos WHERE NOT missing AND " + " AND ".join(v for j, v in _RELAX_SQL.items() if j != k) for k in _RELAX_SQL
    ),
)
def relaxation(spark, d):
    """Which filter, dropped alone, brings how many rows back."""
    return flt.relaxation(photos(spark, d), _RELAX)


_MOMENT = "coalesce(captured, imported)"
_STEM = r"regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[0-9 \-]+$', '')"
_KEYS = "string_split(keywords, ';')"
CATALOG = {
    "F21_folder": ({"folder": "/lib/3", "subfolders": False}, "starts_with(path, '/lib/3/') AND NOT contains(substr(path, 8), '/')"),
    "F22_rating": ({"rating": 3, "rating_op": "at_most"}, "rating <= 3"),
    "F23_choices": ({"flag": "pick", "labels": ["red", "blue"], "kind": "photo"}, "flag = 'pick' AND label IN ('red', 'blue') AND kind = 'photo'"),
    "F24_merged": ({"merged": "hdr_pano"}, f"suffix({_STEM}, '-HDR-Pano')"),
    "F25_album": ({"album": 7}, "album = 7"),
    "F26_date_bounds": ({"date_from": "1994-05-02", "date_to": "1994-06"}, f"{_MOMENT} >= '1994-05-02' AND substr({_MOMENT}, 1, 7) <= '1994-06'"),
    "F27_date_prefix": ({"date": "1995-1", "imported_from": "1995-10-15"}, f"starts_with({_MOMENT}, '1995-1') AND imported >= '1995-10-15'"),
    "F28_keyword": ({"keyword": "travel|ITALY"}, f"len(list_filter({_KEYS}, lambda k: lower(k) = 'travel|italy' OR starts_with(lower(k), 'travel|italy|'))) > 0"),
    "F29_camera_equal": ({"camera": "NIKON Z6"}, "lower(camera) = 'nikon z6'"),
    "F30_lens": ({"lens": "zoom"}, "contains(lower(lens), 'zoom')"),
    "F31_text": (
        {"text": "sunset urgent"},
        " AND ".join(f"(contains(lower(concat_ws(chr(1), name, caption, camera, lens, city, kind)), '{t}') OR len(list_filter({_KEYS}, lambda k: contains(lower(k), '{t}'))) > 0)" for t in ("sunset", "urgent")),
    ),
    "F32_fielded": ({"text": "rating:>3 iso:<800 camera:sony type:jpg f:=2.8 flag:none"}, "rating > 3 AND iso < 800 AND contains(lower(camera), 'sony') AND suffix(name, '.jpg') AND abs(aperture - 2.8) < 1e-9 AND flag = 'none'"),
}


def _catalog(name: str, f: dict, where: str) -> None:
    sql = f"{PHOTOS_SQL} SELECT id, name, rating FROM photos WHERE NOT deleted AND {where}"
    query(name, sql)(lambda spark, d: photos(spark, d).where(flt.catalog_filter(f)).select("id", "name", "rating"))


for _name, (_f, _w) in CATALOG.items():
    _catalog(_name, _f, _w)


@query(
    "F34_recently_added",
    PHOTOS_SQL + "SELECT id, imported FROM photos WHERE NOT deleted AND imported >= (SELECT substr(CAST(max(CAST(substr(imported, 1, 10) AS DATE)) - INTERVAL 30 DAY AS STRING), 1, 10) FROM photos)",
)
def recently_added(spark, d):
    """Imported in the 30 days before the latest import."""
    p = photos(spark, d)
    edge = p.agg(F.date_sub(F.max(F.substring("imported", 1, 10)).cast("date"), 30).cast("string").alias("edge"))
    return p.where("not deleted").join(F.broadcast(edge), F.col("imported") >= F.col("edge")).select("id", "imported")


_T = "lower(trim(coalesce({}, '')))"
RULES = {
    "F40_contains": ({"rules": [{"field": "caption", "op": "contains", "value": "rome sunset"}, {"field": "name", "op": "notContains", "value": "hdr 7"}]}, "contains(lower(coalesce(caption, '')), 'rome') AND contains(lower(coalesce(caption, '')), 'sunset') AND NOT (contains(lower(name), 'hdr') OR contains(lower(name), '7'))"),
    "F41_text_ops": ({"match": "any", "rules": [{"field": "camera", "op": "is", "value": " Nikon z6 "}, {"field": "lens", "op": "isEmpty"}, {"field": "name", "op": "endsWith", "value": "pano.jpg"}]}, f"({_T.format('camera')} = 'nikon z6' OR {_T.format('lens')} = '' OR suffix(lower(name), 'pano.jpg'))"),
    "F42_numbers": ({"rules": [{"field": "iso", "op": "isNot", "value": 400}, {"field": "rating", "op": "gte", "value": 2}, {"field": "aperture", "op": "lt", "value": "f/5.6"}]}, "(iso IS NULL OR abs(iso - 400) >= 1e-6) AND rating >= 2 - 1e-9 AND aperture < 5.6"),
    "F43_between": ({"rules": [{"field": "iso", "op": "between", "value": [1600, 400]}]}, "iso BETWEEN 400 AND 1600"),
    "F44_number_forms": ({"rules": [{"field": "aperture", "op": "is", "value": "f/2.8"}, {"field": "width", "op": "gt", "value": "3000mm"}]}, "abs(aperture - 2.8) < 1e-6 AND width > 3000"),
    "F45_dates": ({"rules": [{"field": "captured", "op": "after", "value": "1996-05"}, {"field": "imported", "op": "before", "value": "1997-02-10"}]}, "captured > '1996-05' AND NOT starts_with(captured, '1996-05') AND imported < '1997-02-10'"),
    "F46_date_between": ({"rules": [{"field": "captured", "op": "between", "value": ["1993-02", "1993-04"]}]}, "captured >= '1993-02' AND (captured <= '1993-04' OR starts_with(captured, '1993-04'))"),
    "F47_in_last": ({"rules": [{"field": "captured", "op": "notInLast", "value": {"n": 18, "unit": "months"}}, {"field": "imported", "op": "inLast", "value": {"n": 5, "unit": "years"}}]}, "NOT coalesce(epoch(CAST(captured AS TIMESTAMP)) >= epoch(TIMESTAMP '1998-08-02 00:00:00') - 18 * 30.4375 * 86400, false) AND epoch(CAST(imported AS TIMESTAMP)) >= epoch(TIMESTAMP '1998-08-02 00:00:00') - 5 * 365.25 * 86400"),
    "F48_choice_bool": ({"match": "none", "rules": [{"field": "flag", "op": "is", "value": "rejected"}, {"field": "label", "op": "isNot", "value": "Red"}, {"field": "edited", "op": "is", "value": True}]}, "NOT (flag = 'reject' OR NOT coalesce(label = 'red', false) OR edited)"),
    "F49_keywords": ({"match": "any", "rules": [{"field": "keywords", "op": "is", "value": "rome"}, {"field": "keywords", "op": "notContains", "value": "tra ita"}]}, f"(len(list_filter({_KEYS}, lambda k: lower(k) = 'rome' OR list_contains(string_split(lower(k), '|'), 'rome'))) > 0 OR len(list_filter({_KEYS}, lambda k: contains(lower(k), 'tra') AND contains(lower(k), 'ita'))) = 0)"),
    "F50_any_text": ({"rules": [{"field": "text", "op": "contains", "value": "canon red"}]}, " AND ".join(f"contains(lower(concat_ws(' ', name, caption, camera, lens, city, country, folder, keywords, label, kind)), '{w}')" for w in ("canon", "red"))),
    "F51_album": ({"match": "any", "rules": [{"field": "album", "op": "is", "value": "7"}, {"field": "album", "op": "is", "value": "none"}, {"match": "all", "rules": [{"field": "album", "op": "isNot", "value": 12}, {"field": "album", "op": "isNot", "value": "x"}, {"field": "rating", "op": "is", "value": 5}]}]}, "album = 7 OR (album <> 12 AND abs(rating - 5) < 1e-6)"),
    "F52_empty_sets": ({"match": "all", "rules": [{"match": "all", "rules": []}, {"match": "none", "rules": []}, {"match": "none", "rules": [{"match": "any", "rules": []}]}, {"field": "rating", "op": "is", "value": 5}]}, "abs(rating - 5) < 1e-6"),
    "F53_nested": ({"match": "all", "rules": [{"match": "any", "rules": [{"field": "rating", "op": "gte", "value": 4}, {"field": "flag", "op": "is", "value": "picked"}]}, {"match": "none", "rules": [{"field": "camera", "op": "isEmpty"}, {"field": "deleted", "op": "is", "value": True}]}]}, "(rating >= 4 - 1e-9 OR flag = 'pick') AND NOT (coalesce(camera, '') = '' OR deleted)"),
}


def _rules(name: str, rules: dict, where: str) -> None:
    query(name, f"{PHOTOS_SQL} SELECT id FROM photos WHERE {where}")(lambda spark, d: photos(spark, d).where(compile_rules(rules)).select("id"))


for _name, (_f, _w) in RULES.items():
    _rules(_name, _f, _w)

SORTS = {
    "capture": ("coalesce(captured, imported)", False), "import": ("imported", True), "edit": ("edit_date", False),
    "name": ("lower(name)", False), "rating": ("rating", True), "size": ("size", True),
}


def sorted_page(rows, key: str, descending: bool, offset: int = 0, limit: int = 200):
    """A page of a listing. Nulls sort lowest, and descending order turns the tie-break round too."""
    k = F.expr(SORTS[key][0])
    order = [k.desc_nulls_last(), F.col("id").desc()] if descending else [k.asc_nulls_first(), F.col("id").asc()]
    return rows.orderBy(*order).offset(offset).limit(limit)


for _key, (_e, _down) in SORTS.items():
    _dir = ("DESC NULLS LAST", "DESC") if _down else ("ASC NULLS FIRST", "ASC")
    query(f"T01_sort_{_key}", f"{PHOTOS_SQL} SELECT id, name FROM photos WHERE NOT deleted ORDER BY {_e} {_dir[0]}, id {_dir[1]} LIMIT 200 OFFSET 40")(
        lambda spark, d, k=_key, down=_down: sorted_page(photos(spark, d).where("not deleted"), k, down, 40).select("id", "name")
    )


@query("T03_video_listing", PHOTOS_SQL + "SELECT id, path, captured FROM photos WHERE kind = 'video' ORDER BY captured DESC NULLS LAST, path ASC, id LIMIT 25 OFFSET 50")
def video_listing(spark, d):
    """Videos, newest first, one page."""
    return photos(spark, d).where("kind = 'video'").orderBy(F.col("captured").desc_nulls_last(), "path", "id").offset(50).limit(25).select("id", "path", "captured")


@query("T11_total_and_page", PHOTOS_SQL + "SELECT id, name, (SELECT CAST(count(*) AS BIGINT) FROM photos WHERE rating >= 4 AND NOT deleted) AS total FROM photos WHERE rating >= 4 AND NOT deleted ORDER BY id LIMIT 20 OFFSET 100")
def total_and_page(spark, d):
    """A page and the number of all matches."""
    hits = photos(spark, d).where(flt.catalog_filter({"rating": 4}))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("id").offset(100).limit(20).select("id", "name").join(F.broadcast(total))
