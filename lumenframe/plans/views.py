"""Deterministic stand-ins for a media library's tables, derived from the driver tables.

The expressions are written in the part of SQL that Spark and DuckDB share, so the same text
builds the DataFrame and the oracle's common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PHOTO_COLUMNS = {
    "id": "o_orderkey",
    "name": "concat('IMG_', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN '-HDR' WHEN o_orderkey % 13 = 0 THEN '-Pano' WHEN o_orderkey % 17 = 0 THEN '-HDR-Pano 2' ELSE '' END, CASE WHEN o_orderkey % 9 = 0 THEN '.mp4' ELSE '.jpg' END)",
    "folder": "concat('/lib/', CAST(o_custkey % 10 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/sub' ELSE '' END)",
    "path": "concat('/lib/', CAST(o_custkey % 10 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/sub' ELSE '' END, CASE WHEN o_orderkey % 19 = 0 THEN '/WhatsApp' ELSE '' END, '/IMG_', CAST(o_orderkey AS STRING), '.jpg')",
    "size": "CAST(8192 + (o_orderkey * 7919) % 5000000 AS BIGINT)",
    "mtime": "CAST(1600000000 + (o_orderkey * 104729) % 90000000 AS BIGINT)",
    "width": "CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 800 + (o_orderkey * 37) % 5000 END AS INT)",
    "height": "CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 600 + (o_orderkey * 53) % 4000 END AS INT)",
    "iso": "CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 100 * (1 + o_orderkey % 32) END AS INT)",
    "aperture": "CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1.4 + (o_orderkey % 10) * 0.7 END AS DOUBLE)",
    "rating": "CAST(o_orderkey % 6 AS INT)",
    "flag": "CASE WHEN o_orderkey % 7 = 0 THEN 'pick' WHEN o_orderkey % 7 = 1 THEN 'reject' ELSE 'none' END",
    "label": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'red' WHEN o_orderkey % 4 = 2 THEN 'green' ELSE 'blue' END",
    "camera": "CASE WHEN o_custkey % 5 = 0 THEN 'Nikon Z6' WHEN o_custkey % 5 = 1 THEN 'Canon R5' WHEN o_custkey % 5 = 2 THEN 'Sony A7' WHEN o_custkey % 5 = 3 THEN 'nikon z6' ELSE NULL END",
    "lens": "CASE WHEN o_custkey % 3 = 0 THEN '50mm Prime' WHEN o_custkey % 3 = 1 THEN '24-70mm Zoom' ELSE NULL END",
    "captured": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':00') END",
    "imported": "concat(substr(CAST(o_orderdate AS STRING), 1, 8), lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), 'T12:00:00')",
    "edited": "o_orderkey % 8 = 0",
    "edit_date": "CASE WHEN o_orderkey % 8 = 0 THEN concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T23:00:00') ELSE NULL END",
    "deleted": "o_orderkey % 31 = 0",
    "missing": "o_orderkey % 37 = 0",
    "video_id": "CAST(CASE WHEN o_orderkey % 10 = 3 THEN o_custkey ELSE NULL END AS BIGINT)",
    "frame_ts": "CAST(CASE WHEN o_orderkey % 10 = 3 THEN (o_orderkey * 31) % 600 ELSE NULL END AS DOUBLE)",
    "kind": "CASE WHEN o_orderkey % 9 = 0 THEN 'video' ELSE 'photo' END",
    "caption": "CASE WHEN o_orderkey % 3 = 1 THEN concat(lower(o_orderpriority), ' sunset in Rome with ', o_orderstatus) ELSE NULL END",
    "city": "CASE WHEN o_custkey % 4 = 0 THEN 'Roma' WHEN o_custkey % 4 = 1 THEN 'Porto' WHEN o_custkey % 4 = 2 THEN 'Lyon' ELSE NULL END",
    "region": "CASE WHEN o_custkey % 8 = 0 THEN 'Lazio' WHEN o_custkey % 8 = 1 THEN 'Norte' ELSE NULL END",
    "country": "CASE WHEN o_custkey % 4 = 0 THEN 'Italy' WHEN o_custkey % 4 = 1 THEN 'Portugal' WHEN o_custkey % 4 = 2 THEN 'France' ELSE NULL END",
    "lat": "CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE ((o_orderkey * 13) % 1400) / 10.0 - 70 END AS DOUBLE)",
    "lon": "CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE ((o_orderkey * 29) % 3600) / 10.0 - 180 END AS DOUBLE)",
    "content_hash": "md5(CAST(o_orderkey % (CASE WHEN o_orderkey % 2 = 0 THEN 4001 ELSE 100000000 END) AS STRING))",
    "keywords": "concat('Travel|', CASE WHEN o_custkey % 2 = 0 THEN 'Italy' ELSE 'france' END, '|', CASE WHEN o_custkey % 4 = 0 THEN 'Rome' ELSE 'Nice' END, ';', CASE WHEN o_orderkey % 2 = 0 THEN 'food' ELSE 'Family|Kids' END)",
    "stack": "CAST(CASE WHEN o_orderkey % 5 < 2 THEN o_custkey ELSE NULL END AS BIGINT)",
    "album": "CAST(o_custkey % 50 AS BIGINT)",
}

#: ``WITH photos AS (...)``, to open an oracle.
PHOTOS_SQL = "WITH photos AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PHOTO_COLUMNS.items()) + " FROM orders) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media record per order."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in PHOTO_COLUMNS.items()])
