"""Queries of file readers and writers: tables written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import extract
from lumenframe.operators.checkpoints import new_folder
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table
from lumenframe.sources import calendars, exif, files


def _text(df: DataFrame, what: str) -> str:
    """The first column's texts as the lines of files in a new folder."""
    folder = new_folder(df.sparkSession, what)
    df.write.option("lineSep", "\n").text(folder)
    return folder


@query(
    "S13_calendars",
    "SELECT o_custkey AS cust, 'order-' || o_orderkey AS uid, concat('Ship; ', o_orderpriority, ', then ', repeat('wait \\ é ', CAST(o_orderkey % 20 AS INT)), chr(10), 'done') AS summary, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400) AS start_at FROM orders",
)
def calendar_files(spark, d):
    """Every customer's orders written as a calendar file, with folded lines and escaped signs, and read back."""
    text = F.concat(F.lit("Ship; "), "o_orderpriority", F.lit(", then "), F.repeat(F.lit("wait \\ é "), (F.col("o_orderkey") % 20).cast("int")), F.lit("\ndone"))
    at = F.timestamp_seconds(F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("uid"), text.alias("summary"), F.lit(None).cast("string").alias("description"), F.lit("dock").alias("location"), at.alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"))
    read = calendars.parse_calendar(calendars.build_calendar(events, "cust"), "cust", "text")
    return read.select("cust", "uid", "summary", F.col("start_at").cast("timestamp_ntz").alias("start_at"))


@query("S17_journal", "SELECT event_id, event_type, value FROM events WHERE event_id % 7 <> 0")
def journal(spark, d):
    """Events as a rotated journal of JSON lines, every seventh torn, read again."""
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("line"))
    parts = [_text(rows.where(F.col("event_id") % 2 == k).select("line"), "journal") for k in (0, 1)]
    return files.journal(spark, parts, "event_id long, event_type string, value double")


@query("S11_places", PHOTOS_SQL + "SELECT CAST(id AS STRING) AS name, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(size AS BIGINT) AS population FROM photos WHERE id % 5 <> 0")
def places(spark, d):
    """Photos as a tab-separated list of places, every fifth short of a field, read again."""
    cells = [F.lit("") for _ in range(15)]
    for i, c in {0: "id", 1: "id", 4: "lat", 5: "lon", 14: "size"}.items():
        cells[i] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.when(F.col("id") % 5 == 0, F.concat_ws("\t", *cells[:14])).otherwise(F.concat_ws("\t", *cells))
    return files.place_names(spark, _text(photos(spark, d).select(line), "places")).select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "population")


@query(
    "S10_track_points",
    PHOTOS_SQL + "SELECT id, s AS segment, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(captured AS TIMESTAMP) + INTERVAL 1 MINUTE * s AS time FROM photos, (VALUES (0), (1)) v(s) WHERE lat IS NOT NULL AND captured IS NOT NULL AND id % 6 <> 0",
)
def track(spark, d):
    """Located photos as GPX documents of two segments, every sixth off the globe and some without a time, read again."""
    p = photos(spark, d).where("lat is not null").withColumn("at", F.try_to_timestamp("captured"))
    lat = F.when(F.col("id") % 6 == 0, F.lit(99.0)).otherwise(F.col("lat"))
    time = lambda minutes: F.coalesce(F.concat(F.lit("<time>"), F.date_format(F.timestamp_seconds(F.unix_timestamp("at") + 60 * minutes), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>")), F.lit(""))
    point = lambda minutes: F.concat(F.lit('<trkpt lat="'), lat.cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><ele>1.5</ele>'), time(minutes), F.lit("</trkpt>"))
    text = F.concat(F.lit('<gpx version="1.1"><trk><name>a</name><trkseg>'), point(0), F.lit("</trkseg><trkseg>"), point(1), F.lit('<trkpt lat="1" lon="2"></trkpt></trkseg></trk></gpx>'))
    found = files.parse_track(p.select("id", text.alias("gpx")), "id", "gpx")
    return found.select("id", "segment", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("time").cast("timestamp_ntz").alias("time"))


@query(
    "S12_feed_items",
    "SELECT page_id, CAST(n AS INT) AS n, CASE WHEN page_id % 3 = 2 OR n = 0 THEN concat('id', page_id, '-', n) ELSE url END AS id, concat('Page & ', page_id) AS title, url AS link, strftime(TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 MINUTE * page_id, '%Y-%m-%dT%H:%M:%SZ') AS published FROM pages, (VALUES (0), (1)) v(n)",
)
def feed(spark, d):
    """Every page as a feed of two items, in RSS, RDF or Atom, read again."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    key = F.col("page_id").cast("string")
    at = F.timestamp_seconds(1767225600 + F.col("page_id") * 60)
    title, link, mail, iso = tag("title", F.concat(F.lit("Page &amp; "), key)), esc(F.col("url")), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = lambda n: F.concat(F.lit("id"), key, F.lit(f"-{n}"))
    rss = lambda n, date: tag("item", F.concat(tag("guid", named(n)) if n == 0 else F.lit(""), title, tag("link", link), date))
    entry = lambda n: tag("entry", F.concat(tag("id", named(n)), title, F.lit('<link rel="self" href="http://x"/><link href="'), link, F.lit('"/>'), tag("updated", iso)))
    kind = F.col("page_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("<rss><channel><title>t</title>"), rss(0, tag("pubDate", mail)), rss(1, tag("pubDate", mail)), F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit("<RDF><channel><title>t</title></channel>"), rss(0, tag("dc:date", iso)), rss(1, tag("dc:date", iso)), F.lit("</RDF>")))
        .otherwise(F.concat(F.lit("<feed><title>t</title>"), entry(0), entry(1), F.lit("</feed>")))
    )
    return files.parse_feed(table(spark, d, "pages").select("page_id", text.alias("xml")), "page_id", "xml").drop("summary")


@query("S20_export", PHOTOS_SQL + "SELECT id, name, rating FROM photos WHERE rating >= 4")
def export(spark, d):
    """A selection exported as JSON lines under the name that its content gives, and read again."""
    chosen = photos(spark, d).where("rating >= 4").select("id", "name", "rating")
    return spark.read.schema("id long, name string, rating int").json(files.export_selection(chosen, new_folder(spark, "export"), ["id"]))


@query(
    "S06_S07_metadata",
    PHOTOS_SQL + "SELECT id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CASE WHEN lens IS NOT NULL AND camera IS NOT NULL THEN concat('Acme ', camera) ELSE coalesce(camera, 'Acme') END AS camera, lens, CAST(iso AS INT) AS iso, round(aperture, 4) AS f_number, CASE WHEN lat IS NOT NULL AND abs(lat) <= 90 AND NOT (lat = 0 AND lon = 0) THEN round(lat, 4) END AS lat, CASE WHEN id % 7 <> 0 AND captured IS NOT NULL THEN captured ELSE strftime(to_timestamp(mtime), '%Y-%m-%dT%H:%M:%S+00:00') END AS taken_at, CASE WHEN id % 7 <> 0 AND captured IS NOT NULL THEN 'exif' ELSE 'file_mtime' END AS date_source FROM photos WHERE width IS NOT NULL",
)
def metadata(spark, d):
    """Every photo as the header of a picture file, and its metadata read from that; a seventh hold an impossible date."""

    def build(key, width, height, camera, lens, iso, aperture, lat, lon, captured):
        frac = lambda x, by: (round(abs(x) * by), by)
        values = {"make": "Acme" if lens or not camera else None, "model": camera, "lens": lens, "iso": iso, "f_number": None if aperture is None else frac(aperture, 10_000)}
        values["shot"] = "0000:00:00 00:00:00" if key % 7 == 0 else captured and captured.replace("-", ":").replace("T", " ")
        place = None if lat is None else {1: "S" if lat < 0 else "N", 2: [frac(lat, 10_000), (0, 1), (0, 1)], 3: "W" if lon < 0 else "E", 4: [frac(lon, 10_000), (0, 1), (0, 1)]}
        return [(exif.write_header(width, height, {k: v for k, v in values.items() if v is not None}, place, "<" if key % 2 else ">"),)]

    asked = photos(spark, d).where("width is not null").select("id", F.timestamp_seconds("mtime").alias("modified"), F.col("id").alias("key"), "width", "height", "camera", "lens", "iso", "aperture", "lat", "lon", "captured")
    found = exif.read_exif(extract.each_row(asked, build, "content binary", 2), 2)
    read = exif.with_date(found.select("id", "modified", F.struct(*found.columns[2:]).alias("x")), "x", "modified")
    return read.select("id", "x.width", "x.height", "x.camera", "x.lens", "x.iso", F.round("x.f_number", 4).alias("f_number"), F.round("x.lat", 4).alias("lat"), "taken_at", "date_source")
