"""Files as tables: listings, journals, tracks, feeds and place lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.moments import iso_utc

IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "heic", "tif", "tiff", "bmp")
VIDEOS = ("mp4", "mov", "mkv", "avi", "webm", "m4v")


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES, min_bytes: int = 8192, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``path, size, mtime`` below a folder, without hidden names and small files. The content is
    not selected, so files are listed and never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    shown = files.where(kind.isin(list(extensions)) & (F.col("size") >= min_bytes) & ~F.regexp_like("path", F.lit(r"/\.[^/]")))
    for glob in excluded:
        shown = shown.where(~F.regexp_like("path", F.lit("(^|/)" + glob.replace(".", r"\.").replace("*", "[^/]*") + "(/|$)")))
    return shown


def quick_digest(content: Column, size: Column, part: int = 1 << 20) -> Column:
    """A digest of size, head and tail; the tail only beyond two parts."""
    head = F.substring(content, 1, part)
    tail = F.when(size > 2 * part, F.expr(f"substring(content, -{part}, {part})")).otherwise(F.lit("").cast("binary"))
    return F.sha2(F.concat(size.cast("string").cast("binary"), head, tail), 256)


def journal(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of a rotated journal; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def track_points(spark: SparkSession, path: str) -> DataFrame:
    """``time, lat, lon, ele`` of a GPX file; points without a time or off the globe are dropped."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time timestamp").load(path)
    ok = F.col("time").isNotNull() & F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180)
    return rows.where(ok).select("time", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, link, published`` of an RSS file; the id falls back to link, then title."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("guid string, title string, link string, pubDate string, description string").load(path)
    when = F.try_to_timestamp(iso_utc(F.coalesce("pubDate", F.lit(""))))
    return rows.select(F.coalesce("guid", "link", "title").alias("id"), F.substring("title", 1, 300).alias("title"), "link", when.alias("published"), F.substring("description", 1, 400).alias("summary"))


_POINT = "struct<_lat:double,_lon:double,ele:double,time:string>"
_TRACKS = f"trk array<struct<trkseg:array<struct<trkpt:array<{_POINT}>>>>>"


def parse_track(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, segment, time, lat, lon, ele`` of GPX documents, one a row: timed points on the globe, with the number
    of their segment among all of the document's."""
    read = docs.select(F.col(key), F.from_xml(text, _TRACKS).alias("x")).select(key, F.posexplode(F.flatten(F.transform("x.trk", lambda t: t["trkseg"]))).alias("segment", "s"))
    points = read.select(key, "segment", F.explode("s.trkpt").alias("p")).withColumn("time", F.try_to_timestamp("p.time"))
    ok = F.col("time").isNotNull() & F.col("p._lat").between(-90, 90) & F.col("p._lon").between(-180, 180)
    return points.where(ok).select(key, "segment", "time", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"))


_ITEM = "struct<guid:string,title:string,link:string,pubDate:string,description:string,`dc:date`:string>"
_ENTRY = "struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string>"
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>"


def parse_feed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, id, title, link, published, summary`` of the items of RSS, RDF and Atom documents, one a row. The id falls
    back to the link, then the title; dates are ISO texts in UTC, empty if unreadable."""
    x = docs.select(F.col(key), F.from_xml(text, _FEED).alias("x"))
    item = lambda i: F.struct(i["guid"].alias("id"), i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["pubDate"], i["dc:date"]).alias("at"), i["description"].alias("summary"))
    own = lambda links: F.coalesce(F.get(F.filter(links, lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate"), 0), F.get(links, 0))["_href"]
    entry = lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), own(e["link"]).alias("link"), F.coalesce(e["published"], e["updated"]).alias("at"), e["summary"].alias("summary"))
    items = F.coalesce(F.transform("x.channel.item", item), F.transform("x.item", item), F.transform("x.entry", entry))
    rows = x.select(key, F.posexplode(items).alias("n", "i")).select(key, "n", "i.*")
    return rows.select(key, "n", F.coalesce("id", "link", "title").alias("id"), F.substring("title", 1, 300).alias("title"), "link", iso_utc(F.coalesce("at", F.lit(""))).alias("published"), F.substring("summary", 1, 400).alias("summary"))


def place_names(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated place list with all of its 15 fields."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 15)
    take = lambda i, kind, name: F.get("f", i).try_cast(kind).alias(name)
    return rows.select(take(1, "string", "name"), take(4, "double", "lat"), take(5, "double", "lon"), take(7, "string", "feature"), take(8, "string", "country"), take(10, "string", "admin1"), take(14, "long", "population"))


def export_selection(rows: DataFrame, folder: str, order: list[str]) -> str:
    """Writes a selection as JSON lines under a name that its content gives; returns that folder."""
    digest = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    name = f"{folder}/{digest['n']}-{abs(int(digest['s'] or 0)):x}"
    rows.sortWithinPartitions(*order).write.mode("overwrite").json(name)
    return name


def cue_lines(cues: DataFrame, key: str) -> DataFrame:
    """SRT text of each key's cues (start, end, text)."""
    stamp = lambda c: F.concat(F.format_string("%02d:%02d:%02d", F.floor(c / 3600).cast("int"), F.floor(c % 3600 / 60).cast("int"), F.floor(c % 60).cast("int")), F.lit(","), F.lpad(F.round((c % 1) * 1000).cast("int").cast("string"), 3, "0"))
    block = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(x["start"]), F.lit(" --> "), stamp(x["end"]), F.lit("\n"), x["text"], F.lit("\n")))
    return cues.groupBy(key).agg(F.array_join(block, "\n").alias("srt"))
