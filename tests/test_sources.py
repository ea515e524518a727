"""Readers of calendars, tracks and feeds on odd documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lumenframe.sources import calendars, files

CALENDAR = (
    "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY;LANGUAGE=\"a:b\":Lunch\\, long\r\n  and fol\r\n\tded\\nline\\\\n\r\nDTSTART;TZID=Europe/Madrid:20260102T103000\r\n"
    "BEGIN:VALARM\r\nSUMMARY:alarm\r\nEND:VALARM\r\nDTEND:20260102T110000Z\r\nSUMMARY:second\r\nX-OTHER:x\r\nEND:VEVENT\r\nBEGIN:VEVENT\nUID:2\ndtstart;VALUE=DATE:20260304\nEND:VEVENT\nEND:VCALENDAR\n"
)


def test_calendars_are_unfolded_and_nested_parts_left_out(spark):
    df = spark.createDataFrame([(1, CALENDAR), (2, None), (3, ""), (4, "BEGIN:VEVENT\nUID:open"), (None, "BEGIN:VEVENT\nUID:z\nEND:VEVENT")], "k long, t string").selectExpr("k AS n", "t AS line")
    got = {(r.n, r.event): r for r in calendars.parse_calendar(df, "n", "line").collect()}
    one, two = got[1, 1], got[1, 2]
    assert (one.uid, one.summary, one.start_zone, one.all_day, one.status) == ("1", "Lunch, long and folded\nline\\n", "Europe/Madrid", False, None)
    assert one.start_at == datetime(2026, 1, 2, 10, 30) and two.start_at == datetime(2026, 3, 4) and two.all_day and two.end_at is None
    assert set(got) == {(1, 1), (1, 2), (4, 1), (None, 1)}


def test_written_calendars_fold_at_75_octets(spark):
    rows = [(1, "u2", "é" * 90, None, "a;b,c\\d\ne", datetime(2026, 1, 2), None), (1, "u1", "x", "d", None, datetime(2026, 1, 1), datetime(2026, 1, 1, 2))]
    events = spark.createDataFrame(rows, "k long, uid string, summary string, description string, location string, start_at timestamp, end_at timestamp")
    text = calendars.build_calendar(events, "k").first().text
    assert all(len(line.encode()) <= 75 for line in text.split("\r\n")) and text.index("u1") < text.index("u2") and "\n " in text
    back = {r.uid: (r.summary, r.description, r.location, r.start_at, r.end_at) for r in calendars.parse_calendar(calendars.build_calendar(events, "k"), "k", "text").collect()}
    assert back == {r[1]: (*r[2:5], *r[5:]) for r in rows}


def test_tracks_and_feeds_of_odd_documents(spark):
    docs = [(1, '<gpx><trk><trkseg/><trkseg><trkpt lat="1" lon="2"><time>2026-01-01T00:00:00Z</time></trkpt></trkseg></trk><trk><trkseg><trkpt lat="91" lon="2"><time>2026-01-01T00:00:00Z</time></trkpt><trkpt lat="3" lon="4"><time>2026-01-01T00:00:05Z</time></trkpt></trkseg></trk></gpx>'), (2, None), (3, ""), (4, "<gpx>")]
    got = files.parse_track(spark.createDataFrame(docs, "k int, t string"), "k", "t")
    assert sorted((r.k, r.lat, r.lon, r.ele) for r in got.collect()) == [(1, 1.0, 2.0, None), (1, 3.0, 4.0, None)]
    assert got.select("segment").distinct().count() == 2
    feeds = [(1, "<rss><channel><item><title>only</title></item></channel></rss>"), (2, None), (3, "<feed/>"), (4, "<rss><channel><item><link>l</link><pubDate>never</pubDate></item></channel></rss>")]
    rows = files.parse_feed(spark.createDataFrame(feeds, "k int, t string").withColumn("n", F.lit(1)), "k", "t").collect()
    assert sorted((r.k, r.id, r.published) for r in rows) == [(1, "only", ""), (4, "l", "")]


def test_reading_calendars_shuffles_nothing(spark):
    texts = [
        (1, " folded first\nBEGIN:VEVENT\n\n \nUID:a\n\n b\nEND:VEVENT\nUID:outside\nBegin;X=\"a:b\":vevent\nX-ONLY:1\nEND:VEVENT"),
        (2, "BEGIN:VEVENT\nEND:VEVENT\nBEGINNING:VEVENT\nBEGIN:VEVENTS\nBEGIN:VEVENT\rUID:c\rBEGIN:VALARM\rUID:d\rEND:VALARM\rUID:e"),
    ]
    read = calendars.parse_calendar(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.event, r.uid) for r in read.collect()) == [(1, 1, "ab"), (1, 2, None), (2, 2, "c")]
