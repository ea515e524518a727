"""Picture headers: precedence of dates, places, odd and broken files, and ranges of files read in tasks."""

from __future__ import annotations

import pytest

from lumenframe.sources import exif


@pytest.mark.parametrize("order", ["<", ">"])
def test_fields(order):
    values = {"make": "Canon", "model": "Canon R5", "orientation": 6, "date": "2020:01:01 00:00:00", "digitized": "2019:05:06 07:08:09", "shot": "2018:03:04 05:06:07", "shot_offset": "+02:00", "iso": 400, "f_number": (28, 10), "exposure": (1, 250), "focal": (50, 1), "lens": "x" * 200}
    got = exif.read_header(exif.write_header(640, 480, values, {1: "S", 2: [(12, 1), (30, 1), (0, 1)], 3: "E", 4: [(7, 1), (0, 1), (36, 1)]}, order))
    assert got == {
        "width": 640, "height": 480, "orientation": 6, "date": "2018-03-04T05:06:07+02:00", "lat": -12.5, "lon": 7.01, "camera": "Canon R5", "make": "Canon", "model": "Canon R5", "lens": "x" * 120,
        "iso": 400, "f_number": 2.8, "exposure": "1/250", "focal_length": 50.0,
    }


def test_precedence_and_refusals():
    read = lambda v, place=None: exif.read_header(exif.write_header(2, 3, v, place))
    assert read({"shot": "0000:00:00 00:00:00", "digitized": "2019:05:06 07:08:09", "date": "2020:01:01 00:00:00"})["date"] == "2019-05-06T07:08:09"
    assert read({"date": "1849:01:01 00:00:00"})["date"] is None and read({"date": "2020:02:30 00:00:00"})["date"] is None
    assert read({"shot": "2018:03:04 05:06:07", "shot_offset": "west"})["date"] == "2018-03-04T05:06:07"
    assert read({"orientation": 9})["orientation"] == 1 and read({"exposure": (5, 2)})["exposure"] == "2.5s" and read({"exposure": (0, 1)})["exposure"] is None and read({"f_number": (1, 0)})["f_number"] is None
    zero = [(0, 1)] * 3
    assert read({}, {1: "N", 2: zero, 3: "E", 4: zero})["lat"] is None and read({}, {2: [(95, 1), (0, 1), (0, 1)], 4: zero})["lat"] is None
    assert read({"make": "Acme", "model": "Z"})["camera"] == "Acme Z" and read({"make": "Acme"})["camera"] == "Acme"


def test_broken_files():
    whole = exif.write_header(640, 480, {"model": "m", "shot": "2018:03:04 05:06:07"})
    for k in range(len(whole)):
        exif.read_header(whole[:k])  # never fails
    for odd in (None, b"", b"GIF89a", b"\xff\xd8\xff"):
        assert exif.read_header(odd)["width"] is None and exif.read_header(odd)["orientation"] == 1
    assert exif.read_header(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))["height"] == 9
    damaged = bytearray(whole)
    for k in range(12, len(damaged) - 12):
        damaged[k] ^= 0xFF
        exif.read_header(bytes(damaged))


def test_files_are_read_by_their_heads(spark, tmp_path):
    (tmp_path / "a b.jpg").write_bytes(exif.write_header(5, 6, {"model": "m"}) + b"x" * 100_000)
    (tmp_path / "c.txt").write_bytes(b"text")
    listed = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path")
    got = {r.path[-5:]: (r.width, r.model) for r in exif.read_files(listed, head=500).collect()}
    assert got == {"b.jpg": (5, "m"), "c.txt": (None, None)}
