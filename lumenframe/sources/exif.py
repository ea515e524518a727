"""Metadata in the headers of pictures, read without decoding them or reading the rest of a file.

A JPEG is a chain of segments; the one with the frame tells the size, the one marked Exif holds small tables of tagged
values. Tables may name one another, so each is read once, and what points outside the header is left out.

Defined results: what is no JPEG or PNG, null or cut short before its frame, gives nulls in every field but
``orientation``, which is 1; a place at 0, 0 is none; dates before 1850 and impossible ones are none; of several dates that
of the shot comes first, then of its digitising, then of the file; text ends at 120 characters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.extract import each_row

#: Bytes of a file that are read for its header.
HEAD = 1 << 18
#: Sizes and codes of the types of values.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 9: "i", 10: "ii"}
#: Tags by name; those of the second and third table are reached by the first's two pointers.
TAGS = {
    "make": 0x010F, "model": 0x0110, "orientation": 0x0112, "date": 0x0132, "exif": 0x8769, "gps": 0x8825, "exposure": 0x829A, "f_number": 0x829D, "iso": 0x8827, "shot": 0x9003,
    "digitized": 0x9004, "offset": 0x9010, "shot_offset": 0x9011, "digitized_offset": 0x9012, "focal": 0x920A, "lens": 0xA434,
}
NAMES = {v: k for k, v in TAGS.items()}
PLACE = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
FIELDS = "width int, height int, orientation int, date string, lat double, lon double, camera string, make string, model string, lens string, iso int, f_number double, exposure string, focal_length double"


def _table(data: bytes, at: int, order: str) -> Iterator[tuple[int, object]]:
    """``(tag, value)`` of one table: text, a number or a list of numbers; fractions are pairs."""
    count = struct.unpack_from(order + "H", data, at)[0]
    for k in range(count):
        place = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        if kind not in TYPES:
            continue
        code = TYPES[kind]
        size = struct.calcsize("=" + code) * n
        start = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if start + size > len(data):
            continue
        if code == "s":
            yield tag, data[start : start + n]
        else:
            flat = struct.unpack_from(order + code[0] * (len(code) * n), data, start)
            values = list(zip(flat[::2], flat[1::2])) if len(code) == 2 else list(flat)
            yield tag, values[0] if n == 1 else values


def tagged(data: bytes) -> dict[str, object]:
    """The values of an Exif block by name."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return {}
    found: dict[str, object] = {}
    try:
        for tag, value in _table(data, struct.unpack_from(order + "I", data, 4)[0], order):
            found.setdefault(NAMES.get(tag, tag), value)
        for pointer, names in (("exif", NAMES), ("gps", PLACE)):
            if isinstance(found.get(pointer), int):
                for tag, value in _table(data, found[pointer], order):
                    if tag in names:
                        found.setdefault(names[tag], value)
    except struct.error:
        pass  # a table that is cut short: what was read counts
    return found


def header(content: bytes) -> tuple[int | None, int | None, bytes]:
    """Width, height and the Exif block of a picture."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return *struct.unpack(">II", content[16:24]), b""
    if content[:2] != b"\xff\xd8":
        return None, None, b""
    at, exif = 2, b""
    while at + 4 <= len(content) and content[at] == 0xFF:
        mark, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        body = content[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            exif = exif or body[6:]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1) if len(body) >= 5 else (None, None)
            return width, height, exif
        at += 2 + size
    return None, None, exif


def _text(value: object) -> str | None:
    said = value.decode("utf-8", "replace") if isinstance(value, bytes) else "" if value is None else str(value)
    return said.replace("\0", "").strip()[:120] or None


def _number(value: object) -> float | None:
    one = value[0] if isinstance(value, list) and value else value
    if isinstance(one, tuple):
        return one[0] / one[1] if one[1] else None
    return float(one) if isinstance(one, (int, float)) else None


def _moment(value: object, offset: object) -> str | None:
    try:
        at = datetime.strptime((_text(value) or "")[:19], "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None
    zone = _text(offset) or ""
    if at.year >= 1850 and zone[:1] in ("+", "-") and zone[1:3].isdigit() and zone[3:4] == ":" and zone[4:6].isdigit():
        ahead = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
        if ahead < timedelta(hours=24):
            at = at.replace(tzinfo=timezone(-ahead if zone[0] == "-" else ahead))
    return at.isoformat() if at.year >= 1850 else None


def _degrees(value: object, side: object) -> float | None:
    parts = [_number(x) for x in value] if isinstance(value, list) and len(value) == 3 else [None]
    if None in parts:
        return None
    degrees = round(parts[0] + parts[1] / 60 + parts[2] / 3600, 6)
    return -degrees if _text(side) in ("S", "W") else degrees


def read_header(content: bytes | None) -> dict[str, object]:
    """The fields of ``FIELDS``."""
    width, height, block = header(bytes(content or b""))
    v = tagged(block)
    dates = (_moment(v.get(d), v.get(o) or v.get("offset")) for d, o in (("shot", "shot_offset"), ("digitized", "digitized_offset"), ("date", "offset")))
    lat, lon = _degrees(v.get("lat"), v.get("lat_ref")), _degrees(v.get("lon"), v.get("lon_ref"))
    placed = lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and (lat, lon) != (0, 0)
    make, model = _text(v.get("make")), _text(v.get("model"))
    named = make if make and not (model and model.lower().startswith(make.lower())) else None
    turned, iso, seconds = _number(v.get("orientation")), _number(v.get("iso")), _number(v.get("exposure"))
    shown = None if seconds is None or seconds <= 0 else f"1/{round(1 / seconds)}" if seconds < 1 else f"{seconds:g}s"
    return {
        "width": width, "height": height, "orientation": int(turned) if turned in range(1, 9) else 1, "date": next((d for d in dates if d), None), "lat": lat if placed else None, "lon": lon if placed else None,
        "camera": " ".join(x for x in (named, model) if x) or None, "make": make, "model": model, "lens": _text(v.get("lens")), "iso": None if iso is None else int(iso),
        "f_number": _number(v.get("f_number")), "exposure": shown, "focal_length": _number(v.get("focal")),
    }


def read_exif(pictures: DataFrame, keys: int = 1) -> DataFrame:
    """The first ``keys`` columns beside the fields of each picture's bytes, the column after them."""
    return each_row(pictures, lambda content: [tuple(read_header(content).values())], FIELDS, keys)


def with_date(rows: DataFrame, exif: str, modified: str) -> DataFrame:
    """``rows`` with ``taken_at`` and ``date_source``: the camera's date, else the file's in UTC."""
    own = F.col(f"{exif}.date")
    late = F.concat(F.date_format(F.to_utc_timestamp(modified, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return rows.withColumn("taken_at", F.coalesce(own, late)).withColumn("date_source", F.when(own.isNotNull(), "exif").otherwise("file_mtime"))


def read_files(listed: DataFrame, head: int = HEAD) -> DataFrame:
    """``listed`` (``path``) -> ``path`` and the fields: tasks read the first ``head`` bytes of their files, and no more."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                uri = quote(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path, safe=":/@")
                system, place = pafs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as file:
                    rows.append({"path": path} | read_header(file.read_at(head, 0)))
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    shape = pa.schema([("path", pa.string()), *((f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", "))])
    return listed.select("path").mapInArrow(run, f"path string, {FIELDS}").select("path", *names)


def write_header(width: int, height: int, values: dict[str, object], place: dict[int, object] | None = None, order: str = "<") -> bytes:
    """A JPEG header with these values, for fixtures: text, whole numbers, fractions as pairs, or lists of pairs."""

    def table(entries: list[tuple[int, object]], at: int) -> bytes:
        out, rest = struct.pack(order + "H", len(entries)), b""
        tail = at + 2 + 12 * len(entries) + 4
        for tag, v in sorted(entries):
            if isinstance(v, str):
                kind, n, raw = 2, len(v.encode()) + 1, v.encode() + b"\0"
            elif isinstance(v, int):
                kind, n, raw = (3, 1, struct.pack(order + "H", v)) if tag not in (TAGS["exif"], TAGS["gps"]) else (4, 1, struct.pack(order + "I", v))
            else:
                pairs = v if isinstance(v, list) else [v]
                kind, n, raw = 5, len(pairs), b"".join(struct.pack(order + "II", *p) for p in pairs)
            if len(raw) > 4:
                cell, rest = struct.pack(order + "I", tail + len(rest)), rest + raw
            else:
                cell = raw.ljust(4, b"\0")
            out += struct.pack(order + "HHI", tag, kind, n) + cell
        return out + b"\0" * 4 + rest

    first = [(TAGS[k], v) for k, v in values.items() if k in ("make", "model", "orientation", "date")]
    inner = [(TAGS[k], v) for k, v in values.items() if k not in ("make", "model", "orientation", "date")]
    size = len(table([*first, (TAGS["exif"], 0), (TAGS["gps"], 0)], 8))
    exif = table(inner, 8 + size)
    gps = table(list((place or {}).items()), 8 + size + len(exif))
    block = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + table([*first, (TAGS["exif"], 8 + size), (TAGS["gps"], 8 + size + len(exif))], 8) + exif + gps
    app = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 1) + b"\xff\xd9"
