"""Calendar files as tables of events, and events as calendar files.

A file is one row, so nothing is shuffled to read it: a line that begins with a blank is joined to the nearest
line before that does not, the text is cut where events begin, and each event's lines are folded into its
fields. Events are what lies between their ``BEGIN`` and ``END``; components inside an event, such as alarms, are
no part of its own fields.

Defined results: an event without an end is closed by the next or the file's end; repeated fields keep the first; values
are unescaped; times are read as dates, local times or UTC; empty files have no events; unknown
fields are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of an event, by column.
FIELDS = {"uid": "UID", "summary": "SUMMARY", "location": "LOCATION", "description": "DESCRIPTION", "start": "DTSTART", "end": "DTEND", "rule": "RRULE", "status": "STATUS"}
#: Octets of a written line.
WIDTH = 75
#: The line before an event's first.
_OPENS = r'\n(?=(?i:BEGIN)(?![A-Za-z0-9-])[^:;\n]*(?:;(?:[^":\n]|"[^"\n]*")*)?:(?i:VEVENT)(?:\n|\z))'


def _unescaped(c: Column) -> Column:
    marked = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    plain = F.regexp_replace(F.regexp_replace(marked, r"\\[nN]", "\n"), r"\\([,;])", "$1")
    return F.replace(plain, F.lit("\0"), F.lit("\\"))


def escaped(c: Column) -> Column:
    s = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(s, "([,;])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def parse_calendar(files: DataFrame, key: str, text: str) -> DataFrame:
    """``files`` (a key and a text) -> ``key, event`` and the columns of ``FIELDS``, with ``start_at``, ``end_at`` and ``all_day``."""
    # Empty lines are none; what then begins with a blank goes on from the line before.
    whole = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n")), "\n+", "\n"), "\n[ \t]", "")
    parts = files.select(F.col(key).alias("key"), F.posexplode(F.split(whole, _OPENS)).alias("event", "part")).where("event > 0")
    head = lambda x: F.upper(F.regexp_extract(x, r"^([A-Za-z0-9-]+)", 1))
    value = lambda x: F.regexp_extract(x, r'^[^:;]*(?:;(?:[^":]|"[^"]*")*)?:((?s).*)$', 1)
    params = lambda x: F.regexp_extract(x, r"^[^:;]*((?:;(?:[^\":]|\"[^\"]*\")*)?):", 1)
    line = lambda x: F.struct(head(x).alias("head"), value(x).alias("value"), F.when(head(x) == "DTSTART", params(x)).alias("params"))
    lines = parts.select("key", "event", F.transform(F.filter(F.split("part", "\n"), lambda x: x != ""), line).alias("lines"))
    none = F.lit(None).cast("string")
    # Name in the state, name of the field, and what of its line is kept.
    kept = [*[(c, name, "value") for c, name in FIELDS.items()], ("start_params", "DTSTART", "params")]

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x["head"] == "BEGIN", 1).when(x["head"] == "END", -1).otherwise(0)
        own = (depth == 1) & ~x["head"].isin("BEGIN", "END")
        return F.struct(depth.alias("depth"), (s["any"] | own).alias("any"), *[F.coalesce(s[c], F.when(own & (x["head"] == name), x[part])).alias(c) for c, name, part in kept])

    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("any"), *[none.alias(c) for c, _, _ in kept])
    found = lines.select("key", "event", F.aggregate("lines", state, step).alias("s")).where("s.any")
    zone = lambda c: F.regexp_extract(c, 'TZID="?([^";:]+)', 1)
    found = found.select("key", "event", *[_unescaped(F.col(f"s.{c}")).alias(c) for c in FIELDS], zone(F.col("s.start_params")).alias("start_zone"))
    day = F.regexp_like("start", F.lit(r"^\d{8}$"))
    moment = lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    return found.select(F.col("key").alias(key), F.col("event").cast("int").alias("event"), *FIELDS, F.nullif("start_zone", F.lit("")).alias("start_zone"), moment(F.col("start")).alias("start_at"), moment(F.col("end")).alias("end_at"), F.coalesce(day, F.lit(False)).alias("all_day"))


def _folded(line: Column) -> Column:
    """A line cut after at most 74 octets, between characters; later pieces begin with a space."""
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    step = lambda s, c: F.when(s["used"] + F.octet_length(c) > WIDTH - 1, F.struct(F.concat(s["out"], F.lit("\r\n "), c).alias("out"), (F.octet_length(c) + 1).alias("used"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), (s["used"] + F.octet_length(c)).alias("used")))
    return F.when(F.octet_length(line) < WIDTH, line).otherwise(F.aggregate(chars, state, step, lambda s: s["out"]))


def build_calendar(events: DataFrame, key: str, product: str = "-//lumenframe//EN") -> DataFrame:
    """``events`` (``key, uid, summary, description, location, start_at, end_at``) -> ``key, text``: a calendar file for each
    key, events by their start."""
    stamp = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    named = [("UID", escaped(F.col("uid"))), ("DTSTART", stamp("start_at")), ("DTEND", stamp("end_at")), ("SUMMARY", escaped(F.col("summary"))), ("DESCRIPTION", escaped(F.col("description"))), ("LOCATION", escaped(F.col("location")))]
    lines = F.filter(F.array(*[_folded(F.concat(F.lit(f"{n}:"), c)) for n, c in named]), lambda x: x.isNotNull())
    block = F.array_join(F.concat(F.array(F.lit("BEGIN:VEVENT")), lines, F.array(F.lit("END:VEVENT"))), "\r\n")
    ordered = F.array_sort(F.collect_list(F.struct("start_at", "uid", block.alias("text"))))
    body = F.array_join(F.transform(ordered, lambda e: e["text"]), "\r\n")
    return events.groupBy(key).agg(F.concat(F.lit(f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:{product}\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))
