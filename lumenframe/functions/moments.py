"""Expressions of dates without a year, feed dates, identifiers with a time, and frame times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of base 32 that identifiers are written in.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


#: The days from today that a reading accepts, and which end of them it prefers.
WINDOWS = {"future": (-10, None, 1), "past": (None, 45, -1), "next": (0, None, 1)}


def resolve_year(day: Column, month: Column, today: Column, prefer: str) -> Column:
    """The date with this day and month in last, this or next year that suits ``prefer`` (``future``, ``past``,
    ``next`` or ``nearest``): dates inside the window first, its preferred end first; beyond it the nearest.
    Null for a day that none of the years has."""
    first, end, sign = WINDOWS.get(prefer, (None, None, 0))

    def place(found: Column) -> Column:
        away = F.datediff(found, today)
        outside = F.lit(False)
        if first is not None:
            outside = away < first
        if end is not None:
            outside = away > end
        return F.struct(outside.alias("outside"), (F.when(outside, -sign * away).otherwise(sign * away) if sign else F.abs(away)).alias("away"), found.alias("day"))

    months = F.transform(F.sequence(F.year(today) - 1, F.year(today) + 1), lambda y: F.make_date(y, month.cast("int"), F.lit(1)))
    known = F.filter(months, lambda m: (day >= 1) & (day <= F.day(F.last_day(m))))
    return F.array_min(F.transform(known, lambda m: place(F.date_add(m, day.cast("int") - 1))))["day"]


def iso_utc(c: Column) -> Column:
    """An ISO 8601 or RFC 822 date as ``yyyy-MM-ddTHH:mm:ssZ``; without a zone it is UTC; empty if unreadable."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, *", ""), r"(\d)[Tt](\d)", "$1 $2")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(:\d\d)\.\d+", "$1"), r" *(Z|z|GMT|UTC|UT)$", "+0000")
    plain = F.regexp_replace(F.regexp_replace(plain, r" +([+-]\d{4})$", "$1"), r"([+-]\d\d):(\d\d)$", "$1$2")
    zoned = F.when(F.regexp_like(plain, F.lit(r":\d\d[+-]\d{4}$")), plain).when(F.contains(plain, F.lit(":")), F.concat(plain, F.lit("+0000"))).otherwise(F.concat(plain, F.lit(" 00:00:00+0000")))
    at = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ssZ", "yyyy-MM-dd HH:mmZ", "d MMM yyyy HH:mm:ssZ", "d MMM yyyy HH:mmZ")])
    return F.coalesce(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def time_id(millis: Column, tail: Column) -> Column:
    """An identifier that sorts by time: ten digits of milliseconds, then 16 of ``tail``."""
    digit = lambda i: F.substring(F.lit(BASE32), (F.call_function("shiftright", millis, (9 - i) * 5).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), digit), ""), tail)


def id_millis(c: Column) -> Column:
    """The milliseconds in an identifier, alone or after a prefix and a separator; else null."""
    tail = F.upper(F.right(c, F.lit(26)))
    valid = F.regexp_like(c, F.lit(r"^(?:.*[^A-Za-z0-9])?[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}$"))
    digits = F.filter(F.split(F.substring(tail, 1, 10), ""), lambda x: x != "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda total, x: total * 32 + F.call_function("instr", F.lit(BASE32), x) - 1)
    return F.when(valid, value)


def spread(items: Column, n: Column) -> Column:
    """``n`` items of a sorted array, as far apart as its places allow, the first and last among them. A place is
    kept if it is the nearest whole one to some ``n``-th part of the way, halves to the even side."""
    steps, places = n - 1, F.size(items) - 1
    nearest = lambda i: F.bround(F.bround(i * steps / places) * places / steps)
    some = F.when(n == 1, F.slice(items, 1, 1)).otherwise(F.filter(items, lambda _, i: nearest(i) == i))
    return F.when(F.size(items) <= n, items).when(n >= 1, some).otherwise(F.slice(items, 1, 0))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(c), use), 0)


def frame_times(duration: Column, scenes: Column, every: float = 30.0, most: int = 8, gap: float = 2.0) -> Column:
    """Times of frames to take: cuts between scenes, and of the opening and the ticks of a clock those that
    keep ``gap`` from every cut, ``most`` times in all."""
    end = F.greatest(F.lit(0.0), duration - 0.25)
    distinct = F.array_sort(F.array_distinct(F.transform(scenes, lambda s: F.round(F.least(F.greatest(s, F.lit(0.0)), end), 3))))
    ticks = F.filter(F.sequence(F.lit(0), F.floor(F.greatest(duration, F.lit(0.0)) / every).cast("int")), lambda i: (i == 0) | (i * every < duration - 0.5))
    ticks = F.transform(ticks, lambda i: F.when(i == 0, F.least(F.lit(0.5), end)).otherwise(i * F.lit(every)))

    def planned(cuts: Column) -> Column:
        apart = F.filter(ticks, lambda t: F.coalesce(F.array_min(F.transform(cuts, lambda c: F.abs(c - t))) >= gap, F.lit(True)))
        return F.array_sort(F.array_union(cuts, _once(apart, lambda x: spread(x, most - F.size(cuts)))))

    times = _once(_once(distinct, lambda x: spread(x, F.lit(most))), planned)
    return F.when(duration > 0, times).otherwise(F.array(F.lit(0.0)))
