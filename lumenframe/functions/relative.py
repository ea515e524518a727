"""Days and moments said in words, in Spanish and English, as Columns.

A saying is folded, then the readings are tried in their order; each is a pattern and what it gives.

Defined results: null and empty sayings, and those that name no day, are null; a day that its month does
not have is no day; units carry over month ends, which cut the day to the month's last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.moments import resolve_year
from lumenframe.functions.text import fold

#: Numbers, months and weekdays in words.
NUMBERS = {
    1: "un una uno a an one", 2: "dos two", 3: "tres three", 4: "cuatro four", 5: "cinco five", 6: "seis six", 7: "siete seven", 8: "ocho eight", 9: "nueve nine", 10: "diez ten",
    15: "quince", 20: "veinte", 30: "treinta",
}
MONTHS = [
    "enero january", "febrero february", "marzo march", "abril april", "mayo may", "junio june", "julio july", "agosto august", "septiembre setiembre september",
    "octubre october", "noviembre november", "diciembre december",
]
WEEKDAYS = ["lunes monday", "martes tuesday", "miercoles wednesday", "jueves thursday", "viernes friday", "sabado saturday", "domingo sunday"]
#: Seconds of the units of an age.
UNITS = {
    1: "s sec secs second seconds seg segundo segundos", 60: "m min mins minute minutes minuto minutos", 3600: "h hr hrs hour hours hora horas", 86400: "d day days dia dias",
    604800: "w week weeks semana semanas", 2592000: "mo month months mes meses", 31536000: "y year years ano anos",
}


def _number_of(word: Column, names: dict[int, str]) -> Column:
    return reduce(lambda later, n: F.when(word.isin(names[n].split()), n).otherwise(later), names, F.lit(None))


def _numbered(names: list[str], first: int) -> dict[int, str]:
    return {i: x for i, x in enumerate(names, first)}


def _either(names: list[str]) -> str:
    return "|".join(w for x in names for w in x.split())


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"\s+", " "))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the month or the year 1900 to 2100 has no such day."""
    first = F.when(month.between(1, 12) & year.between(1900, 2100), F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1)))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, day - 1))


def parse_due(said: Column, today: Column, vague: bool = False) -> Column:
    """The day that a due date names: a date, today and tomorrow, so many days, weeks or months on, a weekday after today, a
    day of this month or the next, the month's end. ``vague`` reads next week as its Monday and next month as its first."""
    return _with(_folded(said), lambda s: _due(s, today, vague))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _due(s: Column, today: Column, vague: bool) -> Column:
    group = lambda text, pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda text, pattern, i: group(text, pattern, i).try_cast("int")
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    full, short = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", r"\b(\d{1,2})/(\d{1,2})\b(?!/)"
    named = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?(?: de| of)? ({_either(MONTHS)})\b(?:(?: de|,| of)? (\d{{4}}))?"
    month = _number_of(group(s, named, 2), _numbered(MONTHS, 1))
    next_one = lambda d, m: resolve_year(d, m, today, "next")
    valid = lambda d, m: d.between(1, 31) & m.between(1, 12)
    d, m = number(s, short, 1), number(s, short, 2)
    written = F.coalesce(
        _day(number(s, iso, 1), number(s, iso, 2), number(s, iso, 3)),
        _day(number(s, full, 3), number(s, full, 2), number(s, full, 1)),
        F.when(F.regexp_like(s, F.lit(named)), F.coalesce(_day(number(s, named, 3), month, number(s, named, 1)), F.when(group(s, named, 3) == "", next_one(number(s, named, 1), month)))),
        F.when(valid(d, m), next_one(F.when(valid(d, m), d).otherwise(1), F.when(valid(d, m), m).otherwise(1))),
    )
    # A morning is a time of day.
    later = _with(F.regexp_replace(s, r"\b(por|de|en|esta|la|a la) (la )?manana\b", " "), lambda w: _counted(w, today, vague))
    return F.when(s != "", F.coalesce(written, later))


def _counted(w: Column, today: Column, vague: bool) -> Column:
    """Readings from today on."""
    group = lambda text, pattern, i: F.regexp_extract(text, pattern, i)
    number = lambda text, pattern, i: group(text, pattern, i).try_cast("int")
    has = lambda pattern: F.regexp_like(w, F.lit(pattern))
    step = r"\b(?:en|dentro de|in) (\d+|[a-z]+) (dias?|days?|semanas?|weeks?|mes|meses|months?)\b"
    count = F.coalesce(number(w, step, 1), _number_of(group(w, step, 1), NUMBERS))
    count = F.when(count.between(1, 366), count)
    unit = F.substring(group(w, step, 2), 1, 1)
    on = F.when(unit == "d", F.date_add(today, count)).when((unit == "s") | (unit == "w"), F.date_add(today, count * 7)).when(unit == "m", F.add_months(today, count))
    first = F.trunc(today, "month")
    weekday = _number_of(group(w, rf"\b({_either(WEEKDAYS)})\b", 1), _numbered(WEEKDAYS, 0))
    ahead = F.date_add(today, F.pmod(weekday - F.weekday(today) - 1, F.lit(7)) + 1)
    of_month = r"\b(?:el )?dia (\d{1,2})\b|\bel (\d{1,2})\b(?!\s*(?:de\b|/|-))"
    nth = F.coalesce(number(w, of_month, 1), number(w, of_month, 2))
    here, there = (_day(F.year(x), F.month(x), nth) for x in (first, F.add_months(first, 1)))
    readings = [on, F.when(has(r"\bpasado manana\b|\bday after tomorrow\b"), F.date_add(today, 2)), F.when(has(r"\bmanana\b|\btomorrow\b"), F.date_add(today, 1)), F.when(has(r"\bhoy\b|\btoday\b|\besta noche\b|\btonight\b"), today)]
    if vague:
        readings += [F.when(has(r"\bsemana que viene\b|\bproxima semana\b|\bnext week\b"), F.next_day(today, "Mon")), F.when(has(r"\bmes que viene\b|\bproximo mes\b|\bnext month\b"), F.add_months(first, 1))]
    readings += [ahead, F.when(here >= today, here), F.when(there >= today, there), F.when(has(r"\b(fin|final|finales) del? mes\b|\bend of (the )?month\b"), F.last_day(today))]
    return F.coalesce(*readings)


def resolve_since(said: Column, now: Column) -> Column:
    """Seconds since 1970 of a beginning: seconds, an ISO date or time, an age, or a word; null for what is none of these.
    ``now`` is a timestamp; times without a zone are in the session's."""
    s = _folded(said)
    seconds = F.unix_micros(now) / 1e6
    day = F.date_trunc("day", now)
    at = lambda t: F.unix_micros(t) / 1e6
    iso = F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}([t ][\d:.]+(z|[+-]\d{2}:?\d{2})?)?$")), F.upper(F.regexp_replace(s, "t", " ")))
    words = [
        (["hoy", "today"], at(day)), (["ayer", "yesterday"], at(day - F.expr("INTERVAL 1 DAY"))), (["esta manana", "this morning"], at(day + F.expr("INTERVAL 6 HOURS"))),
        (["esta semana", "this week"], at(F.date_trunc("week", now))), (["este mes", "this month"], at(F.date_trunc("month", now))),
        (["la semana pasada", "last week"], seconds - 7 * 86400), (["el mes pasado", "last month"], seconds - 30 * 86400),
    ]
    named = reduce(lambda later, w: F.when(s.isin(w[0]), w[1]).otherwise(later), reversed(words), F.lit(None))
    one, age = r"^(?:la |el |the )?(?:ultima|ultimo|last|past) ([a-z]+)$", r"^(?:hace |last )?(\d+(?:[.,]\d+)?) ?([a-z]+)(?: ago)?$"
    lasted = _number_of(F.regexp_extract(s, one, 1), UNITS)
    amount = F.replace(F.regexp_extract(s, age, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(
        F.when(F.regexp_like(s, F.lit(r"^\d{9,}(\.\d+)?$")), s.try_cast("double")), at(F.try_to_timestamp(iso)), named, seconds - lasted, seconds - amount * _number_of(F.regexp_extract(s, age, 2), UNITS)
    )
