"""Dates, money and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Cents, half away from zero."""
    return F.round(amount.cast("decimal(18,6)") * 100, 0).cast("long")


def parse_amount(c: Column) -> Column:
    """An amount in either notation: the later of two marks is the decimal one; a single mark with
    three digits behind it groups thousands."""
    s = F.regexp_replace(c, r"[^0-9.,\-]", "")
    comma, dot = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    has_comma, has_dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    english, european = F.replace(s, F.lit(",")), F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))
    grouped = F.regexp_like(s, F.lit(r"^-?[0-9]{1,3}([.,][0-9]{3})+$"))
    plain = F.when(has_comma & has_dot, F.when(dot > comma, english).otherwise(european)).when(grouped, F.regexp_replace(s, "[.,]", "")).when(has_comma, european).otherwise(english)
    return plain.try_cast("decimal(18,4)")


def format_money(cents: Column, locale: str = "es") -> Column:
    """``1.234,50 €``, ``€1,234.50`` or ``1 234,50 €``."""
    us = F.format_number((cents / 100).cast("decimal(18,2)"), 2)
    if locale == "en":
        return F.concat(F.lit("€"), us)
    return F.concat(F.translate(us, ",.", ".," if locale == "es" else " ,"), F.lit(" €"))


def split_shares(rows: DataFrame, key: str, id_col: str, weight: str, total: str) -> DataFrame:
    """``share`` of each row: a key's total in cents by weight, the rest to the largest remainders."""
    w = Window.partitionBy(key)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(w)
    base = F.floor(exact + 1e-9).cast("long")
    rows = rows.withColumn("_base", base).withColumn("_rest", F.round(exact - base, 9))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_base").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.col("_rest").desc(), id_col)))
    return rows.withColumn("share", F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_base", "_rest", "_left", "_rank")


def _weighted(digits: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")), w, lambda a, b: a * b), F.lit(0), lambda s, x: s + x)


def luhn_ok(c: Column) -> Column:
    d = F.regexp_replace(c, "[ -]", "")
    return F.regexp_like(d, F.lit("^[0-9]{2,}$")) & F.expr("true") & F.call_function("luhn_check", F.regexp_replace(d, "[^0-9]", "0"))


def ean_ok(c: Column) -> Column:
    """A 13-digit article number with a right last digit."""
    shaped = F.regexp_like(c, F.lit("^[0-9]{13}$"))
    return F.when(shaped, _weighted(F.when(shaped, c).otherwise("0"), [1, 3] * 6 + [1]) % 10 == 0).otherwise(False)


def dni_ok(c: Column) -> Column:
    """Eight digits and their letter."""
    n = F.regexp_extract(F.upper(c), "^([0-9]{8})([A-Z])$", 1)
    letter = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (F.coalesce(n.try_cast("int"), F.lit(0)) % 23 + 1), F.lit(1))
    return (n != "") & (F.regexp_extract(F.upper(c), "^([0-9]{8})([A-Z])$", 2) == letter)


def iban_ok(c: Column) -> Column:
    """Remainder 1 of 97, taken a few characters at a time."""
    s = F.upper(F.regexp_replace(c, " ", ""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda x: x != "")
    value = lambda x: F.when(F.regexp_like(x, F.lit("[0-9]")), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda r, x: F.when(value(x) > 9, (r * 100 + value(x)) % 97).otherwise((r * 10 + value(x)) % 97))
    return F.regexp_like(s, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")) & (rest == 1)


def easter(year: Column) -> Column:
    """Easter Sunday, by the anonymous Gregorian rule."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, 451)
    month, day = div(h + m - 7 * n + 114, 31), (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(y, month, day)


#: Months and days of yearly holidays.
HOLIDAYS = [(1, 1), (5, 1), (12, 25)]


def is_business_day(day: Column, fixed: list[tuple[int, int]] = HOLIDAYS) -> Column:
    """Monday to Friday, and neither a fixed holiday nor Good Friday."""
    holiday = F.struct(F.month(day), F.day(day)).isin([F.struct(F.lit(m), F.lit(x)) for m, x in fixed])
    return (F.weekday(day) < 5) & ~holiday & (day != F.date_sub(easter(F.year(day)), 2))


def calendar(dates: list[Column], rows: DataFrame, fixed: list[tuple[int, int]] = HOLIDAYS) -> DataFrame:
    """``day, business, nth`` of each day from the first to the last of ``dates`` in ``rows``: whether it is a
    business day, and how many came before. As long as the dates span, however many rows there are."""
    ends = rows.agg(F.min(F.least(*dates)).alias("first"), F.max(F.greatest(*dates)).alias("last"))
    days = ends.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day")).withColumn("business", is_business_day(F.col("day"), fixed))
    return days.withColumn("nth", F.sum(F.col("business").cast("long")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["nth"])
