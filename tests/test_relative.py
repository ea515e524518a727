"""Sayings of days and moments."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from lumenframe.functions.relative import parse_due, resolve_since

TODAY = date(2026, 1, 31)  # a Saturday


def _due(spark, said, vague=False, today=TODAY):
    rows = spark.createDataFrame([(i, s, today) for i, s in enumerate(said)], "i int, s string, t date")
    return [r[0] for r in rows.orderBy("i").select(parse_due(F.col("s"), F.col("t"), vague)).collect()]


def test_due_dates(spark):
    said = {
        "": None, None: None, "cuando puedas": None, "2026-10-15": date(2026, 10, 15), "el 15/10/2026": date(2026, 10, 15), "15/10": date(2026, 10, 15), "30/01": date(2027, 1, 30),
        "15 de octubre": date(2026, 10, 15), "3 of May, 2027": date(2027, 5, 3), "hoy": TODAY, "Mañana": date(2026, 2, 1), "mañana por la mañana": date(2026, 2, 1), "por la mañana": None,
        "pasado mañana": date(2026, 2, 2), "the day after tomorrow": date(2026, 2, 2), "en 3 días": date(2026, 2, 3), "dentro de dos semanas": date(2026, 2, 14), "en un mes": date(2026, 2, 28),
        "in 367 days": None, "en cero dias": None, "el sábado": date(2026, 2, 7), "next monday": date(2026, 2, 2), "el día 31": TODAY, "el 30": None, "el 5": date(2026, 2, 5), "fin de mes": TODAY,
        "end of the month": TODAY, "la semana que viene": None, "31/02/2026": None, "2026-02-30": None, "29/02/2028": date(2028, 2, 29),
    }
    assert dict(zip(said, _due(spark, said))) == said
    assert _due(spark, ["la semana que viene", "next month", "el mes que viene"], vague=True) == [date(2026, 2, 2), date(2026, 2, 1), date(2026, 2, 1)]


def test_beginnings(spark):
    now = datetime(2026, 1, 31, 15, 30, 10)
    stamp = lambda *a: datetime(*a).timestamp() - (datetime(2026, 1, 31).timestamp() - 1769817600)
    base = 1769817600 + 15 * 3600 + 30 * 60 + 10
    said = {
        "hoy": 1769817600, "YESTERDAY": 1769817600 - 86400, "esta mañana": 1769817600 + 21600, "this week": stamp(2026, 1, 26), "este mes": stamp(2026, 1, 1), "last week": base - 604800,
        "el mes pasado": base - 2592000, "última hora": base - 3600, "2h": base - 7200, "hace 2 horas": base - 7200, "1,5 d": base - 129600, "3 days ago": base - 259200, "1mo": base - 2592000,
        "2026-01-05": stamp(2026, 1, 5), "2026-01-05T10:30": stamp(2026, 1, 5, 10, 30), "2026-01-05T10:30:00Z": stamp(2026, 1, 5, 10, 30), "2026-01-05T10:30:00+02:00": stamp(2026, 1, 5, 8, 30),
        "1700000000": 1700000000, "12345678": None, "soon": None, "3 parsecs": None, "": None, None: None, "2026-13-05": None,
    }
    rows = spark.createDataFrame([(i, s, now) for i, s in enumerate(said)], "i int, s string, n timestamp").withColumn("n", F.lit("2026-01-31 15:30:10").cast("timestamp"))
    got = [r[0] for r in rows.orderBy("i").select(resolve_since(F.col("s"), F.col("n"))).collect()]
    assert dict(zip(said, got)) == said
