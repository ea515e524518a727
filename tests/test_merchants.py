"""Merchant resolution and likeness on descriptions of many kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import merchants as me

KNOWN = [
    me.Merchant("amazing", "shopping", ("amazing.com",), ("pay@bank.example",), ("Amazing",), (r"amzg mktp",), frozenset({"subscription"})),
    me.Merchant("amazing-web", "cloud", ("web.amazing.com",), (), ("Amazing Web Services",), (r"amazing web",)),
]


def test_resolution(spark):
    said = {
        None: None, "": None, "amazing.com": "amazing", "https://x.web.amazing.com/a": "amazing-web", "notamazing.com": None, "A <hi@mail.amazing.com>": "amazing", "pay@bank.example": "amazing",
        "other@bank.example": None, "AMAZING, S.L.": "amazing", "Compra AMZG*MKTP 12": "amazing", "amazing web things": "amazing-web", "amaz": None, "--": None,
    }
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i")
    assert dict(zip(said, [r[0] for r in rows.select(me.resolve(F.col("s"), KNOWN)).collect()])) == said


def test_likeness_and_flags(spark):
    pairs = {
        ("Amazing", "amazing web services"): False, ("Amazing SL", "amazing.com"): True, ("Netflicks Billing", "NETFLICKSCOM"): True, ("Bar Manolo", "Bar Pepe"): False, ("Bar Manolo Sol", "manolo bar"): True,
        ("one two", "one three"): False, ("", "x"): False, (None, None): False, ("compra 123", "compra 123"): False, ("uno dos tres", "dos tres cuatro"): True,
    }
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert dict(zip(pairs, [r[0] for r in rows.select(me.similar(F.col("a"), F.col("b"), KNOWN)).collect()])) == pairs
    one = spark.createDataFrame([("amazing", "Banco Uno", None)], "a string, b string, c string")
    flags = [me.has_flag(F.col(c), f, KNOWN) for c, f in (("a", "subscription"), ("a", "bank"), ("b", "bank"), ("c", "bank"))]
    assert tuple(one.select(*flags).first()) == (True, False, True, False)
    assert tuple(one.select(me.category_of(F.col("a"), KNOWN), me.merchant_key(F.col("b"), KNOWN), me.merchant_key(F.col("c"), KNOWN)).first()) == ("shopping", "bancouno", "")
