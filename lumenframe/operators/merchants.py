"""Merchants by mail sender, domain, name or wording, and whether two descriptions mean the same one.

The merchants are a list of a program's own, so each stage is one expression over it and nothing is joined: an exact sender, the
longest domain that ends a host, a name without legal form and signs, then the first wording that is found.

Defined results: null and empty values name none; of equal domains and names the earlier merchant wins; an address is
looked up by its sender and domain before its name; descriptions without significant words are similar to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import fold, plain_key

#: Words of descriptions that say nothing of the merchant.
COMMON = (
    "the and for los las del con por para una pago pagos compra compras recibo factura cargo tarjeta card payment payments purchase invoice receipt order pedido online shop store tienda "
    "com www net org inc ltd llc gmbh slu"
).split()
BANK = r"\b(bank|banco|banca|caja|visa|mastercard)\b"


@dataclass(frozen=True)
class Merchant:
    id: str
    category: str
    domains: tuple[str, ...] = ()
    senders: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    wordings: tuple[str, ...] = ()
    flags: frozenset[str] = frozenset()


def _first(cases: list[tuple[Column, str]]) -> Column:
    return reduce(lambda later, case: F.when(case[0], case[1]).otherwise(later), reversed(cases), F.lit(None).cast("string"))


def _key(name: str) -> str:
    """As ``plain_key`` for plain names without a legal form."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def resolve(value: Column, known: list[Merchant]) -> Column:
    """The id of the merchant that a name, domain, URL or mail sender belongs to; else null."""
    said = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(said)
    address = F.regexp_extract(low, r"([^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)", 1)
    site = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@\s]*@)?((?:[a-z0-9\-]+\.)+[a-z]{2,})(?:[:/?#].*)?$", 1)
    host = F.when(address != "", F.substring_index(address, "@", -1)).otherwise(site)
    senders = _first([(address == s, m.id) for m in known for s in m.senders])
    domains = sorted(((d, m.id) for m in known for d in m.domains), key=lambda x: -len(x[0]))
    by_domain = _first([((host == d) | host.endswith(f".{d}"), i) for d, i in domains])
    key = plain_key(said)
    by_name = _first([(key == _key(n), m.id) for m in known for n in m.names])
    spaced = F.trim(F.regexp_replace(fold(said), "[^a-z0-9]+", " "))
    by_wording = _first([(F.regexp_like(spaced, F.lit(rf"\b{w}\b")), m.id) for m in known for w in m.wordings])
    return F.when(said != "", F.coalesce(F.when(address != "", senders), by_domain, F.when(key != "", F.coalesce(by_name, by_wording))))


def merchant_key(value: Column, known: list[Merchant]) -> Column:
    """The known merchant's id, else the plain name: what rows are grouped by."""
    return F.coalesce(resolve(value, known), plain_key(F.coalesce(value, F.lit(""))))


def significant(value: Column) -> Column:
    """Words of three letters or more that are neither common nor numbers, each once."""
    words = F.split(F.trim(F.regexp_replace(fold(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COMMON) & ~F.regexp_like(w, F.lit("^[0-9]+$"))))


def similar(a: Column, b: Column, known: list[Merchant]) -> Column:
    """Known merchants compare by id; else one's words are all the other's, or half of all are shared, or a word of four
    letters is part of another."""
    one, two = resolve(a, known), resolve(b, known)
    x, y = significant(a), significant(b)
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    glued = F.exists(x, lambda t: F.exists(y, lambda u: (t != u) & (F.length(t) >= 4) & (F.length(u) >= 4) & (F.contains(t, u) | F.contains(u, t))))
    words = (F.size(x) > 0) & (F.size(y) > 0) & (inside | (2 * shared >= every) | glued)
    return F.when(one.isNotNull() & two.isNotNull(), one == two).otherwise(words)


def category_of(value: Column, known: list[Merchant]) -> Column:
    found = resolve(value, known)
    return _first([(found == m.id, m.category) for m in known])


def has_flag(value: Column, flag: str, known: list[Merchant]) -> Column:
    """Whether the known merchant carries a flag; a bank also by the words of an unknown name."""
    flagged = F.coalesce(resolve(value, known).isin([m.id for m in known if flag in m.flags] or [""]), F.lit(False))
    return flagged | F.regexp_like(fold(F.coalesce(value, F.lit(""))), F.lit(BANK)) if flag == "bank" else flagged
