"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters and what they fold to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold(c: Column) -> Column:
    """Lower case without accents, of the same length."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def slugify(c: Column, most: int = 40) -> Column:
    """Folded words joined by dashes, cut at a dash where that leaves something."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(s, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "-")
    cut = F.when((F.substring(s, most + 1, 1) != "-") & (F.instr(head, "-") > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(cut, "-+$", ""))


def clamp(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space and marked by an ellipsis."""
    head = F.substring(c, 1, most - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def safe_filename(c: Column) -> Column:
    """Without the characters and names that file systems reserve."""
    s = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(s == "", "file").when(F.regexp_like(F.upper(s), F.lit(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$")), F.concat(F.lit("_"), s)).otherwise(F.substring(s, 1, 120))


def clean(c: Column) -> Column:
    """One kind of line end, words joined over a hyphen at a line's end, runs of spaces and empty
    lines made one."""
    s = F.regexp_replace(c, "\r\n?", "\n")
    s = F.regexp_replace(s, r"([a-z])-\n([a-z])", "$1$2")
    s = F.regexp_replace(s, "[ \t]+", " ")
    s = F.regexp_replace(s, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(s, "\n{3,}", "\n\n"))


def useful_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def normalize_email(c: Column) -> Column:
    """Lower case, without a tag; dots do not count at one provider."""
    e = F.lower(F.trim(c))
    local, host = F.split_part(F.split_part(e, F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    host = F.when(host == "googlemail.com", "gmail.com").otherwise(host)
    local = F.when(host == "gmail.com", F.replace(local, F.lit("."))).otherwise(local)
    return F.when(F.regexp_like(e, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), F.concat(local, F.lit("@"), host))


def normalize_phone(c: Column, region: str = "34") -> Column:
    """Digits with a country code; a number without one gets the region's."""
    d = F.regexp_replace(c, r"[^0-9+]", "")
    d = F.regexp_replace(d, "^00", "+")
    n = F.length(F.regexp_replace(d, r"\D", ""))
    return F.when(~n.between(7, 15), F.lit(None)).when(d.startswith("+"), d).otherwise(F.concat(F.lit("+" + region), d))


def plain_key(c: Column) -> Column:
    """A company's name without legal form, case, accents and signs."""
    s = F.regexp_replace(fold(c), r"[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, r"\b(s l u|s l|s a|slu|sl|sa|ltd|inc|llc|gmbh|corp|co)\b", " ")
    return F.replace(s, F.lit(" "), F.lit(""))


def format_ts(seconds: Column) -> Column:
    """``h:mm:ss``, or ``m:ss`` below an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def mask_secrets(c: Column) -> Column:
    """Keys, tokens and bearer values replaced."""
    s = F.regexp_replace(c, r'(?i)(token|secret|password|api_key)( ?[=:] ?"?)[A-Za-z0-9_\-]{8,}', "$1$2***")
    s = F.regexp_replace(s, r"(?i)bearer [A-Za-z0-9._\-]{8,}", "Bearer ***")
    return F.regexp_replace(s, r"\b[0-9a-f]{32,}\b", "***")


def semver_key(c: Column) -> Column:
    """A version as a struct that sorts."""
    p = F.split(F.regexp_replace(c, "^v", ""), r"\.")
    part = lambda i: F.coalesce(F.get(p, i).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def merge_page_ranges(pages: Column) -> Column:
    """A sorted array of page numbers as ``1-3, 7``."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    shown = lambda s: F.when(s["a"].isNull(), s["out"]).otherwise(
        F.concat(s["out"], F.when(s["out"] == "", "").otherwise(", "), s["a"].cast("string"), F.when(s["b"] > s["a"], F.concat(F.lit("-"), s["b"].cast("string"))).otherwise(""))
    )
    step = lambda s, x: F.when(s["b"] + 1 == x, F.struct(s["out"].alias("out"), s["a"].alias("a"), x.alias("b"))).otherwise(F.struct(shown(s).alias("out"), x.alias("a"), x.alias("b")))
    return F.aggregate(F.array_sort(F.array_distinct(pages)), start, step, shown)
