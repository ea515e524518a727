"""Quality rules: a table of thresholds compiled into Spark projections without user functions.

Defined results: a null text has no words and fails the base; so does an empty one. Rows that
repeat are judged one by one. Other columns of the input are ignored, whatever their names.
Three-word windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import words

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on with as be by this are from at an",
    "fr": "le la les de des du et un une en que qui est pour dans par sur au pas",
    "de": "der die das und den von zu mit ist ein eine nicht dem im auf des sich",
    "es": "el la los las de del y que en un una por con para se su al no es lo",
}


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * part / total <= high``; a bound of None does not count. Exact, in longs."""

    name: str
    part: str
    total: str
    low: int | None
    high: int | None


#: The threshold table, in thousandths.
RULES = (
    Rule("length", "n_words", "one", 50_000, 200_000_000),
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("unclosed_lines", "n_ellipsis_lines", "n_lines", None, 300),
)


def _once(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with further columns, made by a generator of one row. Filters and projections do
    not move below a generator, so an expression is computed once for a row, whatever uses it."""
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _measures(docs: DataFrame, text_col: str, **kept: Column) -> DataFrame:
    """The counts of each row, and the ``kept`` columns."""
    stop = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    has_word = lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""
    rows = docs.select(*[c.alias(k) for k, c in kept.items()], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    one = _once(rows, words=words(F.col("t")), lines=F.filter(F.split("t", "\n"), has_word))
    at = lambda i: F.get(F.col("words"), i)
    window = lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p"))
    spans = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    two = _once(
        one,
        n_symbols=(F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long"),
        word_chars=F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long"),
        n_words=F.size("words").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_ellipsis_lines=F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        n_stop_words=F.size(F.filter("words", lambda w: w.isin(stop))).cast("long"),
        windows=F.sort_array(F.transform(spans, window)),
    ).drop("t", "words", "lines")
    w = F.col("windows")
    twice = F.filter(w, lambda x, i: (x["h"] == F.get(w, i - 1)["h"]) | (x["h"] == F.get(w, i + 1)["h"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    cover = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["p"])),
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return _once(two, n_repeat_words=cover, one=F.lit(1).cast("long")).drop("windows")


def _passes(rule: Rule) -> Column:
    part, total, checks = F.col(rule.part) * 1000, F.col(rule.total), []
    if rule.low is not None:
        checks.append(part >= total * rule.low)
    if rule.high is not None:
        checks.append(part <= total * rule.high)
    return reduce(lambda a, b: a & b, checks)


def _judged(measures: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]))
    judged = measures.withColumn("base_failed", base).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``kept`` and ``failed_rules``."""
    return _judged(_measures(docs, text_col, doc_id=F.col(id_col)), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def keep_passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are."""
    return _judged(_measures(docs, text_col, row=F.struct("*")), rules).where("kept").select("row.*")
