"""Folders however they are spelled, and lines of text that an export broke apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_key(path: Column) -> Column:
    """A path without ``.``, ``..``, doubled or back slashes; ``..`` never climbs above a root."""
    s = F.translate(path, "\\", "/")
    s = F.regexp_replace(F.regexp_replace(s, r"^//[?.]/UNC/", "//"), r"^//[?.]/", "")
    prefix = F.regexp_extract(s, r"^(//[^/]+(?:/[^/]*)?|[A-Za-z]:)", 1)
    rest = F.substring(s, F.length(prefix) + 1, F.length(s))
    absolute = rest.startswith("/") | (prefix != "")

    def step(done: Column, part: Column) -> Column:
        up = F.try_element_at(done, F.lit(-1)) != ".."
        climbed = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part == "..", climbed).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(rest, "/"), lambda x: (x != "") & (x != "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    drive = F.when(prefix.startswith("//"), prefix).otherwise(F.lower(prefix))
    return F.when(absolute, F.concat(drive, F.lit("/"), joined)).otherwise(joined)


def folder_within(path: Column, root: Column) -> Column:
    p, r = folder_key(path), folder_key(root)
    return (p == r) | F.startswith(p, F.when(F.endswith(r, F.lit("/")), r).otherwise(F.concat(r, F.lit("/"))))


#: Lines a text must have, the percentage of single words among them, and the length of a short line.
STACKED_LINES, STACKED_PERCENT, SHORT_LINE = 20, 60, 14


def unstack_words(text: Column) -> Column:
    """A column of words as running text: where enough lines have no space inside, and more than half are
    short, the lines that are not blank are joined by spaces."""
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\S[^\n]*"), F.lit(0))
    single = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^\s*\S([^ ]*\S)?\s*$"))))
    short = F.size(F.filter(lines, lambda x: F.length(x) <= SHORT_LINE))
    stacked = (F.size(lines) >= STACKED_LINES) & (100 * single > STACKED_PERCENT * F.size(lines)) & (short > F.floor(F.size(lines) / 2))
    return F.when(stacked, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), " ")).otherwise(text)


def ancestors(path: Column, sep: str = "/") -> Column:
    """Every beginning of a path at a separator, itself included."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def overlaps(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """``left`` with ``overlaps``: rows of ``right`` with the same path, one above or one below. The right side is
    counted by path before it is joined, so a common path meets as one row; a null path overlaps nothing."""
    at = right.groupBy(path).agg(F.count(F.lit(1)).alias("_n")).where(F.col(path).isNotNull())
    below = at.select("_n", F.explode(ancestors(F.col(path))).alias("_path")).groupBy("_path").agg(F.sum("_n").alias("_below"))
    asked = left.select(path).distinct().where(F.col(path).isNotNull())
    above = asked.select(path, F.explode(ancestors(F.col(path))).alias("_path")).where(F.col("_path") != F.col(path))
    above = above.join(at.withColumnRenamed(path, "_path"), "_path").groupBy(path).agg(F.sum("_n").alias("_above"))
    counts = asked.join(above, path, "left").join(below.withColumnRenamed("_path", path), path, "left")
    counts = counts.select(path, (F.coalesce("_above", F.lit(0)) + F.coalesce("_below", F.lit(0))).cast("long").alias("overlaps"))
    return left.join(counts, path, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0).cast("long")))
