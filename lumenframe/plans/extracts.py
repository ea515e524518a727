"""Queries of functions that need Python, checked by rows and by tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lumenframe.functions import extract, markdown
from lumenframe.plans.registry import query
from lumenframe.plans.views import table
from lumenframe.sources.files import cue_lines
from lumenframe.streaming import captions


@query("X12_chunk_text")
def chunk_text(spark, d):
    """Chunks of every document with their places in the text."""
    return extract.chunk_text(table(spark, d, "documents").select("doc_id", "text"))


@query("X11_split_pages")
def split_pages(spark, d):
    return extract.split_pages(table(spark, d, "documents").select("doc_id", "text"))


@query("R13_snippet")
def snippet(spark, d):
    """A marked window around a term in each text that has it."""
    docs = table(spark, d, "documents").where(F.regexp_like("text", F.lit(r"(?i)\bthat")))
    return docs.select("doc_id", extract.snippet("that")("text").alias("snippet"))


@query("H06_H11_readable")
def readable(spark, d):
    """Title, readable text and meta fields of every page."""
    return extract.readable(table(spark, d, "pages").select("page_id", "html"))


@query("D06_find_dates")
def find_dates(spark, d):
    text = F.concat(F.lit("due "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", paid 3 de mayo de 1997, lost 2026-02-30"))
    return table(spark, d, "orders").select("o_orderkey", extract.find_dates(text).alias("days"))


@query("N03_find_prices")
def find_prices(spark, d):
    text = F.concat(F.lit("total €"), F.col("o_totalprice").cast("string"), F.lit(" plus 3,50 EUR"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(extract.find_prices(text)).alias("p")).select("o_orderkey", "p.*")


@query("S14_S15_subtitles")
def subtitles(spark, d):
    """Turns written as subtitles, one text for each conversation, and read again."""
    cues = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return cue_lines(cues, "conv_id").select("conv_id", F.explode(extract.parse_cues("srt")).alias("c")).select("conv_id", "c.*")


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"), "text")


@query("W05_G08_rolling_captions")
def rolling_captions(spark, d):
    """Turns of a conversation as captions, without rolling repeats."""
    return captions.cleaned(_turns(spark, d), "rolling", "conv_id", "turn")


@query("W06_clean_segments")
def clean_segments(spark, d):
    """Turns of a conversation as speech segments, every third said five times over, without what speech models invent."""
    said = F.when(F.col("turn") % 3 == 0, F.repeat(F.concat(F.substring_index("text", " ", 3), F.lit(" ")), 5)).otherwise(F.col("text"))
    return captions.cleaned(_turns(spark, d).withColumn("text", said), "segments", "conv_id", "turn")


@query("A20_settle")
def settle(spark, d):
    """Transfers that clear the balances of each segment's first customers."""
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        mean = int(rows["cents"].sum()) // len(rows)
        balances = {n: int(v) - mean for n, v in zip(rows["name"], rows["cents"])}
        balances[rows["name"].iloc[0]] -= sum(balances.values())
        out = extract.settle(balances)
        return pd.DataFrame({"nation": rows["c_nationkey"].iloc[0], "payer": [x[0] for x in out], "payee": [x[1] for x in out], "cents": [x[2] for x in out]})

    return c.groupBy("c_nationkey").applyInPandas(run, "nation int, payer string, payee string, cents long")


@query("S08_sniff")
def sniff(spark, d):
    """The kind of each page's bytes, a few given a false beginning."""
    head = F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("FFD8FF00"))).when(F.col("page_id") % 5 == 1, F.lit("%PDF-1.7").cast("binary")).otherwise(F.substring("html", 1, 16).cast("binary"))
    return table(spark, d, "pages").select("page_id", extract.sniff(head).alias("kind"))


def _front():
    """Front matter for a third of the pages."""
    return F.when(F.col("page_id") % 3 == 0, F.format_string("---\ntitle: Page %d\nlang: xx\n---\n", "page_id")).otherwise("")


def _markdown(spark, d):
    """Every page as Markdown, a third of them with front matter."""
    made = markdown.markdown_of(table(spark, d, "pages").select("page_id", "html", "url"))
    return made.select("page_id", F.concat(_front(), "markdown").alias("markdown"))


@query("H07_markdown")
def to_markdown(spark, d):
    """Every page as Markdown and as the text of that."""
    return markdown.both_of(table(spark, d, "pages").select("page_id", "html", "url"))


@query("X13_chunk_markdown")
def chunk_markdown(spark, d):
    """Every page's Markdown in chunks under its headings."""
    return markdown.chunks_of(table(spark, d, "pages").select("page_id", _front().alias("front"), "html", "url"))
