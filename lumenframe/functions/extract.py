"""Functions whose decisions depend on earlier output, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def column_function(kind: str):
    """A pandas UDF that is built when a query calls it, since workers import this module too."""
    return lambda f: lambda *columns: F.pandas_udf(f, kind)(*columns)


#: Rows of a batch that a task gives back, and characters of its texts, about.
ROWS, CHARS = 512, 1 << 20


def small_batches(batches: Iterator[pa.RecordBatch], make: Callable[..., Iterable[tuple]], shape: pa.Schema, keys: int) -> Iterator[pa.RecordBatch]:
    """The first ``keys`` columns beside each tuple that ``make`` gives for the others, at most ``ROWS`` to a batch."""
    for batch in batches:
        held, asked = batch.columns[:keys], batch.columns[keys:]
        at, out, size = [], [], 0
        for i in range(len(batch)):
            for row in make(*[c[i].as_py() for c in asked]):
                at.append(i)
                out.append(row)
                size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                if len(out) >= ROWS or size >= CHARS:
                    yield _packed(held, at, out, shape)
                    at, out, size = [], [], 0
        if out:
            yield _packed(held, at, out, shape)


def _packed(held: list[pa.Array], at: list[int], out: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    made = [pa.array(v, k) for v, k in zip(zip(*out), shape.types[len(held) :])]
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int32())) for c in held), *made], shape.names)


def each_row(rows: DataFrame, make: Callable[..., Iterable[tuple]], shape: str, keys: int = 1) -> DataFrame:
    """The first ``keys`` columns of ``rows`` beside each tuple that ``make`` gives for the others. Values become Python
    objects a row at a time and results leave in small batches, so memory follows neither the rows of a batch nor their texts."""
    kinds = StructType([*rows.schema.fields[:keys], *StructType.fromDDL(shape).fields])
    arrow = to_arrow_schema(kinds)
    return rows.mapInArrow(lambda batches: small_batches(batches, make, arrow, keys), kinds)


#: Sizes of chunks in characters.
SIZE, OVERLAP, MIN_TAIL = 900, 150, 200
#: Where a chunk may end, best first: a blank line, a line end, a sentence, a clause, a space.
_BREAKS = [re.compile(x) for x in (r"\n\s*\n", r"\n", r"[.!?]\s", r"[,;:]\s", r"\s")]


def chunk_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, tail: int = MIN_TAIL) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters. The kinds of breaks are tried in turn in the last three fifths
    of a span, and the last of the first kind found ends it. The next span starts ``overlap`` before, at a
    space; a rest shorter than ``tail`` joins the span before it."""
    spans: list[tuple[int, int]] = []
    start = 0
    while start < len(text):
        limit = start + size
        if limit >= len(text):
            spans.append((start, len(text)))
            break
        found = (list(kind.finditer(text, start + size * 2 // 5, limit)) for kind in _BREAKS)
        end = next((x[-1].end() for x in found if x), limit)
        if len(text) - end < tail and len(text) <= start + size + tail:
            spans.append((start, len(text)))
            break
        spans.append((start, end))
        space = text.find(" ", max(start + 1, end - min(overlap, size // 2)), end)
        start = end if space < 0 else space + 1
    return spans


def chunk_text(texts: DataFrame) -> DataFrame:
    """``id, text`` -> a row for each chunk, with its place in the text."""
    made = lambda t: ((i, a, b, t[a:b].strip()) for i, (a, b) in enumerate(chunk_spans(t or "")))
    return each_row(texts, made, "ordinal int, char_start int, char_end int, text string")


def make_snippet(text: str, term: str, width: int = 160) -> str:
    """A window around the first match at a word's start, cut at spaces, with matches marked."""
    m = re.search(r"\b" + re.escape(term), text, re.I)
    at = m.start() if m else 0
    a = max(0, at - width // 2)
    b = min(len(text), a + width)
    if a and (s := text.find(" ", a, at + 1)) >= 0:
        a = s + 1
    if b < len(text) and (s := text.rfind(" ", at, b)) > 0:
        b = s
    part = text[a:b].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    part = re.sub(r"\b" + re.escape(term) + r"\w*", lambda m: f"<mark>{m.group()}</mark>", part, flags=re.I)
    return ("…" if a else "") + part + ("…" if b < len(text) else "")


def snippet(term: str):
    """A UDF for one term."""

    @column_function("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: make_snippet(t or "", term))

    return run


#: Elements without readable text, page furniture, and elements that break lines.
SKIPPED = frozenset("script style noscript template svg iframe canvas head title meta link dialog object embed base".split())
FURNITURE = frozenset("nav footer aside form header".split())
BLOCKS = frozenset("p div section article main ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre br hr dd dt figure".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Collects title, text, links and meta tags in one pass; never fails on broken markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.main: list[str] = []
        self.open: list[str] = []
        self.title, self.meta, self.links = "", {}, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (k := a.get("property") or a.get("name")):
            self.meta.setdefault(k.lower(), a.get("content") or "")
        elif tag == "link" and "canonical" in (a.get("rel") or ""):
            self.meta.setdefault("canonical", a.get("href") or "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BLOCKS:
            self._put("\n")
        if tag not in VOID:
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
            self.open.append(("!" if hidden else "") + tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].lstrip("!") == tag:
                del self.open[i:]
                break
        if tag in BLOCKS:
            self._put("\n")

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
        self._put(data)

    def _put(self, data):
        if any(t[0] == "!" or t in SKIPPED for t in self.open):
            return
        if not any(t in FURNITURE for t in self.open):
            self.out.append(data)
            if "main" in self.open or "article" in self.open:
                self.main.append(data)


def read_html(html: str) -> dict:
    """Title, readable text, description, canonical address and number of links."""
    r = _Reader()
    r.feed(html)
    r.close()

    def tidy(parts: list[str]) -> str:
        lines = [" ".join(x.split()) for x in "".join(parts).split("\n")]
        lines = [x for x in lines if x]
        return "\n".join(x for i, x in enumerate(lines) if not i or x != lines[i - 1])

    main = tidy(r.main)
    text = main if len(main.split()) >= 40 else tidy(r.out)
    title = r.meta.get("og:title") or r.meta.get("twitter:title") or " ".join(r.title.split())
    return {"title": title[:300], "text": text, "description": r.meta.get("og:description") or r.meta.get("description"), "canonical": r.meta.get("canonical") or r.meta.get("og:url"), "n_links": len(r.links)}


def readable(html: DataFrame) -> DataFrame:
    """``id, html`` -> ``id`` and what ``read_html`` finds."""
    return each_row(html, lambda h: [tuple(read_html(h or "").values())], "title string, text string, description string, canonical string, n_links int")


#: Month names in four languages.
MONTHS = {
    m: i % 12 + 1
    for i, m in enumerate(
        "january february march april may june july august september october november december "
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
        "januar februar märz april mai juni juli august september oktober november dezember".split()
    )
}
_DATE = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b|\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b|\b(\d{1,2})\.? (?:de )?(" + "|".join(MONTHS) + r")(?: de)? (\d{4})\b", re.I)


def dates_in(text: str) -> list[str]:
    """ISO days named in a text, in order; days that do not exist are left out."""
    out = []
    for m in _DATE.finditer(text):
        g = m.groups()
        y, mo, d = (g[0], g[1], g[2]) if g[0] else (g[5], g[4], g[3]) if g[5] else (g[8], MONTHS[g[7].lower()], g[6])
        try:
            out.append(date(int(y), int(mo), int(d)).isoformat())
        except ValueError:
            continue
    return out


@column_function("array<string>")
def find_dates(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: dates_in(t or ""))


_PRICE = re.compile(r"([$€£]) ?(\d[\d.,]*\d|\d)|(\d[\d.,]*\d|\d) ?(€|EUR|USD|GBP)\b")


def prices_in(text: str) -> list[dict]:
    """Amounts with a currency."""
    names = {"$": "USD", "€": "EUR", "£": "GBP"}
    return [{"currency": names.get(m[1] or m[4], m[1] or m[4]), "amount": m[2] or m[3], "at": m.start()} for m in _PRICE.finditer(text)]


@column_function("array<struct<currency:string,amount:string,at:int>>")
def find_prices(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: prices_in(t or ""))


def page_splits(text: str, size: int) -> list[str]:
    """Paragraphs packed greedily into pages of at most ``size`` characters."""
    pages: list[str] = []
    for p in re.split(r"\n+", text):
        while len(p) > size:
            pages.append(p[:size])
            p = p[size:]
        if pages and len(pages[-1]) + len(p) + 1 <= size:
            pages[-1] += "\n" + p
        elif p:
            pages.append(p)
    return pages


def split_pages(texts: DataFrame) -> DataFrame:
    """``id, text`` -> a row for each page."""
    return each_row(texts, lambda t: enumerate(page_splits(t or "", 2000)), "page int, text string")


_CUE = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})[^\n]*\n(.*?)(?=\n\s*\n|\Z)", re.S)


def cues_in(text: str) -> list[dict]:
    """Cues of SRT or WebVTT text."""
    seconds = lambda h, m, s, f: int(h or 0) * 3600 + int(m) * 60 + int(s) + int(f.ljust(3, "0")) / 1000
    return [{"start": seconds(*m.group(1, 2, 3, 4)), "end": seconds(*m.group(5, 6, 7, 8)), "text": re.sub(r"<[^>]+>", "", m[9]).replace("\n", " ").strip()} for m in _CUE.finditer(text.replace("\r", ""))]


@column_function("array<struct<start:double,end:double,text:string>>")
def parse_cues(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cues_in(t or ""))


def settle(balances: dict[str, int]) -> list[tuple[str, str, int]]:
    """Transfers that clear balances in cents: the largest debt pays the largest credit."""
    creditors = [(-v, k) for k, v in balances.items() if v > 0]
    debtors = [(v, k) for k, v in balances.items() if v < 0]
    heapq.heapify(creditors)
    heapq.heapify(debtors)
    out = []
    while creditors and debtors:
        (credit, creditor), (debt, debtor) = creditors[0], debtors[0]
        n = min(-credit, -debt)
        out.append((debtor, creditor, n))
        # Who is cleared leaves; the other's rest finds its place among the others.
        for heap, rest, who in ((creditors, credit + n, creditor), (debtors, debt + n, debtor)):
            if rest:
                heapq.heapreplace(heap, (rest, who))
            else:
                heapq.heappop(heap)
    return out


#: Leading bytes of file kinds.
MAGIC = [(b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF8", "gif"), (b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"PAR1", "parquet"), (b"SQLite format 3\x00", "sqlite"), (b"RIFF", "riff"), (b"\x1f\x8b", "gzip"), (b"BM", "bmp")]


@column_function("string")
def sniff(head: pd.Series) -> pd.Series:
    """The kind of a file from its first bytes."""
    return head.map(lambda b: next((k for m, k in MAGIC if bytes(b or b"").startswith(m)), "text"))
