"""HTML as Markdown, Markdown as text, and Markdown cut into chunks by its headings.

HTML is read into a tree in which elements close those that they may not stand in. Writing goes from the
outside in: a node gives blocks, a run of inline nodes gives one paragraph, and only blocks know of blank lines.

Defined results: null and empty documents give empty texts and no chunks; broken markup never fails; a
table of one column or with a table inside is written as its blocks; headings inside code fences are text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame

from lumenframe.functions.extract import BLOCKS, FURNITURE, SKIPPED, VOID, chunk_spans, each_row

#: Which open elements a start tag closes, up to the element that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr"}, {"table"}),
}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - {"br", "tr"} | {"dl", "tbody", "thead"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def text(self, between: str = "") -> str:
        return between.join(k if isinstance(k, str) else "" if k.hidden() else k.text(between) for k in self.kids)

    def hidden(self) -> bool:
        a = self.attrs
        return self.tag in SKIPPED or self.tag in FURNITURE or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")

    def is_block(self) -> bool:
        return self.tag in BLOCKS and self.tag != "br" or any(isinstance(k, Node) and k.is_block() for k in self.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("#document")]

    def _close(self, tags: set[str], until: set[str]) -> None:
        at = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                break
            if self.open[i].tag in tags:
                at = i
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "td", "th", "li", "blockquote", "div"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag):
        place = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if place:
            del self.open[place:]

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str) -> Node:
    reader = _Tree()
    reader.feed(html)
    reader.close()
    return reader.open[0]


def main_part(root: Node) -> Node:
    """The element that holds the content: main, article, or the body."""
    for wanted in (lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") in ("content", "main", "main-content"), lambda n: n.tag == "body"):
        found = [n for n in root.walk() if wanted(n)]
        if found:
            if len(found) > 1 and found[0].tag == "article":
                every = Node("div")
                every.kids = [n for n in found if not any(n is not m and n in list(m.walk()) for m in found)]
                return every
            return found[0]
    return root


def _squeezed(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text).strip()


class Writer:
    """Markdown of a tree; ``base`` resolves links."""

    def __init__(self, base: str = ""):
        self.base = base

    def link(self, href: str) -> str | None:
        href = href.strip()
        if not href or href.lower().startswith(("javascript:", "data:", "vbscript:")):
            return None
        try:
            return urljoin(self.base, href) if self.base and not href.lower().startswith(("mailto:", "tel:")) else href
        except ValueError:
            return href

    def inline(self, kids: list) -> str:
        return _squeezed("".join(k if isinstance(k, str) else self.span(k) for k in kids))

    def span(self, node: Node) -> str:
        if node.hidden() or node.tag in ("ul", "ol"):
            return ""
        if node.tag == "br":
            return "\n"
        if node.tag == "img":
            alt, src = node.attrs.get("alt", "").strip(), node.attrs.get("src", "").strip()
            return f"![{alt}]({self.link(src) or src})" if alt and src else ""
        if node.tag == "code":
            said = node.text().strip()
            return f"`{said}`" if said else ""
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*"}.get(node.tag)
        if mark:
            said = self.inline(node.kids)
            return f"{mark}{said}{mark}" if said else ""
        if node.tag == "a":
            said, url = self.inline(node.kids) or node.attrs.get("href", "").strip(), self.link(node.attrs.get("href", ""))
            return f"[{said}]({url})" if said and url else said
        said = "".join(k if isinstance(k, str) else self.span(k) for k in node.kids)
        return f" {said} " if node.tag in BLOCKS else said

    def blocks(self, node: Node) -> Iterator[str]:
        run: list = []
        for kid in [*node.kids, None]:
            if kid is not None and (isinstance(kid, str) or not kid.hidden() and not kid.is_block()):
                run.append(kid)
                continue
            if run and (said := self.inline(run)):
                yield said
            run = []
            if kid is not None and not kid.hidden():
                yield from self.block(kid)

    def block(self, node: Node) -> Iterator[str]:
        tag = node.tag
        if tag in HEADINGS or tag == "p":
            said = self.inline(node.kids)
            if said:
                yield "#" * HEADINGS[tag] + " " + said if tag in HEADINGS else said
        elif tag in ("ul", "ol"):
            lines = list(self.items(node, 0))
            if lines:
                yield "\n".join(lines)
        elif tag == "pre":
            yield self.code(node)
        elif tag == "hr":
            yield "---"
        elif tag == "blockquote":
            inside = "\n\n".join(self.blocks(node))
            if inside.strip():
                yield "\n".join(("> " + line).rstrip() for line in inside.split("\n"))
        elif tag == "table" and (rows := self.rows(node)):
            yield "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]])
        else:
            yield from self.blocks(node)

    def items(self, node: Node, depth: int) -> Iterator[str]:
        for n, item in enumerate((k for k in node.kids if isinstance(k, Node) and k.tag == "li"), 1):
            said = self.inline(item.kids)
            if said:
                yield "  " * depth + (f"{n}. " if node.tag == "ol" else "- ") + said
            for nested in item.kids:
                if isinstance(nested, Node) and nested.tag in ("ul", "ol"):
                    yield from self.items(nested, depth + 1)

    def code(self, node: Node) -> str:
        inner = next((n for n in node.walk() if n.tag == "code"), node)
        named = re.search(r"(?:^|\s)(?:language|lang|highlight-source)-(\S+)", " ".join(n.attrs.get("class", "") for n in (inner, node)))
        body = "".join(k for n in inner.walk() for k in n.kids if isinstance(k, str)).strip("\n") if inner.kids and not any(isinstance(k, Node) for k in inner.kids) else inner.text().strip("\n")
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
        return f"{fence}{named[1] if named else ''}\n{body}\n{fence}"

    def rows(self, table: Node) -> list[list[str]]:
        if any(n is not table and n.tag == "table" for n in table.walk()):
            return []
        cells = [[" ".join(c.text(" ").split()).replace("|", "\\|") for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")] for tr in table.walk() if tr.tag == "tr"]
        cells = [r for r in cells if r]
        width = max(map(len, cells), default=0)
        return [r + [""] * (width - len(r)) for r in cells] if width > 1 else []


def to_markdown(html: str, base: str = "") -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in Writer(base).blocks(main_part(tree(html))) if b.strip())).strip()


_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"), (re.compile(r"\[\]\(([^)]*)\)"), r"\1"),
    (re.compile(r"`([^`]*)`"), r"\1"), (re.compile(r"\*\*([^*]+)\*\*"), r"\1"), (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), r"\1"),
]
_RULER = re.compile(r"^-{3,}$|^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def fenced(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Each line with what it is: ``fence``, ``code`` or ``text``."""
    fence = ""
    for line in lines:
        mark = re.match(r"^\s{0,3}(```+|~~~)", line)
        if mark and (not fence or mark[1] == fence):
            fence = "" if fence else mark[1]
            yield line, "fence"
        else:
            yield line, "code" if fence else "text"


def to_text(markdown: str) -> str:
    """Markdown without its marks: code stays as it is, table rows become their cells."""
    out = []
    for line, kind in fenced(markdown.split("\n")):
        if kind == "fence":
            continue
        if kind == "text":
            if _RULER.match(line):
                out.append("")
                continue
            line = re.sub(r"^>\s?", "", re.sub(r"^#{1,6}\s+", "", line))
            line = re.sub(r"^(\s*)([-*]|\d+\.)\s+", r"\1", line)
            for pattern, put in _INLINE:
                line = pattern.sub(put, line)
            bare = line.strip()
            if len(bare) > 2 and bare[0] == bare[-1] == "|":
                line = " ".join(c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", bare.strip("|")) if c.strip())
        out.append(re.sub(r"[ \t]+", " ", line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)


def frontmatter(text: str) -> tuple[dict[str, str], int]:
    """The ``key: value`` lines of a leading block, keys in lower case, and where the body begins."""
    found = _FRONT.match(text)
    if not found:
        return {}, 0
    pairs = (line.partition(":") for line in found[1].splitlines() if ":" in line)
    return {k.strip().lower(): v.strip().strip('"').strip("'") for k, _, v in pairs}, found.end()


def _heading(line: str) -> tuple[int, str] | None:
    found = re.match(r"^(#{1,6})[ \t]+(.*?)[ \t#]*$", line)
    return (len(found[1]), found[2].strip()) if found else None


def title(text: str, default: str = "") -> str:
    """The title of the front matter, else the first heading of level one."""
    named, at = frontmatter(text)
    if named.get("title"):
        return named["title"]
    heads = (_heading(line.rstrip("\r")) for line, kind in fenced(text[at:].split("\n")) if kind == "text")
    return next((h[1] for h in heads if h and h[0] == 1), default)


def sections(text: str) -> Iterator[tuple[list[str], int, str]]:
    """``(headings above, first line, content)`` of each part between headings that has content."""
    at = frontmatter(text)[1]
    above: dict[int, str] = {}
    first, lines = text.count("\n", 0, at) + 1, []
    numbered = enumerate(fenced(text[at:].split("\n")), first)
    for n, (line, kind) in [*numbered, (0, ("# ", "end"))]:
        line = line.rstrip("\r")
        head = _heading(line) if kind == "text" else None
        if not head and kind != "end":
            lines.append(line)
            continue
        content = "\n".join(lines)
        if content.strip():
            yield [above[k] for k in sorted(above) if above[k]], first + len(content[: len(content) - len(content.lstrip("\n"))]), content.strip()
        if head:
            above = {k: v for k, v in above.items() if k < head[0]} | {head[0]: head[1]}
            first, lines = n + 1, []


def packed(content: str, size: int) -> Iterator[tuple[int, int]]:
    """Whole paragraphs, as many as fit; one that is too long is cut at its best breaks."""
    ends = [(m.start(), m.end()) for m in re.finditer(r"\n[ \t]*\n", content)] + [(len(content), len(content))]
    begin, stop, at = None, 0, 0
    for end, after in ends:
        start, at = at, after
        if start >= end:
            continue
        if begin is not None and end - begin > size:
            yield begin, stop
            begin = None
        if end - start > size:
            rest = start
            while end - rest > size:
                piece = rest + chunk_spans(content[rest:end], size, 0, 0)[0][1]
                yield rest, piece
                rest = piece + len(content[piece:end]) - len(content[piece:end].lstrip())
            start = rest
        if start < end:
            begin, stop = start if begin is None else begin, end
    if begin is not None:
        yield begin, stop


def chunks(text: str, size: int = 1200) -> list[dict]:
    """Chunks of one section each, of at most ``size`` characters, with the headings above and the line."""
    out, name = [], title(text)
    for n, (above, first, content) in enumerate(sections(text)):
        for a, b in packed(content, size):
            a += len(content[a:b]) - len(content[a:b].lstrip())
            body = content[a:b].rstrip()
            if body:
                out.append({"section_no": n, "ordinal": len(out), "section": " § ".join(above) or name, "line": first + content.count("\n", 0, a), "char_start": a, "char_end": a + len(body), "text": body})
    return out


def markdown_of(pages: DataFrame) -> DataFrame:
    """``id, html, url`` -> ``id, markdown``."""
    return each_row(pages, lambda html, base: [(to_markdown(html or "", base or ""),)], "markdown string")


def both_of(pages: DataFrame) -> DataFrame:
    """``id, html, url`` -> ``id, markdown`` and the text of that."""

    def made(html: str | None, base: str | None) -> list[tuple[str, str]]:
        markdown = to_markdown(html or "", base or "")
        return [(markdown, to_text(markdown))]

    return each_row(pages, made, "markdown string, text string")


def chunks_of(pages: DataFrame) -> DataFrame:
    """``id, front, html, url`` -> a row for each chunk of the page's Markdown below ``front``."""

    def made(front: str, html: str | None, base: str | None) -> Iterator[tuple]:
        return (tuple(c.values()) for c in chunks(front + to_markdown(html or "", base or "")))

    return each_row(pages, made, "section_no int, ordinal int, section string, line int, char_start int, char_end int, text string")
