"""HTML to Markdown to text, and Markdown chunks."""

from __future__ import annotations

import re

from lumenframe.functions import markdown as md
from lumenframe.plans import extracts
from lumenframe.plans.views import table

DATA = "/root/testdata/sf0.001"

PAGE = """<html><body><nav>menu</nav><main><h1>Big <em>news</em></h1><p>One <b>bold</b> and <a href="/x">link</a><p>Second<br>line
<ul><li>a<li>b<ol><li>c</ol></ul><div>loose <span>inline</span> text<blockquote><p>said</p><p>more</p></blockquote></div>
<pre><code class="language-py">x = "`"\n  y</code></pre><hr><table><tr><th>k<th>v|w<tr><td>1<td></table><script>no()</script><p hidden>gone</p><img src="i.png" alt="pic"></main></body></html>"""


def test_blocks_of_a_page():
    assert md.to_markdown(PAGE, "http://h.com/a/") == (
        '# Big *news*\n\nOne **bold** and [link](http://h.com/x)\n\nSecond\nline\n\n- a\n- b\n  1. c\n\nloose inline text\n\n> said\n>\n> more\n\n```py\nx = "`"\n  y\n```\n\n---\n\n'
        "| k | v\\|w |\n| --- | --- |\n| 1 |  |\n\n![pic](http://h.com/a/i.png)"
    )
    assert md.to_text(md.to_markdown(PAGE)) == 'Big news\n\nOne bold and link\n\nSecond\nline\n\na\nb\n c\n\nloose inline text\n\nsaid\n\nmore\n\nx = "`"\n y\n\nk v|w\n\n1\n\npic'
    assert md.to_markdown("") == md.to_text("") == "" and md.to_markdown("<p>a</b></div><li>b") == "a\n\nb"


def _words(text):
    return re.findall(r"[^\W_]+", text)


def test_every_page_keeps_its_words_both_ways(spark):
    html = {r.page_id: r.html for r in table(spark, DATA, "pages").collect()}
    seen = 0
    for r in extracts.to_markdown(spark, DATA).collect():
        visible = md.main_part(md.tree(html[r.page_id] or "")).text(" ")
        assert sorted(_words(r.text)) == sorted(_words(visible)), r.page_id
        seen += 1
    assert seen == len(html)


def test_sections_titles_and_lines():
    text = "---\nTitle: 'My doc'\nbad line\n---\nintro\n\n# A #\n\ntext a\n```\n# not a heading\n```\n### C\ndeep\n## B\n\n\nb one\n\nb two\n"
    got = md.chunks(text)
    assert [(c["section"], c["line"], c["text"]) for c in got] == [
        ("My doc", 5, "intro"), ("A", 9, "text a\n```\n# not a heading\n```"), ("A § C", 14, "deep"), ("A § B", 18, "b one\n\nb two"),
    ]
    assert md.frontmatter("no front")[0] == {} and md.title("x\n## no\n# Yes ##\n") == "Yes" and md.title("~~~\n# no\n~~~", "d") == "d"
    assert md.chunks("") == [] == md.chunks("---\na: b\n---\n") and md.chunks("# only\n") == []


def test_chunks_lose_nothing_and_fit(spark):
    docs = {r.page_id: r.markdown for r in extracts._markdown(spark, DATA).collect()}
    got: dict = {}
    for r in extracts.chunk_markdown(spark, DATA).orderBy("page_id", "ordinal").collect():
        assert len(r.text) <= 1200 and r.text.split("\n")[0].strip() in docs[r.page_id].split("\n")[r.line - 1]
        got.setdefault(r.page_id, []).append(r.text)
    for page, text in docs.items():
        body = text[md.frontmatter(text)[1] :]
        kept = "\n".join(line for line, kind in md.fenced(body.split("\n")) if kind != "text" or not md._heading(line))
        assert "".join("".join(got.get(page, [])).split()) == "".join(kept.split())
