import html
import re
import time

import pytest

from fareline.llm import html_extract


def brute(source):
    """The article of a page as the given tables have them."""
    found = re.search(r"<article>(.*?)</article>", source, re.S)
    out = []
    for block in re.split(r"</?(?:p|h1)>", found.group(1) if found else ""):
        text = html.unescape(re.sub(r"<[^>]+>", "", block.replace("<br>", " ")))
        if text.strip():
            out.append(" ".join(text.split()))
    return "\n\n".join(out)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {r.page_id: brute(r.html) for r in pages.collect()}
    for row in html_extract.extract(pages).collect():
        assert row.text == expected[row.page_id]
        assert row.n_chars == len(row.text)


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        (None, ""),
        ("<p>a &lt;b&gt; &amp;amp; c&nbsp;d", "a <b> &amp; c d"),
        ("<p>x</p>y<b>z</b>", "x\n\nyz"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>x <!-- c --> y<script>if(a<b){}</script>z</p>", "x yz"),
        ("<main><header><h1>Hi</h1></header><p>text here</p><form><p>m</p></form></main>", "Hi\n\ntext here"),
        ("<div class=post><p>aa bb cc dd</p><section class='reader-comments'><p>c</p></section></div>", "aa bb cc dd"),
        ("<div class='sidebar'>s s s s s</div><div id=x><p>one two</p></div><footer>f</footer>", "one two"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul><div class='cookie-notice'>n</div></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p style='display: none'>h</p><p hidden>i</p><p>t</p></article>", "t"),
        ("<nav>only</nav>", ""),
        ("<p title=don't>hello</p>", "hello"),
        ("<p title=\"a > b\" data-x='c > d'>e</p>", "e"),
        ("<article><section class='related-work'><p>a b</p></section><p class=header>c</p></article>", "a b\n\nc"),
        ("<article><p>t</p><div class='related-posts'><p>r</p></div><p class=ads>x</p></article>", "t"),
        ("<article><p>a <math><mi>x</mi>=<mn>2</mn></math> b</p></article>", "a x=2 b"),
        ("<article><p>a<svg><path d='M0'><text>no</text><p>b</p></article>", "a\n\nb"),
        ("<article><p>a<svg><title>no</title></svg>c</p><noscript>n</noscript></article>", "ac"),
        ("<p>a<button>no</button><span class='ad'>no</span>c <span class=notice>d</span></p>", "ac d"),
        ("<table><tr><td>a<td>b<table><tr><td>c</table><td>d</table>", "a\n\nb\n\nc\n\nd"),
    ],
)
def test_single_pages(source, text):
    assert html_extract.extracted(html_extract.read_page(source or ""), None) == text


def test_host_votes(spark):
    """A page whose sidebar is longer than its article follows the other pages of its host."""
    usual = "<body><div class='c1 main-text'><p>%s</p></div><div class='extra'><p>few</p></div></body>"
    rows = [(k, f"http://h.org/{k}", usual % ("many words here " * 9), "x") for k in range(5)]
    odd = "<body><div class='c2 main-text'><p>short one</p></div><div class='extra'><p>%s</p></div></body>"
    rows += [(9, "http://H.org/9", odd % ("noise " * 50), "x"), (10, None, None, "x"), (11, "", "<p>t", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert found[9] == "short one" and found[10] == "" and found[11] == "t"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_very_long_page():
    source = "<article>" + "<p>word &amp; word</p>" * 50_000 + "<div>" * 3000 + "deep" + "</article>"
    text = html_extract.extracted(html_extract.read_page(source), None)
    assert text.count("\n\n") == 50_000 and text.endswith("deep")


def test_deep_and_unmatched_tags_in_little_time():
    started = time.perf_counter()
    deep = "<div class='a b'>" * 200_000 + "<p>deep text</p>"
    page = html_extract.read_page(deep)
    path, _ = html_extract.best_path(page)
    assert path.count("/") == 199_999
    assert html_extract.extracted(page, path) == "deep text"
    unmatched = "<b>" * 50_000 + "</i></span></section>" * 60_000 + "<li>" * 50_000 + "end"
    assert html_extract.extracted(html_extract.read_page(unmatched), None) == "end"
    quotes = "<a href=\"x" * 50_000 + "<p>" + "<a b='" * 50_000
    html_extract.read_page(quotes)
    assert time.perf_counter() - started < 30
