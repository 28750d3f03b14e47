import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from scanframe.llm import extraction
from scanframe.llm.common import table

SF = "/root/testdata/sf0.01"
LONG = "a paragraph of main text with words enough to be dense"


def _article(html: str) -> str:
    """The text of the one article element, by regular expressions."""
    inner = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"<(/?\w+)[^>]*>", lambda m: "" if m[1] in ("b", "/b") else " ", inner)).split())


def test_pages_of_the_table(spark):
    found = {r.page_id: r for r in extraction.op11_html_extraction(spark, SF).collect()}
    rows = table(spark, SF, "pages").collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.page_id].text == _article(r.html)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
        assert found[r.page_id].url == r.url


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        (None, ""),
        ("just text", "just text"),
        ("<title>t</title><p>Hello  there", "Hello there"),
        ("<body><p title=\"a>b\">x<b>y</b> z &lt;b&gt; 1 < 2&nbsp;&nbsp;3</p></body>", "xy z <b> 1 < 2 3"),
        ("<body><p>a<!-- <p>no</p> -->b</p><!-- open <p>zz</p>", "ab"),
        ("<body><script>if (a<b) '</p>'</script><style>p{}</style><p>kept &amp</p><script>x", "kept &"),
        ("<body><div>one<br>two<br/>three</div><div class='ad'>buy</div></body>", "one two three"),
        ("<body><ul class=menu><li>a<li>b</ul></body>", ""),
        (f"<body class='has-sidebar'><div id=header><h1>Site</h1></div><div id=wrap><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p><p>No.</p></div></div>"
         f"<div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG * 9}</p></div><div class=footer>&copy;</div>", f"Title {LONG} {LONG} No."),
        (f"<header>Site</header><main><article><header><h1>T</h1></header><section><h2>A</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>tiny</p></section>"
         f"<aside>{LONG}</aside><form>{LONG}</form><footer>f</footer></article></main>", f"T A {LONG} {LONG} B tiny"),
        (f"<div class='cookie-notice'>{LONG}</div><div class=post><p>{LONG}</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><ul><li>point <a>x</a></ul></div>", f"{LONG} point x"),
        (f"<div role=navigation>{LONG}</div><table><tr><td class=content><p>{LONG}<p>{LONG}</table>", f"{LONG} {LONG}"),
        (f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><div><p>{LONG}</div>", LONG),
        (f"<article><p>{LONG}</p></article><div class=x>{LONG}</div>", LONG),
    ],
)
def test_one_page(html, text):
    assert extraction.main_text(html) == text


def test_densities_are_those_of_their_definition():
    from math import e, log

    page = extraction.Page("<body><p>abcdefgh</p><p>ab<a>cd</a></p></body>")
    found = extraction.densities(page)
    at = {t: k for k, t in reversed(list(enumerate(page.tags)))}
    body, a = at["body"], at["a"]
    first, second = [k for k, t in enumerate(page.tags) if t == "p"]
    assert [found.chars[k] for k in (body, first, second, a)] == [12, 8, 4, 2]
    assert [found.linked[k] for k in (body, first, second, a)] == [2, 0, 2, 2]
    share = 2 / 12
    # the base of the logarithm is itself a logarithm
    base = lambda c, lc: log(c / max(1, c - lc) * max(1, lc) + share * c + e)
    want = lambda c, t, lc, lt: c / t * log(c / max(1, lc) * t / max(1, lt), base(c, lc))
    assert found.own[first] == pytest.approx(want(8, 1, 0, 0))
    assert found.own[second] == pytest.approx(want(4, 1, 2, 1))
    assert found.sums[body] == pytest.approx(found.own[first] + found.own[second])


@pytest.mark.parametrize("piece", ["<a", '<a "', "<", "<!--", "<script>", "<div>", "<p><b>", "<li>", "<td>", "</p>", "<u><div><i></u>", "&", "<a '\">"])
def test_time_grows_with_the_page(piece):
    extraction.main_text("<p>x</p>" + piece * 20_000)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>x", 2), (1, "u", "<p>x", 3), (1, "u", "<p>x", 3), (2, "u", f"<p>{'word ' * 400_000}</p>", 4)]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.n_chars) for r in found.collect()) == [(0, 1), (1, 0), (1, 1), (1, 1), (2, 1_999_999)]
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert found.filter(F.col("text").isNull()).count() == 0
