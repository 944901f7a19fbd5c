"""Main text: hand-made pages with their articles, and the given pages against a plain reading of their article element."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from evalloom.llm.main_text import extracted, main_text
from evalloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "A first sentence, of some length, stands here. A second, not much shorter, follows it."
MORE = "Further text, with commas, goes on, for a while, so that it weighs something."

PAGES = {
    "plain text": ("Just text &amp; more", "Just text & more"),
    "nothing": ("", ""),
    "markup alone": ("<html><head><title>t</title></head><body><script>x</script></body></html>", ""),
    "a menu alone": ("<ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul>", ""),
    "references": ("<p>a&nbsp;&lt;b&gt; &#8212;&#x41; &copy 3 &lt 4</p>", "a <b> —A © 3 < 4"),
    "white space": ("<p>\n one <b>two</b>\n\tthree<br>four<br/> five </p>\n<pre>a\n  b</pre>", "one two three four five\n\na b"),
    "inline elements join": ("<p>un<b>believ</b>able <a href=x>link</a>ed</p><p>x</p>", "unbelievable linked\n\nx"),
    "unclosed": ("<p>one<p>two <b>bold<p>three<ul><li>x<li>y</ul><table><tr><td>z<td>w", "one\n\ntwo bold\n\nthree\n\nx\n\ny\n\nz\n\nw"),
    "values with signs": ("""<p title="a > b" data-x='c>d'>text <a href="x>y">link</a> 3 < 4</p><p>it's a=b</p><!-- c > d --><p class=it's>x</p>""", "text link 3 < 4\n\nit's a=b\n\nx"),
    "an article": (
        f"<body><header><p>Site</p></header><nav>n</nav><main><article><header><h1>T</h1><p>By X</p></header><p>{LONG}</p><section><h2>S</h2><p>short</p></section><aside>pull</aside><footer>tags</footer></article>"
        f"<section class=comments><article class=comment><p>{LONG * 3}</p></article></section></main><footer>f</footer></body>",
        f"T\n\n{LONG}\n\nS\n\nshort",
    ),
    "a title before the article": (f"<main><h1>T</h1><article><p>{LONG * 2}</p></article></main>", f"T\n\n{LONG * 2}"),
    "divisions": (
        f"<div id=header><h1>Site</h1></div><div class=container><div class='col content'><h2>T</h2><div>{LONG}</div><div>short.</div><ul><li>one</li><li>two</li></ul><div class='share-buttons'><a>send</a></div></div>"
        f"<div class=sidebar><p>{LONG * 4}</p></div></div><div id=comments><p>{LONG * 4}</p><p>{LONG * 4}</p></div><div id=footer>&copy; us</div>",
        f"T\n\n{LONG}\n\nshort.\n\none\n\ntwo",
    ),
    "a short article, long comments": (f"<div class=post><h1>T</h1><p>A short story.</p></div><div class=comments-area><ol class=commentlist><li><p>{LONG * 5}</p></li></ol></div>", "T\n\nA short story."),
    "notices and adverts": (
        f"<body><div class='cookie-notice'>We use them, really, many, of, them.</div><div role=alert>Alert</div><h1>T</h1><p>{LONG}</p><p>two</p><div class=advert>Buy, buy, buy</div><div style='display: none'>hidden</div><p>three</p><noscript>enable</noscript><form><label>Mail</label><input></form>",
        f"T\n\n{LONG}\n\ntwo\n\nthree",
    ),
    "sections": (f"<div class=wrap><section><h2>A</h2><p>{LONG}</p><p>{MORE}</p></section><section><h2>B</h2><p>Short.</p></section></div>", f"A\n\n{LONG}\n\n{MORE}\n\nB\n\nShort."),
    "a layout table": (f"<table><tr><td><a href=1>m1</a><br><a href=2>m2</a></td><td><p>{LONG}</p><p>end</p></td></tr></table>", f"{LONG}\n\nend"),
    "a form around all": (f"<form id=f><div><p>{LONG}</p><p>{MORE}</p><input type=text><select><option>x</select></div></form>", f"{LONG}\n\n{MORE}"),
    "a form around the article": (f"<form id=f><article><p>{LONG}</p></article><p>label</p></form>", LONG),
    "names that say not": (f"<body class='has-sidebar no-ads'><div class='content-with-sidebar'><p>{LONG}</p></div></body>", LONG),
    "a menu in the article": (f"<article><p>{LONG}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><p>see <a href=3>three</a></p></article>", f"{LONG}\n\nsee three"),
    "a script that looks like text": (f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><p>{LONG}</p></article>", LONG),
    "all of one name": (f"<div class=widget><p>{LONG}</p></div>", LONG),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def article(page):
    """The blocks of the one article element, whose markup is headings, paragraphs, lists and inline elements."""
    parts = re.split("</?(?:p|h1|h2|li|ul|ol|div|blockquote)\\b[^>]*>", re.search("<article>(.*?)</article>", page, re.S)[1])
    plain = [re.sub("<!--.*?-->|</?[bia]\\b[^>]*>", "", p.replace("<br>", " ")) for p in parts]
    return "\n\n".join(x for x in (re.sub("\\s+", " ", html.unescape(p)).strip() for p in plain) if x)


def test_given_pages(spark):
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, SF).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_rows(spark):
    """Null and repeated rows, nulls in other columns, columns called text, an empty table."""
    df = spark.createDataFrame([(1, None, None, "old", [1]), (1, None, None, "old", [1]), (None, "u", "<p>x</p>", None, None), (2, "u", "", "t", [])], "page_id long, url string, html string, text string, tags array<int>")
    out = extracted(df)
    assert out.columns == ["page_id", "url", "tags", "text"] and out.schema["tags"].dataType == df.schema["tags"].dataType
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None, [1], ""), (1, None, [1], ""), (2, "u", [], ""), (None, "u", None, "x")]
    assert extracted(df.limit(0)).count() == 0 and extracted(df.select(F.col("html"))).count() == 4


def test_long_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<div>" * 200_000 + "x") == "x" and main_text("<p>x, y</p>" * 50_000).count("x, y") == 50_000
    for part in ("<b><p>", "<a x='", "<", "<!--", "<script>", "<li></b></i>", "<div></p><li>", "&amp;&lt", "<a href=x>y"):
        main_text(part * 40_000)
    assert time.perf_counter() - began < 60
