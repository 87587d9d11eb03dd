"""P9 (native) against an independent parser model, on every page and on hand-made
edge cases."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from clientele.functions import html as H
from clientele.sources.tables import table

_DROP = set(H.DROPPED)
_BLANKS = re.compile(r"\n{3,}")


class _TextParser(HTMLParser):
    """Text nodes outside dropped elements; entities decoded by the parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in _DROP and self.depth > 0:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth == 0:
            s = data.strip()
            if s:
                self.parts.append(s)


def html_to_text(html: str | None, max_chars: int | None = None) -> str | None:
    if html is None:
        return None
    p = _TextParser()
    p.feed(html)
    p.close()
    return _BLANKS.sub("\n\n", "\n".join(p.parts))[:max_chars]


CASES = [
    "<html><head><title>T</title><style>p{}</style></head><body><p>Hello <b>world</b></p></body></html>",
    "<!DOCTYPE html><body><!-- c --><script>var x='</p>';</script><p>a &amp; b &lt;c&gt;</p></body>",
    "<nav><ul><li>Home</li></ul></nav><p>Only\n\n\n\nthis</p><footer>&copy; x</footer>",
    "<div>one<div>two</div>  <span>   </span>three</div>",
    "<p>unclosed <b>bold<p>next",
    "<pre>a\n\n\n\n\nb</pre>",
]


def native(spark, htmls):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i int, html string")
    return [r.t for r in df.orderBy("i").select(H.page_text(F.col("html")).alias("t")).collect()]


def test_edge_cases_match_parser_model(spark):
    assert native(spark, CASES) == [html_to_text(h) for h in CASES]


def test_all_pages_match_parser_model(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    rows = pages.select("page_id", "html", H.page_text(F.col("html")).alias("t"),
                        H.irregular(F.col("html")).alias("flag")).collect()
    assert rows
    for r in rows:
        if not r.flag:
            assert r.t == html_to_text(r.html), r.page_id


IRREGULAR = {
    "<nav>a<nav>b</nav>c</nav>d": "d",
    '<p title="a>b">hi': "hi",
    "<html><head><title>T</title><meta charset=x><body><p>x</p></body></html>": "x",
    "<div><nav>menu <b>x</div><p>after</p>": "after",
    "<p>one<nav>menu": "one",
    "<!-- <nav> <script> --><p>x</p>": "x",
    "a<footer>f</footer>b<footer>g</footer>c": "a\nb\nc",
    "<svg><g><svg/></g></svg>t<script>if (a<b) { x('<nav>') }</script>u": "t\nu",
    "1 < 2 <nav>x<nav>": "1 < 2",
}


def test_irregular_pages(spark):
    assert native(spark, list(IRREGULAR)) == list(IRREGULAR.values())


def test_fold_equals_markers_on_every_page(spark, sf):
    pages = table(spark, sf, "pages").where(~H.irregular(F.col("html")))
    both = pages.select(H.text_nodes(F.col("html")).alias("a"), H.folded_text_nodes(F.col("html")).alias("b"))
    assert both.count() > 0 and both.where("a <> b").count() == 0


def test_text_cap(spark):
    long = "<p>" + "x" * 9000 + "</p>"
    assert native(spark, [long])[0] == "x" * 9000          # whole by default
    df = spark.createDataFrame([(long,)], "html string")
    assert df.select(H.page_text(F.col("html"), 8000).alias("t")).first().t == "x" * 8000
