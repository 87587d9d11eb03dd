"""Character references, URL references, attributes, redirects and the link frontier, each
against an independent model or hand-written answers."""

import html as stdlib
import random
import time
from html.entities import html5
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from clientele.functions import charrefs, html as H, references
from clientele.operators import context, frontier as FR, redirects as RD
from clientele.plans import jobs as J


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_every_name_and_number_decodes_as_the_standard_says(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5]
    texts += [f"x&#{n};y&#x{n:x};z" for n in [*range(0, 1200), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10 ** 12]]
    texts += ["&", "&;", "&#;", "&#x;", "&#xg", "&#99999999999999999999999;", "&#x00000000000000000041;", "&#65", "&#x41 &#65x", "&amp;lt;", "&&amp;", "&bogus;", "&notit;", "&notin;", None, ""]
    r = random.Random(1)
    texts += ["".join(r.choice(["&", "#", "x", "6", "5", "amp", "lt", ";", " ", "eacute", "copy", "not"]) for _ in range(12)) for _ in range(800)]
    got = column(spark, texts, charrefs.decode)
    assert [(t, g) for t, g in zip(texts, got) if g != (stdlib.unescape(t) if t is not None else None)] == []


def test_names_inside_attributes(spark):
    texts = ["?a=1&copy=2", "?a&copy", "?a&copy;b", "?a&copyb", "&#47;x&amp;y"]
    assert column(spark, texts, lambda c: charrefs.decode(c, in_attribute=True)) == ["?a=1&copy=2", "?a©", "?a©b", "?a&copyb", "/x&y"]


# the examples of RFC 3986, sections 5.4.1 and 5.4.2, without fragments
RFC = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
       "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
       "g;x?y#s": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
       "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
       "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
       "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
       "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g", "/a//..": "http://a/a/", "/x//./y": "http://a/x//y"}


def test_reference_resolution(spark):
    base = F.lit("http://a/b/c/d;p?q")
    assert dict(zip(RFC, column(spark, list(RFC), lambda c: references.resolve(base, c)))) == RFC
    r = random.Random(4)
    refs = ["".join(r.choice(["a", "b.html", "/", "/", "..", ".", "?x=1", "é"]) for _ in range(r.randrange(7))) for _ in range(500)]
    refs = [x for x in refs if "//" not in x and x.count("?") < 2]  # the standard library drops empty segments' dots otherwise
    for root in ("https://h.si", "https://h.si/", "https://h.si/p/q/r.html?z", "http://h:8/p/"):
        got = column(spark, refs, lambda c: references.resolve(F.lit(root), c))
        want = [urldefrag(urljoin(root, x)).url for x in refs]
        assert [(root, x, g, w) for x, g, w in zip(refs, got, want) if g.rstrip("/") != w.rstrip("/")] == []
    assert column(spark, [" /x\n/y ", None, "MAILTO:a@b"], lambda c: references.resolve(F.lit("HTTP://h/"), c)) == ["http://h/x/y", None, "mailto:a@b"]
    assert column(spark, ["x"], lambda c: references.resolve(F.lit("no scheme"), c)) == [None]


def test_attributes_of_any_form(spark):
    page = ("<a class=x href=\"/1\"><A HREF='/2' ><a href=/3/?a=b><a\ntitle='a>b'\nhref = \"/4&amp;5\"><a data-href='/no'><a><a href><!-- <a href='/no'> -->"
            "<script>'<a href=\"/no\">'</script><abbr href='/no'><a hrefx='/no' href='/6'><a x=\"href='/no'\" href='/7'><a href=''>")
    assert column(spark, [page], H.hrefs) == [["/1", "/2", "/3/?a=b", "/4&5", "/6", "/7", ""]]
    assert column(spark, ["<base target=x><base href='/b'><base href='/c'>", "<p>"], H.base_href) == ["/b", None]
    assert column(spark, ["<img alt='Caf&eacute;' src=x><IMG SRC=y ALT=\" B \"><img src=z>"], H.image_alts) == [["Café", " B "]]
    long = "<a " + "x" * 50_000 + " y=1" * 20_000 + " href='/end'>"
    assert column(spark, [long], H.hrefs) == [["/end"]]


def test_fold_is_linear(spark):
    def seconds(n):
        page = "<nav><nav>m</nav></nav>" + "<p>caf&eacute; <b>x</b></p>" * n
        df = spark.createDataFrame([(page,)], "html string").select(F.length(H.page_text(F.col("html"))).alias("n"))
        best = float("inf")
        for _ in range(3):
            start = time.time()
            assert df.first().n == 7 * n - 1
            best = min(best, time.time() - start)
        return best
    seconds(1000)
    few, many = seconds(8_000), seconds(32_000)
    assert many < 8 * few, (few, many)  # four times the nodes; a square would be sixteen


def test_regular_pages(spark):
    pages = ["<head><style>a</style></head><nav><svg></svg></nav><nav>x</nav>y", "<nav><nav></nav></nav>", "<nav><footer></nav></footer>", "<header>x</header>", "<nav>",
             "<nav></nav>" * 5000, "</nav>"]
    assert column(spark, pages, H.irregular) == [False, True, True, False, True, False, True]


def chains(spark, rows):
    df = spark.createDataFrame(rows, "from_url string, to_url string")
    return {r.url: (r.final_url, r.hops, r.outcome) for r in RD.redirect_ends(df).collect()}


def test_redirect_chains(spark):
    rows = [(f"c{i}", f"c{i + 1}") for i in range(100)] + [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("into", "l2"), ("self", "self"),
            ("two", "z"), ("two", "y"), ("", "x"), (None, "x"), ("gone", None), ("e", "")] + [(f"hot{i}", "hub") for i in range(300)] + [("hub", "end")]
    got = chains(spark, rows)
    for i in range(100):
        hops = 100 - i
        assert got[f"c{i}"] == (("c100", hops, "ok") if hops <= 30 else (None, hops, "redirects"))
    for u in ("l1", "l2", "l3", "into", "self"):
        assert got[u] == (None, None, "loop")
    assert got["two"] == ("y", 1, "ok") and got["hub"] == ("end", 1, "ok") and {got[f"hot{i}"] for i in range(300)} == {("end", 2, "ok")}
    assert len(got) == 100 + 5 + 2 + 300
    assert chains(spark, [("a", "a")]) == {"a": (None, None, "loop")}
    assert RD.redirect_ends(spark.createDataFrame([], "from_url string, to_url string")).count() == 0


def test_fetch_follows_redirects(spark):
    cands = spark.createDataFrame([("k", "https://a/1", "t", 1), ("k", "https://a/2", None, 2), ("k", "https://a/l", "t", 3), ("k", "mailto:x", "t", 4),
                                   ("k", "https://a/x", "t", 5), ("k", "https://a/e", "t", 6), ("k", "https://a/end", "t", 7)], "netloc string, url string, type string, seq long")
    pages = spark.createDataFrame([("https://a/end", "<p>one</p>", 200), ("https://a/end", "<p>two</p>", 200), ("https://a/err", "x", 503), (None, "x", 200)],
                                  "url string, html string, http_status int")
    moved = spark.createDataFrame([("https://a/1", "https://a/2"), ("https://a/2", "https://a/end"), ("https://a/l", "https://a/l"), ("https://a/e", "https://a/err")],
                                  "from_url string, to_url string")
    got = {r.seq: (r.status, r.final_url, r.text, r.n_chars, r.http_code) for r in context.fetch(cands, pages, redirects=moved).collect()}
    assert got == {1: ("ok", "https://a/end", "one", 3, None), 2: ("ok", "https://a/end", "one", 3, None), 3: ("failed(loop)", None, None, None, None),
                   4: ("skipped", None, None, None, None), 5: ("failed", None, None, None, None), 6: ("http", None, None, None, 503), 7: ("ok", "https://a/end", "one", 3, None)}


SITE = [("https://www.x.si/", "<a href='reference/'>r</a><a href='/about'>a</a><a href='//y.si/clients/'>y</a>"),
        ("https://www.x.si/reference/", "<a href='1.html#top'>1</a><a href='..'>home</a><a href='http://x.si/blog/'>b</a>"),
        ("https://www.x.si/reference/1.html", "<base href='/partners/'><a href='p'>p</a><a href=''>base</a>"),
        ("http://x.si/blog/", "<a href='https://www.x.si/reference/'>back</a>"), ("https://www.x.si/about", "<a href='/clients/secret'>s</a>")]


def test_frontier_walks_the_site(spark):
    pages = spark.createDataFrame(SITE, "url string, html string")
    seeds = spark.createDataFrame([("x.si", "https://www.x.si/"), ("x.si", "https://www.x.si/"), ("x.si", ""), ("x.si", None), ("z.si", "https://z.si/")], "company_key string, url string")
    got = {(r.company_key, r.url): (r.hop, r.via_url) for r in FR.frontier(seeds, FR.site_links(pages)).collect()}
    assert got == {("x.si", "https://www.x.si/"): (0, None), ("z.si", "https://z.si/"): (0, None), ("x.si", "https://www.x.si/reference/"): (1, "https://www.x.si/"),
                   ("x.si", "https://www.x.si/reference/1.html"): (2, "https://www.x.si/reference/"), ("x.si", "http://x.si/blog/"): (2, "https://www.x.si/reference/"),
                   ("x.si", "https://www.x.si/partners/p"): (3, "https://www.x.si/reference/1.html"), ("x.si", "https://www.x.si/partners/"): (3, "https://www.x.si/reference/1.html")}
    assert {r.hop for r in FR.frontier(seeds, FR.site_links(pages), max_rounds=1).collect()} == {0, 1}
    assert FR.frontier(seeds.limit(0), FR.site_links(pages.limit(0))).count() == 0


def test_found_pages_reach_the_documents(spark):
    pages = spark.createDataFrame([(u, h + f"<ul><li>Client {i} Ltd</li></ul>") for i, (u, h) in enumerate(SITE)], "url string, html string")
    inputs = spark.createDataFrame([("https://www.x.si",)], "input_url string")
    cands = spark.createDataFrame([("x.si", "https://www.x.si/", "homepage", "", 1)], "company_key string, url string, type string, description string, seq long")
    more = J.with_linked_pages(cands, FR.site_links(pages)).orderBy("seq").collect()
    assert [(r.seq, r.url) for r in more[:2]] == [(1, "https://www.x.si/"), (2, "https://www.x.si/reference/")] and [r.seq for r in more] == list(range(1, len(more) + 1))
    docs = J.build_repository(inputs, J.with_linked_pages(cands, FR.site_links(pages)), pages, None, "2024-01-01").collect()
    assert [c.name for c in docs[0].document.clients] == ["Client 0 Ltd", "Client 1 Ltd", "Client 3 Ltd", "Client 2 Ltd"]
    assert docs[0].document.sources_checked == [u for u, _ in (SITE[0], SITE[1], SITE[3], SITE[2])]


@pytest.mark.parametrize("part_rows", [1000, 2])
def test_two_hosts_of_one_key(spark, part_rows):
    replies = spark.createDataFrame([("x.si", h, 0, '{"pages":[{"url":"https://%s/a"},{"url":"https://%s/b"}]}' % (h, h)) for h in ("www.x.si", "x.si")],
                                    "company_key string, reply_id string, chunk long, reply string")
    said, cands = J.discovery_results(replies)
    assert sorted(r.seq for r in cands.collect()) == [1, 2, 3, 4]
    pages = spark.createDataFrame([(f"https://{h}/{p}", f"<p>text {h} {p}</p><ul><li>Firm {h} {p}</li></ul>") for h in ("www.x.si", "x.si") for p in "ab"], "url string, html string")
    inputs = spark.createDataFrame([("https://x.si",)], "input_url string")
    comps = J.company_inputs(inputs)
    fetched = J.fetched_pages(comps, cands, pages)
    ok, blocks = J.page_parts(fetched)
    text = "".join(r.context for r in context.context_text(ok, blocks).orderBy("part").collect())
    order = [("www.x.si", "a"), ("www.x.si", "b"), ("x.si", "a"), ("x.si", "b")]
    rule = "=" * 60
    assert text == "".join(f"\n\n{rule}\nPAGE {n} | https://{h}/{p} | type: unknown\n{rule}\ntext {h} {p}\nFirm {h} {p}" for n, (h, p) in enumerate(order, 1))
    docs = J.build_repository(inputs, cands, pages, None, "2024-01-01", said=said, part_rows=part_rows).orderBy("part").collect()
    assert [c.name for d in docs for c in d.document.clients] == [f"Firm {h} {p}" for h, p in order]
    assert [u for d in docs for u in d.document.sources_checked] == [f"https://{h}/{p}" for h, p in order]
    assert [(d.part, d.n_parts) for d in docs] == ([(0, 1)] if part_rows == 1000 else [(0, 2), (1, 2)])


def test_parts_that_are_gone_are_deleted(spark):
    repo = spark.createDataFrame([("u", "k", p, f"old{p}") for p in range(3)] + [("u", "other", 0, "x"), ("u", "other", 1, "y")], "email string, company_key string, part long, data string")
    repo = repo.withColumns({"updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "seq": F.lit(1).cast("long")})
    res = spark.createDataFrame([("u", "k", 0, 2), ("u", "k", 1, 2)], "email string, company_key string, part long, n_parts long").withColumn(
        "document", F.struct(F.col("part"), F.lit(None).cast("string").alias("error")))
    got = sorted((r.company_key, r.part, r.data) for r in J.apply_results(repo, res, "2024-02-01 00:00:00").collect())
    assert got == [("k", 0, '{"part":0}'), ("k", 1, '{"part":1}'), ("other", 0, "x"), ("other", 1, "y")]
