"""Operator 12: rules and parts against plain Python, segmentation against all splits,
scores against the model's definition."""

import math
import re
from collections import Counter
from itertools import product

import pytest

from clientele.llm import url_filter as U

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, rule int, words string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host):]).group()


def rule_of(host, path, rules):
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def letters(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def model_of(htmls, labelled):
    allow, block = Counter(), Counter()
    for h in htmls:
        allow.update(w for w in letters(re.sub("<[^<>]*>", " ", h or "")) if len(w) <= U.WORD)
    for verdict, name in labelled:
        (block if verdict == "block" else allow).update(letters(name))
    return allow, block


def weight(word, allow, block):
    v = len(set(allow) | set(block))
    p = (allow[word] + U.ALPHA) / (sum(allow.values()) + U.ALPHA * (v + 1))
    return math.log((block[word] + U.SMOOTHING * p) / ((sum(block.values()) + U.SMOOTHING) * p))


def splits(run):
    for cuts in product((False, True), repeat=len(run) - 1):
        out, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                out.append(run[start:i])
                start = i
        yield [*out, run[start:]]


URLS = ["http://A.Example.NET/en/x?y", "https://example.net", "https://example.net?x=/en/", "https://x.net/", "https://net/", "https://xnet/", "https://a.example.com/de/",
        "https://badexample.com/de/", "https://example.com/de", "http://www.org/fr/1#z", "http://org/fr/", "http://org./fr/", "no url", "", None, "://", "http://",
        "a://b.net://c/d", "http://freebets.example.com/a", "http://x.org/Cheap%50Pills/%C3%A9", "http://x.org/cheappillsonline", "http://x.org/" + "q" * 70, "http://é.org/ß/"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_parts_and_rules(spark):
    rules = [*U.RULES, ("allow", "a.b.org", "/x"), ("block", "b.org", "/x/yy"), ("allow", "b.org", "")]
    urls = [*URLS, "http://q.a.b.org/x/yy/1", "http://a.b.org/x/y", "http://b.org"]
    df = U.best_rules(U.split_url(frame(spark, [(i, u, None) for i, u in enumerate(urls)])), rules)
    got = {r.page_id: (r.host, r.path, r.best.says if r.best else None, r.best.rule if r.best else None) for r in df.collect()}
    assert got == {i: (*parts(u), *rule_of(*parts(u), rules)) for i, u in enumerate(urls)}
    assert got[0] == ("a.example.net", "/en/x", "allow", "example.net/en/") and got[1][2] is None and got[3][2:] == ("block", "net/")


def test_best_split_is_the_most_probable():
    counts = {"free": 50, "bets": 3, "be": 90, "ts": 1, "f": 5, "casino": 2, "win": 9, "wind": 4, "in": 80}
    ln_total = math.log(1000)
    known = {w: math.log(n) - ln_total for w, n in counts.items()}

    def value(words):
        return sum(known.get(w, -ln_total - len(w) * math.log(26)) for w in words)
    for run in ("freebets", "casinowin", "windin", "zq", "betsfree", "a"):
        assert value(U.best_split(run, known, ln_total)) == pytest.approx(max(map(value, splits(run))))
    assert U.best_split("freebets", known, ln_total) == ["free", "bets"] and U.best_split("x" * 64, known, ln_total) == ["x" * 64]


def test_verdicts_and_scores(spark):
    text = "<p>The city library and news of the day, open to read. A farm.</p>" * 300 + "<script>var x=1</script>"
    rows = [(i, u, text) for i, u in enumerate(URLS)] + [(None, "http://spam.example.com/links", None), (1, URLS[18], ""), (1, URLS[18], "")]
    df = frame(spark, rows)
    labelled = spark.createDataFrame(U.LABELLED, "verdict string, name string")
    words = U.dictionary(df.selectExpr("regexp_replace(html, '<[^<>]*>', ' ') AS text"), labelled).cache()
    got = U.judge(df.select("page_id", "url"), U.RULES, words).collect()
    assert len(got) == len(rows)
    allow, block = model_of([h for _, _, h in rows], U.LABELLED)
    ln_total = math.log(sum(allow.values()) + sum(block.values()))
    known = {w: math.log(allow[w] + block[w]) - ln_total for w in set(allow) | set(block)}
    for r in got:
        host, path = parts(r.url)
        verdict, rule = rule_of(host, path, U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict and r.score is None
            continue
        tokens = [w for part in (host, path) for run in letters(re.sub("%[0-9A-Fa-f]{2}", " ", part)) for w in U.best_split(run, known, ln_total)]
        assert r.score == pytest.approx(sum(weight(w, allow, block) for w in tokens) + math.log(U.PRIOR / (1 - U.PRIOR)), abs=1e-4)
        assert r.verdict == ("block" if r.score > 0 else "allow")
    said = {r.url: r.verdict for r in got}
    assert said["http://freebets.example.com/a"] == said["http://x.org/cheappillsonline"] == "block"
    assert said[None] == said["no url"] == said["http://x.org/" + "q" * 70] == "allow"


def test_query_on_the_given_pages(spark):
    from clientele.llm import catalog
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in catalog.QUERIES["op12_url_filter"](spark, SF).collect()}
    assert len(got) == len(pages) == len({p.page_id for p in pages})
    for p in pages:
        r, (host, path) = got[p.page_id], parts(p.url)
        verdict, rule = rule_of(host, path, U.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and r.verdict == (verdict or r.verdict)


def test_empty(spark):
    none = frame(spark, [(1, "http://a.com/", "x")]).limit(0)
    labelled = spark.createDataFrame([], "verdict string, name string")
    words = U.dictionary(none.selectExpr("html AS text"), labelled)
    assert U.judge(none.select("page_id", "url"), U.RULES, words).count() == 0
    one = frame(spark, [(1, "http://casino.com/", "x")]).select("page_id", "url")
    assert [r.verdict for r in U.judge(one, U.RULES, words).collect()] == ["allow"]
