"""Golden tests for the ordering rules (SURVEY Q4, Q5, Q11, Q13, Q21, Q7 in
test_streaming_and_jobs)."""

from pyspark.sql import functions as F

from clientele.functions.html import page_text
from clientele.operators import analytics as A, clients as C, context as X


def test_cap_applies_before_http_check(spark):  # Q4
    rows = [("h", f"mailto:{i}" if i < 14 else f"https://h/{i}", "t", i) for i in range(20)]
    df = spark.createDataFrame(rows, "netloc string, url string, type string, seq long")
    kept = X.http_only(X.cap_pages(X.dedupe_urls(df))).collect()
    assert [r.seq for r in kept] == [14]          # bad URLs used up 14 of the 15 slots
    assert X.http_only(spark.createDataFrame([("h", "httpfoo", "t", 1)], df.schema)).count() == 1


def test_url_dedupe_is_exact_string(spark):  # Q5
    rows = [("h", "https://h/a", "x", 1), ("h", "https://h/a/", "y", 2), ("h", "https://h/a", "z", 3), ("h", "", "w", 0)]
    df = spark.createDataFrame(rows, "netloc string, url string, type string, seq long")
    got = sorted((r.url, r.type) for r in X.dedupe_urls(df).collect())
    assert got == [("https://h/a", "x"), ("https://h/a/", "y")]


def test_client_beats_partner_with_same_name(spark):  # Q11
    schema = ("company_id long, netloc string, email string, name string, industry string, country string, "
              "source_type string, evidence string, confidence long, ord struct<o_partner:int, n:int>")
    rows = [(1, "a.si", "u@x", " SAP ", "", "", "technology_partner", "vendor", None, (1, 1)),
            (1, "a.si", "u@x", "sap", "IT", "", "logo", "logo wall", 90, (0, 5)),
            (1, "a.si", "u@x", "   ", "", "", "logo", "", None, (0, 1))]
    got = C.clean_clients(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].name == "sap" and not got[0].is_partner and got[0].confidence == 90


def test_blank_line_collapse_only_inside_one_node(spark):  # Q13
    df = spark.createDataFrame([("<p>a</p>\n\n\n\n<p>b</p>",), ("<pre>a\n\n\n\nb</pre>",)], "html string")
    assert [r.t for r in df.select(page_text(F.col("html")).alias("t")).collect()] == ["a\nb", "a\n\nb"]


def test_ranking_ties_by_company_key(spark):  # Q21
    df = spark.createDataFrame([("u", "b.si", 5), ("u", "a.si", 5), ("u", "c.si", 9), ("v", "z.si", 1)],
                               "email string, company_key string, n_real long")
    got = {(r.email, r.company_key): r.rank for r in A.rank_companies(df).collect()}
    assert got == {("u", "c.si"): 1, ("u", "a.si"): 2, ("u", "b.si"): 3, ("v", "z.si"): 1}


def test_row_numbers_restart_per_section(spark):  # Q14 / W2
    schema = "email string, company_key string, is_partner boolean, ord int, name string, industry string, country string, source string, ai_note string"
    rows = [("u", "k", False, 2, "b", "", "", "logo", ""), ("u", "k", False, 1, "a", "", "", "logo", ""),
            ("u", "k", True, 3, "p", "", "", "technology_partner", "")]
    df = spark.createDataFrame(rows, schema)
    got = {r.name: r.row_no for r in A.client_table(df).collect()}
    assert got == {"a": 1, "b": 2, "p": 1}
    assert {r.name: r.row_no for r in A.client_table(df, start=2).collect()} == {"a": 2, "b": 3, "p": 2}


def test_distinct_facets_exact_and_approx_agree_on_small_sets(spark):  # A5
    schema = "email string, company_key string, is_partner boolean, industry string, country string"
    rows = [("u", "k", False, "IT", "SI"), ("u", "k", False, "IT", ""), ("u", "k", False, "it", "AT"),
            ("u", "k", True, "Vendor", "US"), ("u", "k", False, "", None)]
    df = spark.createDataFrame(rows, schema)
    companies = df.select("email", "company_key").distinct()
    exact = A.distinct_facets(df, companies).first()
    approx = A.distinct_facets(df, companies, approx=True).first()
    assert (exact.n_industries, exact.n_countries) == (2, 2)
    assert (approx.n_industries, approx.n_countries) == (2, 2)
