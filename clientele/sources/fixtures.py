"""Derived input views over the base tables.

The reference keeps its data in a row store fed one web request at a
time; these views stand in for that data at scale, built from the given
tables so that work grows with them:

* ``company_rows``     the company table (from ``supplier``)
* ``client_rows``      one raw client mention (company = supplier, client = customer)
* ``upsert_log``       repository write / delete log (from ``events``)
* ``page_candidates``  discovered page candidates with duplicates and bad URLs (from ``pages``)
* ``doc_pages``        fetched page text per company (from ``documents``)
* ``model_replies``    free-form model replies (from ``customer``)

Orders are explicit columns: a DataFrame has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ordinal import ordinal
from ..session import sliced, slices, staged_while
from .tables import table

# The order of mentions inside a company: partners (line 7) last, then the lineitem
# columns that make it total; the last of them stand in it as one rank.
CLIENT_ORDER_FIELDS = ("o_partner", "l_orderkey", "l_linenumber", "l_partkey", "l_rank")
RANKED = ("l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def client_order(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + f) for f in CLIENT_ORDER_FIELDS])


def _company(sk: Column) -> tuple[Column, Column]:
    """(netloc, tenant) of a supplier."""
    tld = (F.when(sk % 6 == 0, "si").when(sk % 6 == 1, "de").when(sk % 6 == 2, "at")
             .when(sk % 6 == 3, "br").when(sk % 6 == 4, "uk").otherwise("com"))
    netloc = F.concat(F.lit("www."), F.when(sk % 5 == 0, F.lit("w")).otherwise(F.lit("")),
                      F.lit("supplier-"), sk.cast("string"), F.lit("."), tld)
    return netloc, F.concat(F.lit("user"), (sk % 10).cast("string"), F.lit("@example.com"))


def company_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company table: every supplier, and for every seventh one another company of
    the same tenant that has no client at all."""
    sk = F.col("s_suppkey")
    netloc, email = _company(sk)
    idle = F.concat(F.lit("www.idle-"), sk.cast("string"), F.lit(".si"))
    both = F.when(sk % 7 == 0, F.array(netloc, idle)).otherwise(F.array(netloc))
    return table(spark, sf_dir, "supplier").select(sk.alias("company_id"), F.explode(both).alias("netloc"), email.alias("email"))


def _lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *extra)


def _ranked_lines(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Line items with ``l_rank``, their rank by ``RANKED`` among those of one order line and part.

    It decides what the four columns would, equal rows included, and is all that later shuffles carry of
    them.  The window runs where the join with the orders needs the rows anyway."""
    rank = F.rank().over(Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy(*RANKED))
    l = _lines(spark, sf_dir, "l_quantity", *RANKED).where(F.col("l_orderkey").isNotNull())
    return sliced(l, "l_orderkey", part).repartition("l_orderkey").withColumn("l_rank", rank).drop(*RANKED)


def _mentions(spark: SparkSession, sf_dir: str, l: DataFrame, part: tuple[int, int] = (0, 1)) -> DataFrame:
    o = sliced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", part)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # orders meet their customers first, so the line items move once for both
    return l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))


def _name_and_source() -> tuple[Column, Column]:
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    name = (F.when(pk % 41 == 0, F.lit("   "))
              .when(pk % 3 == 0, F.upper("c_name"))
              .when(pk % 3 == 1, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
              .otherwise(F.col("c_name")))
    source = (F.when(ln == 1, "case_study").when(ln == 2, "reference_list").when(ln == 3, "logo")
                .when(ln == 4, "testimonial").when(ln == 5, "blog").when(ln == 6, "job_listing")
                .otherwise("technology_partner"))
    return name, source


def client_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mentions of ``client_rows`` with their company, name and source only: what
    counts and searches need, without the joins behind the other columns."""
    name, source = _name_and_source()
    netloc, email = _company(F.col("l_suppkey"))
    return _mentions(spark, sf_dir, _lines(spark, sf_dir)).select(netloc.alias("netloc"), email.alias("email"), name.alias("name"), source.alias("source_type"))


# The base columns behind the fields that not every query reads.
CLIENT_FIELDS = {"industry": ("c_mktsegment", "l_quantity"), "country": ("n_name", "l_quantity"),
                 "evidence": ("p_name", "p_brand"), "confidence": ("l_quantity",)}


# With positions, the line items are joined and numbered in parts of as many bytes of their table: what a part
# shuffles is gone before the next begins, so it is the staged rows, not the shuffles, that grow with the input.
JOIN_BYTES, NUMBER_BYTES = 512 << 20, 2 << 30


def _joined(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The line items of a part of the orders with all that belongs to them."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return (_mentions(spark, sf_dir, _ranked_lines(spark, sf_dir, part), part)
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("o_partner", F.when(F.col("l_linenumber") == 7, 1).otherwise(0)))


def client_rows(spark: SparkSession, sf_dir: str, with_pos: bool = False, fields: tuple[str, ...] = tuple(CLIENT_FIELDS)) -> DataFrame:
    """One raw client mention per lineitem row.

    Carries ``ord`` (a struct giving the total order of mentions inside a
    company).  ``with_pos=True`` adds the dense 1-based ``pos`` -- a skew-safe
    distributed row number, only needed where a query shows it.  ``fields``: those of
    ``CLIENT_FIELDS`` that are read later; rows are numbered before any text is put
    together, with the base columns of these only.
    """
    if with_pos:
        lines = table(spark, sf_dir, "lineitem")
        base = dict.fromkeys(["l_suppkey", "c_name", *CLIENT_ORDER_FIELDS, *(c for f in fields for c in CLIENT_FIELDS[f])])
        n, m = slices(lines, JOIN_BYTES), slices(lines, NUMBER_BYTES)
        with staged_while((_joined(spark, sf_dir, (k, n)).select(*base) for k in range(n)), "mentions") as j:
            j = reduce(DataFrame.unionByName, [ordinal(sliced(j, "l_suppkey", (k, m)), ["l_suppkey"], [F.col(f) for f in CLIENT_ORDER_FIELDS], "pos")
                                               for k in range(m)])
    else:
        j = _joined(spark, sf_dir)
    name, source = _name_and_source()
    netloc, email = _company(F.col("l_suppkey"))
    q = F.col("l_quantity")
    texts = {
        "industry": F.when(q < 5, F.lit("")).otherwise(F.col("c_mktsegment")),
        "country": F.when(q > 45, F.lit("")).otherwise(F.col("n_name")),
        "evidence": F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") delivered for "), F.col("c_name")),
        "confidence": F.when(q == 1, F.lit(None)).otherwise(q.cast("int") + 50).cast("long"),
    }
    return j.select(
        F.col("l_suppkey").alias("company_id"),
        netloc.alias("netloc"), email.alias("email"), name.alias("name"), source.alias("source_type"),
        *(texts[f].alias(f) for f in fields), client_order().alias("ord"), *(["pos"] if with_pos else []))


def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write/delete log keyed by (email, company_key); ``seq`` breaks ties."""
    return as_upsert_log(table(spark, sf_dir, "events"))


def as_upsert_log(events: DataFrame) -> DataFrame:
    """``upsert_log`` of a batch or a stream of events."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user"), (F.col("user_id") % 15).cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("co-"), F.col("user_id").cast("string"), F.lit(".si")).alias("company_key"),
        F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"),
        written(F.col("event_id"), F.col("props")).alias("data"),
        F.col("ts").alias("updated_at"), "event_type")


def written(event_id: Column, props: Column) -> Column:
    """The stored document: every seventh write is cut short (S9, A10 quarantine)."""
    return F.when(event_id % 7 == 0, F.left(props, F.length(props) - 1)).otherwise(props)


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered candidates: every page once, again for page_id % 7 = 0, and a
    ``mailto:`` candidate for page_id % 11 = 0.  Expressed as one scan plus a
    bounded ``explode`` (no join)."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    ks = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)),
                  lambda k: (k == 0) | ((k == 1) & (pid % 7 == 0)) | ((k == 2) & (pid % 11 == 0)))
    x = pg.select("page_id", "url", F.explode(ks).alias("k"))
    ptype = (F.when(pid % 8 == 0, "homepage").when(pid % 8 == 1, "case_studies_index")
               .when(pid % 8 == 2, "case_study").when(pid % 8 == 3, "reference_list")
               .when(pid % 8 == 4, "testimonials").when(pid % 8 == 5, "blog_post")
               .when(pid % 8 == 6, "job_listing").otherwise("partners"))
    return x.select(
        F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("netloc"),
        F.when(F.col("k") == 2, F.concat(F.lit("mailto:x"), pid.cast("string"))).otherwise(F.col("url")).alias("url"),
        ptype.alias("type"),
        (pid * 3 + F.col("k")).alias("seq"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table with the HTTP status of each fetch: some pages answered 404 or 503."""
    k = F.col("page_id")
    status = F.when(k % 17 == 0, 404).when(k % 23 == 0, 503).otherwise(200)
    return table(spark, sf_dir, "pages").select("url", "html", status.alias("http_status"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redirect table of the crawl (from_url, to_url): short chains, one of 35 steps, loops, a
    page that points to itself and one that points to a page nobody crawled."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    m = k % 100
    to = (F.when(m == 80, k + 2).when(m == 95, k).when(m == 90, F.lit(-1))
           .when((k % 10).between(1, 3) | m.between(41, 75), k - 1))
    ends = p.select(k.alias("to_id"), F.col("url").alias("to_url"))
    known = p.withColumn("to_id", to).join(ends, "to_id").select(F.col("url").alias("from_url"), "to_url")
    return known.unionByName(p.where(m == 90).select(F.col("url").alias("from_url"), F.lit("https://gone.example.org/").alias("to_url")))


def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with character references of every kind, and a quarter of them with dropped
    elements inside each other and a ``>`` inside an attribute."""
    k = F.col("page_id")
    extra = (F.when(k % 4 == 0, "<p>Caf&eacute; &#39;Zoo&#39; &#x2013; 5&nbsp;&euro;&hellip;</p>")
              .when(k % 4 == 1, "<p>a&#128;b &notit; &lt;i&gt; &amp;amp; &bogus; &copy 2024 &CounterClockwiseContourIntegral;</p>")
              .when(k % 4 == 3, "<nav>menu<nav>sub</nav>rest</nav><p title=\"x>y\">&Uuml;ber</p>").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), extra)).alias("html"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages as company sites, so that every extraction rule meets cases that
    fit and cases that do not: paths of the known page types, customer headlines, logo
    images, list items that are vendors, navigation words and shouted names, and one link in
    each way of writing one (relative, host or query only, any quotes and case, a comment before it)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    k = F.col("page_id")
    root = F.regexp_extract("url", r"^https?://[^/?#]*", 0)
    path = (F.when(k % 9 == 0, "/case-studies/shop").when(k % 9 == 1, "/reference").when(k % 9 == 2, "/blog/launch")
             .when(k % 9 == 3, "/karriere").when(k % 9 == 4, "/partners").when(k % 9 == 5, "/testimonials").when(k % 9 == 6, "/"))
    headline = F.when(k % 5 == 0, F.concat(F.lit("<title>How Acme Foods "), k.cast("string"), F.lit(" grew "))) \
                .when(k % 5 == 1, F.concat(F.lit("<title>New shop for Nordica "), k.cast("string"), F.lit(" "))) \
                .otherwise(F.lit("<title>"))
    headline = F.concat(F.when(k % 10 == 0, F.lit('<base target=_top><BASE href="/sub/dir/">')).otherwise(F.lit("")), headline)
    logo = F.when(k % 6 == 0, F.concat(F.lit('<img src="l.png" alt=" Client '), k.cast("string"), F.lit(' ">'))) \
            .otherwise(F.concat(F.lit("<IMG title='a>b' ALT='Caf&eacute; "), k.cast("string"), F.lit("' src=x>")))
    link = (F.when(k % 6 == 0, '<a class="x" href="../reference/a.html">')
             .when(k % 6 == 1, F.concat(F.lit("<A HREF='"), F.regexp_replace(root, "^https?:", ""), F.lit("/partners/?a=1&amp;b=2&copy=3#top'>")))
             .when(k % 6 == 2, '<a data-href="/no" href=?page=2>')
             .when(k % 6 == 3, '<a title="a>b" href=" ./x/./y/../z ">')
             .when(k % 6 == 4, '<a\nhref = "mailto:info@x.si">')
             .otherwise('<!-- <a href="/hidden"> --><a href="&#47;reference&#x2F;list">'))
    extra = F.when(k % 3 == 0, F.concat(
        logo, F.lit('<ul><li>SAP</li><li> Home</li><li><b>ACME</b> FOODS.</li></ul><a href="https://other.example.org/clients/">x</a>'))) \
        .otherwise(F.lit(""))
    return p.select("page_id", F.coalesce(F.concat(root, path), F.col("url")).alias("url"),
                    F.replace(F.replace("html", F.lit("<title>"), headline), F.lit("<body>"), F.concat(F.lit("<body>"), link, extra)).alias("html"))


def linked_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every host as a site whose r-th page links to pages 2r and 2r+1 (some of
    them never crawled) and to another host; every fifth path names no page type.  (root, r, url, html)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]*", 0).alias("root"))
    p = ordinal(p, ["root"], [F.col("page_id")], "r")

    def path(r: Column) -> Column:
        kind = F.when(r % 5 == 0, "/case-studies/").when(r % 5 == 1, "/reference/").when(r % 5 == 2, "/blog/").when(r % 5 == 3, "/partners/").otherwise("/about/")
        return F.concat(kind, r.cast("string"), F.when(r % 2 == 1, F.lit(".html")).otherwise(F.lit("/")))

    def anchor(to: Column) -> Column:
        r = F.col("r")
        return (F.when(r % 4 == 0, F.concat(F.lit('<a href="'), to, F.lit('#x">')))
                 .when(r % 4 == 1, F.concat(F.lit("<A class=k HREF='../.."), to, F.lit("'>")))
                 .when(r % 4 == 2, F.concat(F.lit('<a data-x="1" href='), F.regexp_replace("root", "^https?:", ""), to, F.lit(">")))
                 .otherwise(F.concat(F.lit('<a href="'), F.col("root"), F.lit("/."), to, F.lit('">'))))
    html = F.concat(F.lit("<html><body>"), anchor(path(F.col("r") * 2)), anchor(path(F.col("r") * 2 + 1)),
                    F.lit('<a href="https://other.example.org/reference/1">x</a><a href="'), path(F.col("r")), F.lit('">self</a></body></html>'))
    return p.select("root", "r", F.concat("root", path(F.col("r"))).alias("url"), html.alias("html"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages per company (``source``) with their whole text, in the order of ``doc_id``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return d.select(
        F.col("source").alias("company_key"),
        F.col("doc_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("type"),
        F.col("text"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form replies: no JSON, cut-off JSON, fenced JSON with confidence
    missing / null / set."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    fenced = F.concat(
        F.lit("Result: ```json\n{\"name\":\""), F.col("c_name"), F.lit("\""),
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(",\"confidence\":null"))
         .otherwise(F.lit(",\"confidence\":95")),
        F.lit(",\"industry\":\""), F.col("c_mktsegment"), F.lit("\"}\n```"))
    reply = (F.when(k % 13 == 0, F.lit("no json here"))
              .when(k % 13 == 1, F.concat(F.lit("{\"name\":\""), F.col("c_name"), F.lit("\",\"confidence\":")))
              .otherwise(fenced))
    return c.select(k.alias("reply_id"), reply.alias("reply"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API response envelopes around ``model_replies``: HTTP 529 for
    reply_id % 19 = 0 (201 for % 5 = 0), an error document for % 17 = 0, an error without a
    message for % 23 = 0, else content blocks (text, tool_use, text) whose
    texts concatenate to the reply."""
    r = model_replies(spark, sf_dir)
    k = F.col("reply_id")
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.substring("reply", 1, 10).alias("text")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("text").alias("type"), F.expr("substring(reply, 11)").alias("text")))
    status = F.when(k % 19 == 0, F.lit(529)).when(k % 5 == 0, F.lit(201)).otherwise(F.lit(200))
    body = (F.when(k % 19 == 0, F.concat(F.lit("overloaded "), F.repeat(F.lit("."), 400)))
             .when(k % 17 == 0, F.lit('{"type":"error","error":{"message":"rate limited"}}'))
             .when(k % 23 == 0, F.lit('{"type":"error","error":{}}'))
             .otherwise(F.to_json(F.struct(blocks.alias("content")))))
    return r.select("reply_id", status.alias("http_status"), body.alias("body"))


def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as they arrive: some without a tenant, some without a value, and a column the table does not have."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(k % 97 != 0, F.concat(F.lit("user"), (F.col("user_id") % 15).cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat("event_type", F.lit("-"), k.cast("string")).alias("name"), F.when(k % 9 != 0, F.col("props")).alias("value"), F.col("value").alias("weight"))


def repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository rows as text: some without a document, without a time, or with one that is no time."""
    k = F.col("event_id")
    at = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select(
        F.lit("a@example.com").alias("email"), F.concat(F.lit("co-"), k.cast("string")).alias("company_key"),
        F.when(k % 17 != 0, F.col("props")).alias("data"), at.alias("updated_at"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company documents as JSON text, one a supplier: descriptions that are missing, null or set, clients
    without a confidence, and every seventh document cut short."""
    k = F.col("s_suppkey")
    description = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(',"company_description":null')) \
                   .otherwise(F.concat(F.lit(',"company_description":"from '), F.col("s_nationkey").cast("string"), F.lit('"')))
    confidence = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(',"confidence":95'))
    doc = F.concat(F.lit('{"key":"k'), k.cast("string"), F.lit('"'), description, F.lit(',"clients":[{"name":"Acme","source":"logo"'), confidence,
                   F.lit('},{"name":"SAP"}],"ai_cleaned":true,"error":null}'))
    return table(spark, sf_dir, "supplier").select(F.lit("a@example.com").alias("email"), F.concat(F.lit("k"), k.cast("string")).alias("company_key"),
                                                   F.when(k % 7 == 0, F.substring(doc, 1, 20)).otherwise(doc).alias("data"))
