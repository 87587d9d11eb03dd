"""Repository analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import staged
from . import search_index
from .clients import with_company
from .ordinal import ordinal


def every_company(companies: DataFrame, figures: DataFrame) -> DataFrame:
    """The company table with its figures; a company without any has zeros."""
    j = companies.select("email", "company_key").join(figures, ["email", "company_key"], "left")
    return j.fillna(0, [c for c, t in figures.dtypes if t == "bigint"])


def company_counts(clients: DataFrame, companies: DataFrame) -> DataFrame:
    """A3: real / partner / total counts of every company (one pass, conditional counts)."""
    return every_company(companies, clients.groupBy("email", "company_key")
                   .agg(F.count_if(~F.col("is_partner")).alias("n_real"),
                        F.count_if(F.col("is_partner")).alias("n_partners"),
                        F.count(F.lit(1)).alias("n_total")))


def rank_companies(counts: DataFrame) -> DataFrame:
    """Rank companies per tenant by real clients desc, ties by key.

    A tenant may own a third of all companies, so the rank is the
    skew-safe distributed row number, not a window over the tenant."""
    return ordinal(counts, ["email"], [F.col("n_real").desc(), F.col("company_key").asc()], "rank")


def top_companies(counts: DataFrame, k: int) -> DataFrame:
    """T1 + limit: the first k per tenant.  ``row_number() <= k`` becomes a
    window group limit that Spark also applies before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("email").orderBy(F.col("n_real").desc(), F.col("company_key").asc())
    return (counts.withColumn("rank", F.row_number().over(w).cast("long"))
                  .filter(F.col("rank") <= k))


# ---------------------------------------------------------------------------
# Labels (P22-P28)
# ---------------------------------------------------------------------------

def _map_literal(d: dict) -> "F.Column":
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def source_tag_label(src):
    """Table tag -- known label, else the source itself, else ``Reference``."""
    from .. import schemas
    from ..functions.text import nullif_empty
    return F.coalesce(F.try_element_at(_map_literal(schemas.SOURCE_TAG_LABEL), src),
                      nullif_empty(src), F.lit("Reference"))


def badge_label(src):
    """Badge label; an empty source reads ``reference`` (lower case)."""
    from .. import schemas
    from ..functions.text import nullif_empty
    return F.coalesce(F.try_element_at(_map_literal(schemas.SOURCE_TAG_LABEL), src), nullif_empty(src), F.lit("reference"))


def badge_text(n, label):
    """``N Label`` with a naive plural ``s``."""
    return F.concat(n.cast("string"), F.lit(" "), label, F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def evidence_preview(note, width: int = 100):
    """P25: first ``width`` characters, ``...`` when longer."""
    note = F.coalesce(note, F.lit(""))
    return F.concat(F.substring(note, 1, width), F.when(F.length(note) > width, F.lit("...")).otherwise(F.lit("")))


def place(country, language):
    """First non-empty of country and language."""
    from ..functions.text import first_nonempty
    return first_nonempty(country, language)


def count_caption(n_match, n_total, q: str):
    """``N of M clients`` while searching, ``M clients`` otherwise."""
    if q:
        return F.format_string("%d of %d clients", n_match, n_total)
    return F.format_string("%d clients", n_total)


def run_summary(n_real, n_partners):
    """Run summary line."""
    return F.format_string("Extracted %d clients + %d technology partners", n_real, n_partners)


def repo_summary(n_companies, n_clients):
    """Repository summary line."""
    return F.format_string("%d companies, %d clients", n_companies, n_clients)


# ---------------------------------------------------------------------------
# Aggregations over the clean client rows
# ---------------------------------------------------------------------------

def source_badges(clients: DataFrame) -> DataFrame:
    """Count per badge label; order by count desc, then first appearance.

    The window runs over (company, label) groups -- at most a handful of
    labels per company -- so it is bounded however large a company is."""
    from pyspark.sql import Window
    g = (clients.withColumn("label", badge_label(F.col("source")))
                .groupBy("email", "company_key", "label")
                .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")))
    w = Window.partitionBy("email", "company_key").orderBy(F.col("n").desc(), F.col("first_ord").asc())
    return (g.withColumn("badge", badge_text(F.col("n"), F.col("label")))
             .withColumn("badge_rank", F.row_number().over(w).cast("long"))
             .drop("first_ord"))


def distinct_facets(clients: DataFrame, companies: DataFrame, approx: bool = False) -> DataFrame:
    """A5/F8: distinct non-empty industries and countries of every company's real clients
    (case-sensitive).

    ``approx=True`` uses HyperLogLog sketches (``approx_count_distinct``):
    one pass, no per-value shuffle, for dashboards over very large
    repositories where an estimate is acceptable."""
    real = clients.filter(~F.col("is_partner"))
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return (every_company(companies, real.groupBy("email", "company_key")
                .agg(cd(F.when(F.col("industry") != "", F.col("industry"))).alias("n_industries"),
                     cd(F.when(F.col("country") != "", F.col("country"))).alias("n_countries")))
                .withColumn("show_countries", F.col("n_countries") > 0))


def repo_totals(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies and distinct lower-cased real client names per tenant.
    ``names``: ``clients.distinct_names``."""
    n = names.filter(~F.col("is_partner")).groupBy("email").agg(F.count_distinct("name_key").alias("n_clients"))
    return (companies.groupBy("email").agg(F.count(F.lit(1)).alias("n_companies"))
                   .join(n, "email", "left").fillna(0, ["n_clients"])
                   .withColumn("summary", repo_summary(F.col("n_companies"), F.col("n_clients"))))


SKETCH_K = 14  # 2^14 registers: a standard error of about 0.8 %


def company_sketches(clients: DataFrame) -> DataFrame:
    """Mergeable distinct counts -- HyperLogLog sketches of a batch's real clients per company:
    names, industries and countries.  One aggregation, no shuffle by value."""
    real = clients.filter(~F.col("is_partner"))
    return real.groupBy("email", "company_key").agg(
        F.hll_sketch_agg(F.lower(F.col("name")), SKETCH_K).alias("names"),
        *(F.hll_sketch_agg(F.nullif(F.col(c), F.lit("")), SKETCH_K).alias(to) for c, to in (("industry", "industries"), ("country", "countries"))))


SKETCHES = ("names", "industries", "countries")


def merge_sketches(*stored: DataFrame) -> DataFrame:
    """The sketches of several batches as one per company; the work grows with companies, not clients."""
    rows = stored[0]
    for more in stored[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("email", "company_key").agg(*(F.hll_union_agg(c).alias(c) for c in SKETCHES))


def sketch_counts(sketches: DataFrame, keys: tuple[str, ...] = ("email",)) -> DataFrame:
    """Estimated distinct names, industries and countries per tenant (or other ``keys``)."""
    return sketches.groupBy(*keys).agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in SKETCHES))


def client_search(clients: DataFrame, q: str) -> DataFrame:
    """Clients matching q in name, industry, country or note; caption per company."""
    g = (clients.withColumn("hit", client_hit(q))
                .groupBy("email", "company_key")
                .agg(F.count_if(F.col("hit") & ~F.col("is_partner")).alias("n_match"),
                     F.count_if(F.col("hit") & F.col("is_partner")).alias("n_match_partners"),
                     F.count_if(~F.col("is_partner")).alias("n_total")))
    return g.withColumn("caption", count_caption(F.col("n_match"), F.col("n_total"), q))


def client_hit(q: str):
    """q in a client's name, industry, country or note."""
    def has(c):
        return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q.lower()))
    return F.lit(True) if not q else (has("name") | has("industry") | has("country") | has("ai_note"))


def client_table(clients: DataFrame, start: int = 1, q: str = "") -> DataFrame:
    """F6/W2/SO2/P22/P25: the rows that match ``q``, then numbered per section (clients,
    then partners).

    Numbering is the skew-safe row number over (company, section).  It reads its rows twice, so those
    that a search leaves are staged before."""
    rows = clients.filter(client_hit(q)).select("email", "company_key", "is_partner", "ord", "name", "industry", "country",
                                                "source", evidence_preview(F.col("ai_note")).alias("note_preview"))
    rows = staged(rows, "client-table") if q else rows
    t = ordinal(rows, ["email", "company_key", "is_partner"], [F.col("ord")], "row_no")
    return t.select("email", "company_key", "is_partner",
                    (F.col("row_no") + F.lit(start - 1)).alias("row_no"), "name", "industry", "country",
                    source_tag_label(F.col("source")).alias("tag"), "note_preview")


def company_documents(clients: DataFrame, kept: DataFrame, chunk_size: int = 1000) -> DataFrame:
    """Ordered client arrays per company as JSON documents.

    A company may hold a third of all clients, so its document is split
    into chunks of at most ``chunk_size`` mention positions; every
    ``collect_list`` is bounded by the chunk, never by the company.

    ``clients``: records with ``company_id``, one for each tenant and company key, and the ``email`` and ``netloc``
    behind it.  ``kept``: the positions (company_id, pos) of those that go into the documents.  The clients travel
    once, to their chunk, each as its JSON text, and the kept positions beside them."""
    keys = ["company_id", F.floor((F.col("pos") - 1) / F.lit(chunk_size)).cast("long").alias("chunk")]
    text = F.to_json(F.struct("name", "industry", "country", "source", "ai_note", "confidence")).alias("text")
    rows = clients.select(*keys, "email", "netloc", F.struct("pos", text).alias("item"))
    g = (rows.unionByName(kept.select(*keys, F.col("pos").alias("keep")), allowMissingColumns=True)
             .groupBy("company_id", "chunk")
             .agg(F.collect_list("item").alias("items"), F.collect_list("keep").alias("keep"),
                  *(F.first(c, ignorenulls=True).alias(c) for c in ("email", "netloc")))
             .filter(F.size("keep") > 0))
    # a kept position sorts before the client it belongs to
    mark = F.transform("keep", lambda p: F.struct(p.alias("pos"), F.lit(None).cast("string").alias("text")))
    g = g.withColumn("items", F.sort_array(F.concat("items", mark)))
    texts = F.transform(F.filter("items", lambda x, i: x["text"].isNotNull() & (F.get("items", i - 1)["pos"] == x["pos"])), lambda x: x["text"])
    head = F.to_json(F.struct(F.col("company_key").alias("key"), F.col("chunk")))
    doc = F.concat(F.left(head, F.length(head) - 1), F.lit(',"clients":['),
                   F.array_join(texts, ","), F.lit("]}"))
    return with_company(g).select("email", "company_key", "chunk", F.size("keep").cast("long").alias("n_clients"),
                                  doc.alias("document"))


# ---------------------------------------------------------------------------
# Company level
# ---------------------------------------------------------------------------

def facets(companies: DataFrame, column: str) -> DataFrame:
    """A7/SO3: distinct non-empty values of a company column per tenant, plus ``all``."""
    vals = (companies.filter(F.col(column) != "").select("email", F.col(column).alias("facet")).distinct())
    alls = companies.select("email").distinct().withColumn("facet", F.lit("all"))
    return vals.unionByName(alls).distinct()


def facet_filter(companies: DataFrame, column: str, value: str) -> DataFrame:
    """equality on a facet column; ``all`` means no filter."""
    if value == "all":
        return companies
    return companies.filter(F.col(column) == F.lit(value))


def name_hits(names: DataFrame, q: str) -> DataFrame:
    """Per company: real clients, and whether any name holds q (one aggregation)."""
    hit = F.contains(F.col("name_key"), F.lit(q.lower())) if q else F.lit(True)
    return names.groupBy("email", "company_key").agg(F.count_if(~F.col("is_partner")).alias("n_real"), F.max(hit).alias("hit"))


def company_search(companies: DataFrame, names: DataFrame, q: str) -> DataFrame:
    """Q in the company name, or in the name of any of its clients; every
    company with its ``n_real``.  An empty q keeps every company.
    ``names``: ``clients.distinct_names``, read once."""
    j = (companies.join(name_hits(names, q), ["email", "company_key"], "left")
                  .withColumn("n_real", F.coalesce("n_real", F.lit(0)).cast("long")))
    if not q:
        return j.drop("hit")
    return j.filter(F.contains(F.lower(F.col("company_name")), F.lit(q.lower())) | F.coalesce("hit", F.lit(False))).drop("hit")


def indexed_company_search(companies: DataFrame, names: DataFrame, q: str, path: str) -> DataFrame:
    """F5/J4 by the trigram index of the client names under ``path`` (``search_index.write_index``): the
    index gives the matching names, and only companies that hold one are looked up."""
    found = search_index.find(companies.sparkSession, path, q).select(F.col("text").alias("name_key"))
    hit = names.join(found, "name_key", "left_semi").select("email", "company_key").distinct().withColumn("hit", F.lit(True))
    j = companies.join(hit, ["email", "company_key"], "left")
    return j.filter(F.contains(F.lower(F.col("company_name")), F.lit(q.lower())) | F.coalesce("hit", F.lit(False))).drop("hit")


def repository_overview(companies: DataFrame, names: DataFrame, facet_col: str = "detected_country",
                        facet: str = "all", q: str = "") -> DataFrame:
    """Facet filter, search, real-client counts, ranking and the place line."""
    j = (company_search(facet_filter(companies, facet_col, facet), names, q)
         .withColumn("place", place(F.col("detected_country"), F.col("detected_language"))))
    return ordinal(j, ["email"], [F.col("n_real").desc(), F.col("company_key").asc()], "rank")


def company_detail(clients: DataFrame, companies: DataFrame, q: str = "") -> DataFrame:
    """One summary row per company -- badges in order, distinct industry / country
    counts and the search caption; companies without clients included.

    Clients that carry ``hit`` (``client_hit`` of the same q) need no texts.
    The clients are narrowed to what the figures need and staged once, so a lost executor
    re-reads them; three aggregations read that, each its columns.  Distinct values are counted by
    shuffles of their own, never collected; the badge list of a company holds its distinct
    source labels."""
    real, key = ~F.col("is_partner"), ["email", "company_key"]
    hit = F.col("hit") if "hit" in clients.columns else client_hit(q)
    v = staged(clients.select(*key, "source", "ord", "is_partner", hit.alias("hit"),
                              *(F.when(real, F.nullif(c, F.lit(""))).alias(c) for c in ("industry", "country"))), "company-detail")
    badges = (source_badges(v).groupBy(*key)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("badge_rank", "badge"))), lambda x: x["badge"]), " | ").alias("badges")))
    totals = v.groupBy(*key).agg(F.count_if(real).alias("n_total"), F.count_if(real & F.col("hit")).alias("n_match"))
    values = v.groupBy(*key).agg(F.count_distinct("industry").alias("n_industries"), F.count_distinct("country").alias("n_countries"))
    out = badges.join(totals, key).join(values, key)
    return (every_company(companies, out).fillna("", ["badges"])
            .select("email", "company_key", "badges", "n_total", "n_industries", "n_countries",
                    count_caption(F.col("n_match"), F.col("n_total"), q).alias("caption")))
