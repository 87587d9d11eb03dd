"""URL and company-identity scalars.

All are native Column expressions so they stay inside whole-stage codegen.
``parse_url`` is deliberately avoided: under ANSI mode it raises on bad
URLs and it drops ports and non-ASCII hosts the key rules depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from .text import first_nonempty, title_case, ustrip


def normalize_url(c: Column) -> Column:
    """Strip, then prefix ``https://`` unless it starts with http(s):// (case-sensitive)."""
    s = ustrip(c)
    return F.when(s.rlike(r"^https?://"), s).otherwise(F.concat(F.lit("https://"), s))


def netloc(url: Column) -> Column:
    """Authority part (host, port, userinfo; letter case kept)."""
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def strip_www(host: Column, strict: bool = False) -> Column:
    """Remove leading characters from the set {w, .} (``www.wwf.org`` -> ``f.org``).

    ``strict=True`` removes only a literal ``www.`` prefix.
    """
    if strict:
        return F.regexp_replace(host, r"^www\.", "")
    return F.ltrim(host, F.lit("w."))


def tld(domain: Column) -> Column:
    """Last dot-separated label, lower-cased."""
    return F.lower(F.substring_index(domain, ".", -1))


def company_key(domain: Column, strict: bool = False) -> Column:
    """Delete every character outside ``[a-z0-9.-]`` (upper case and ports' ':' vanish).

    ``strict=True`` lower-cases and drops the port first.
    """
    if strict:
        domain = F.regexp_replace(F.lower(domain), r":\d*$", "")
    return F.regexp_replace(domain, r"[^a-z0-9.-]", "")


def default_company_name(domain: Column, dash_to_space: bool = True) -> Column:
    """First label of the domain, title-cased; dashes become spaces on the main path."""
    first = F.split(domain, r"\.").getItem(0)
    if dash_to_space:
        first = F.replace(first, F.lit("-"), F.lit(" "))
    return title_case(first)


def tenant_key(email: Column) -> Column:
    """Tenant key = trimmed, lower-cased e-mail."""
    return F.lower(ustrip(email))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_type(url: Column) -> Column:
    """Classify a page URL by its path keywords."""
    p = F.lower(url_path(url))
    ref = "|".join(k.replace("-", r"\-") for k in schemas.REFERENCE_PATH_KEYWORDS)
    return (F.when(p.rlike(rf"/(case-stud(y|ies)|case_stud(y|ies))(/|$)"), F.lit("case_study"))
            .when(p.rlike(rf"/({ref})(/|$)"), F.lit("reference_list"))
            .when(p.rlike(r"/(testimonials?)(/|$)"), F.lit("testimonials"))
            .when(p.rlike(r"/(blog|news|insights?)(/|$)"), F.lit("blog_post"))
            .when(p.rlike(r"/(jobs?|careers?|karriere|kariera)(/|$)"), F.lit("job_listing"))
            .when(p.rlike(r"/(partners?|technolog(y|ies))(/|$)"), F.lit("partners"))
            .when((p == F.lit("")) | (p == F.lit("/")), F.lit("homepage"))
            .otherwise(F.lit("other")))


# ---------------------------------------------------------------------------
# Locale lookups.  The maps are code constants (18 / 23 entries), so a
# broadcast is size-bounded by construction.
# ---------------------------------------------------------------------------

def locale_table(spark: SparkSession) -> DataFrame:
    keys = sorted(set(schemas.TLD_LANGUAGE) | set(schemas.TLD_COUNTRY))
    rows = [(k, schemas.TLD_LANGUAGE.get(k), schemas.TLD_COUNTRY.get(k)) for k in keys]
    return spark.createDataFrame(rows, "tld string, map_language string, map_country string")


def with_locale(df: DataFrame, tld_col: str = "tld") -> DataFrame:
    """Left join the TLD maps (broadcast) and apply the two defaults."""
    lk = F.broadcast(locale_table(df.sparkSession)).withColumnRenamed("tld", "_lk_tld")
    return (df.join(lk, F.col(tld_col) == F.col("_lk_tld"), "left")
              .withColumn("language", F.coalesce("map_language", F.lit(schemas.DEFAULT_LANGUAGE)))
              .withColumn("country", F.coalesce("map_country", F.lit(schemas.DEFAULT_COUNTRY)))
              .drop("_lk_tld", "map_language", "map_country"))


def country_guess(given: Column, tld_col: Column) -> Column:
    """The given country when non-empty, else the TLD's country (as a map literal)."""
    m = F.create_map(*[F.lit(x) for kv in sorted(schemas.TLD_COUNTRY.items()) for x in kv])
    return first_nonempty(given, F.try_element_at(m, tld_col))


def company_identity(df: DataFrame, url_col: str) -> DataFrame:
    """P1-P7 in one projection: url -> url_norm, netloc, domain, tld, company_key."""
    u = normalize_url(F.col(url_col))
    return (df.withColumn("url_norm", u)
              .withColumn("netloc", netloc(F.col("url_norm")))
              .withColumn("domain", strip_www(F.col("netloc")))
              .withColumn("tld", tld(F.col("domain")))
              .withColumn("company_key", company_key(F.col("domain"))))
