"""Client records: mapping, blank filter, union of clients and partners,
keep-first dedupe (P15, P16, F2, SO1, A2, F7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import urls
from ..functions.text import ustrip
from .dedupe import keep_first

def _partner() -> Column:
    return F.lit(schemas.PARTNER_SOURCE)


def is_partner(source: Column) -> Column:
    """partner rows are the ones whose source is ``technology_partner``."""
    return F.coalesce(source == _partner(), F.lit(False))


def with_company(rows: DataFrame) -> DataFrame:
    """Company identity of a raw mention: ``netloc`` -> ``domain`` -> ``company_key``."""
    return (rows.withColumn("domain", urls.strip_www(F.col("netloc")))
                .withColumn("company_key", urls.company_key(F.col("domain"))))


def records(rows: DataFrame) -> DataFrame:
    """SO1 + P15/P16: clients and partners in one record shape (flat columns).

    Partner rows (source ``technology_partner``) take the partner mapping;
    the section order (clients first) is part of ``ord``.  Each field is
    its own ``when``: a CASE over whole structs is re-expanded for every
    field the plan reads (and for filters pushed into joins).  Fields that the
    rows do not carry are left out.
    """
    partner = F.col("source_type") == _partner()
    keep = [c for c in rows.columns if c not in
            ("name", "industry", "country", "source_type", "evidence", "confidence")]
    fields = {
        "industry": lambda: F.when(partner, F.lit(schemas.PARTNER_INDUSTRY)).otherwise(F.coalesce("industry", F.lit(""))).alias("industry"),
        "country": lambda: F.when(partner, F.lit("")).otherwise(F.coalesce("country", F.lit(""))).alias("country"),
        "source_type": lambda: F.coalesce("source_type", F.lit(schemas.DEFAULT_CLIENT_SOURCE)).alias("source"),
        "evidence": lambda: F.coalesce("evidence", F.lit("")).alias("ai_note"),
        "confidence": lambda: F.when(partner, F.lit(schemas.PARTNER_CONFIDENCE).cast("long"))
                               .otherwise(F.coalesce(F.col("confidence").cast("long"),
                                                     F.lit(schemas.DEFAULT_CONFIDENCE).cast("long"))).alias("confidence")}
    return rows.select(*keep, ustrip(F.col("name")).alias("name"), *(f() for c, f in fields.items() if c in rows.columns))


def drop_blank(clients: DataFrame) -> DataFrame:
    """names that are empty after strip are dropped."""
    return clients.filter(F.col("name") != F.lit(""))


def dedupe_clients(clients: DataFrame, company_cols=("email", "company_key")) -> DataFrame:
    """A2: keep the first mention of every lower-cased name inside a company.

    Clients precede partners in ``ord``, so a name in both stays a client.
    """
    keyed = clients if "name_key" in clients.columns else clients.withColumn("name_key", F.lower(F.col("name")))
    return keep_first(keyed, [*company_cols, "name_key"], F.col("ord"))


def clean_clients(rows: DataFrame, columns: tuple[str | Column, ...] | None = None, order: str | Column = "ord",
                  names: tuple[str, ...] = ("name", "source"), company: tuple[str, ...] = ("email", "company_key")) -> DataFrame:
    """Raw mentions -> one deduped client row per (tenant, company, name).

    ``columns``: the record columns (or expressions over them) that are read later; the
    others are dropped before the keep-first aggregation, which would carry them whole.
    ``order``: the order of mentions inside a company, named ``ord``.
    ``names``: which of name and source are read later; without them the key ``name_key``
    and ``is_partner`` stand for them.
    ``company``: the columns that tell companies apart."""
    c = drop_blank(records(with_company(rows))).withColumn("name_key", F.lower("name"))
    if columns is not None:
        partner = [] if "source" in names else [is_partner(F.col("source")).alias("is_partner")]
        c = c.select(*company, "name_key", *names, *partner, order, *columns)
    out = dedupe_clients(c, company)
    return out if "is_partner" in out.columns else out.withColumn("is_partner", is_partner(F.col("source")))


def distinct_names(rows: DataFrame) -> DataFrame:
    """F2 + A2 for counting: ``email, company_key, name_key, is_partner``.  Clients
    precede partners, so a name counts as a partner only if all its mentions are."""
    c = with_company(rows).withColumn("name", ustrip(F.col("name"))).filter(F.col("name") != "")
    return (c.groupBy("email", "company_key", F.lower("name").alias("name_key"))
             .agg(F.min(is_partner(F.col("source_type"))).alias("is_partner")))


def companies(rows: DataFrame) -> DataFrame:
    """Company table of the repository: one row per (tenant, company key) with its
    identity, default name (P8) and locale (P5/P6); of several hosts with one key
    the last one stands, as a repeated write replaces the row."""
    c = with_company(rows.select("email", "netloc").distinct())
    c = c.groupBy("email", "company_key").agg(F.max(F.struct("netloc", "domain")).alias("_c")).select("email", "company_key", "_c.*")
    c = c.withColumn("tld", urls.tld(F.col("domain")))
    c = urls.with_locale(c)
    return c.select("email", "company_key", "netloc", "domain", "tld",
                    urls.default_company_name(F.col("domain")).alias("company_name"),
                    F.col("language").alias("detected_language"),
                    F.col("country").alias("detected_country"))
