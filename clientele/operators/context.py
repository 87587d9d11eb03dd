"""Page path: candidate dedupe and cap, fetch join, run status, text
budget and the ordered request context (A1, W5, F1, F9, J2, P30, S11, A11,
W4, P21, W3, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from ..functions import html as H
from .dedupe import keep_first
from .ordinal import ordinal
from .redirects import redirect_ends


def dedupe_urls(cands: DataFrame, company: str = "netloc") -> DataFrame:
    """A1: first candidate per (company, url) by ``seq``; empty URLs dropped."""
    c = cands.filter(F.coalesce(F.col("url") != "", F.lit(False)))
    return keep_first(c, [company, "url"], F.col("seq"))


def cap_pages(cands: DataFrame, company: str = "netloc", k: int = schemas.PAGES_PER_COMPANY,
              order: str = "seq") -> DataFrame:
    """The first k candidates per company, before any URL check.

    ``row_number() <= k`` is planned as a window group limit, applied
    map-side before the shuffle, so a company with millions of candidates
    ships k rows per map task."""
    w = Window.partitionBy(company).orderBy(F.col(order))
    return cands.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def http_only(cands: DataFrame) -> DataFrame:
    """URLs that start with ``http`` (so ``httpfoo`` passes)."""
    return cands.filter(F.col("url").startswith("http"))


def with_fallback(cands: DataFrame, companies: DataFrame, company: str = "netloc") -> DataFrame:
    """Companies left without any candidate fetch their own URL as ``homepage``."""
    missing = companies.select(company).distinct().join(cands.select(company), company, "left_anti")
    fb = missing.select(company,
                        F.concat(F.lit("https://"), F.col(company)).alias("url"),
                        F.lit("homepage").alias("type"),
                        F.lit(0).cast("long").alias("seq"),
                        F.lit(True).alias("is_fallback"))
    return cands.select(company, "url", "type", "seq", F.lit(False).alias("is_fallback")).unionByName(fb)


def parsed_pages(pages: DataFrame, with_text: bool = True, fields: dict[str, Column] | None = None) -> DataFrame:
    """P9 and ``fields`` (columns over ``html``), once per page: (page_url, code, text, n_chars, ...).

    Of several rows of one URL the one with the lowest code, then the smallest text, counts.
    ``http_status`` of the page table is optional.  Pages that answered 400 or more have
    no text; without ``with_text`` only its length is kept."""
    code = (F.col("http_status") if "http_status" in pages.columns else F.lit(200)).cast("int")
    good = F.coalesce(code, F.lit(200)) < 400
    x = pages.select(F.col("url").alias("page_url"), code.alias("code"), F.when(good, H.page_text(F.col("html"))).alias("text"),
                     *(F.when(good, c).alias(name) for name, c in (fields or {}).items()))
    x = x.withColumn("n_chars", F.length("text").cast("long"))
    x = x if with_text else x.drop("text")
    order = F.struct(F.coalesce("code", F.lit(200)), "text" if with_text else "n_chars")
    return keep_first(x.filter(F.col("page_url").isNotNull()), ["page_url"], order)


def fetch(cands: DataFrame, pages: DataFrame, company: str = "netloc", redirects: DataFrame | None = None,
          with_text: bool = True, fields: dict[str, Column] | None = None) -> DataFrame:
    """Join the candidates with the crawled pages on the URL that their
    redirects end at.

    Status per candidate: ``skipped`` (not http), ``ok`` (page present; whole text
    by P9), ``http`` (the page answered 400 or more, ``http_code``), ``failed`` (no
    page), ``failed(loop)`` and ``failed(redirects)`` (redirects that never end, or more
    than a client follows).  ``final_url`` is the URL that answered, so two candidates may share
    it.  ``redirects``: from_url, to_url.  Pages are parsed before the join, so each one once."""
    asked = F.col("url").startswith("http")
    if redirects is not None:
        ends = redirect_ends(redirects).select(F.col("url").alias("_from"), F.col("final_url").alias("_end"), "outcome")
        cands = cands.join(ends, (F.col("url") == F.col("_from")) & asked, "left")
        target = F.when(F.col("outcome").isNull(), F.col("url")).otherwise(F.col("_end"))
        lost = F.when(F.col("outcome") != "ok", F.concat(F.lit("failed("), F.col("outcome"), F.lit(")")))
    else:
        target, lost = F.col("url"), F.lit(None).cast("string")
    cands = cands.withColumn("_lost", lost).withColumn("_target", F.when(asked, target))
    pg = parsed_pages(pages, with_text, fields)
    j = cands.join(pg, F.col("_target") == F.col("page_url"), "left")
    bad = F.coalesce(F.col("code") >= 400, F.lit(False))
    status = (F.when(~asked, F.lit("skipped"))
               .when(F.col("_lost").isNotNull(), F.col("_lost"))
               .when(bad, F.lit("http"))
               .when(F.col("page_url").isNotNull(), F.lit("ok"))
               .otherwise(F.lit("failed")))
    return (j.withColumn("status", status)
             .withColumn("http_code", F.when(bad, F.col("code")))
             .withColumn("type", F.coalesce("type", F.lit("unknown")))
             .withColumn("final_url", F.when(F.col("status") == "ok", F.col("page_url")))
             .drop("page_url", "code", "_from", "_end", "outcome", "_lost", "_target"))


def fetch_counts(fetched: DataFrame, company: str = "netloc") -> DataFrame:
    """Outcomes per company, status and HTTP code."""
    return (fetched.groupBy(company, "status", "http_code")
                   .agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars")))


def block_head(page_no: Column, url: Column, ptype: Column) -> Column:
    """The head of one page's block; a missing url or type reads as its default."""
    rule = F.lit(schemas.BLOCK_RULE)
    return F.concat(F.lit("\n\n"), rule, F.lit("\nPAGE "), page_no.cast("string"), F.lit(" | "), F.coalesce(url, F.lit("")),
                    F.lit(" | type: "), F.coalesce(ptype, F.lit("unknown")), F.lit("\n"), rule, F.lit("\n"))


def page_block(page_no: Column, url: Column, ptype: Column, text: Column) -> Column:
    """One page's block in the analysis request."""
    return F.concat(block_head(page_no, url, ptype), F.coalesce(text, F.lit("")))


def context_blocks(fetched: DataFrame, company: str = "company_key", order: str = "seq",
                   budget: int = schemas.CONTEXT_CHARS) -> DataFrame:
    """Number the pages of a company and lay their blocks end to end in
    parts of ``budget`` characters.  A block that crosses an edge has a piece in each
    part, so no text is lost, however much there is.

    Only keys and lengths are numbered and summed, by the skew-safe ordinal: a
    company may hold a third of all pages.  One row per piece: ``piece_from``
    (1-based, in the block) and ``piece_chars``."""
    keys = fetched.select(company, order, "url", "type", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_text_chars"))
    b = ordinal(keys, [company], [F.col(order)], "page_no")
    head = block_head(F.col("page_no"), F.col("url"), F.col("type"))
    b = b.withColumn("block_chars", F.length(head).cast("long") + F.col("_text_chars")).drop("_text_chars")
    b = ordinal(b, [company], [F.col("page_no")], "_end", weight="block_chars")
    b = b.withColumn("start_char", F.col("_end") - F.col("block_chars"))
    b = b.withColumn("part", F.explode(F.sequence(F.expr(f"start_char div {budget}"), F.expr(f"(_end - 1) div {budget}"))))
    lo = F.greatest(F.col("start_char"), F.col("part") * budget)
    hi = F.least(F.col("_end"), (F.col("part") + 1) * budget)
    return (b.withColumn("piece_from", lo - F.col("start_char") + 1).withColumn("piece_chars", hi - lo).drop("_end"))


def context_text(fetched: DataFrame, blocks: DataFrame, company: str = "company_key", order: str = "seq") -> DataFrame:
    """The ordered text of every (company, part).  A collected group holds at most
    one budget of characters."""
    text = fetched.select(company, order, F.col("text").alias("_text"))
    j = blocks.join(text, [company, order])
    block = page_block(F.col("page_no"), F.col("url"), F.col("type"), F.col("_text"))
    j = j.withColumn("piece", F.substring(block, F.col("piece_from").cast("int"), F.col("piece_chars").cast("int")))
    return (j.groupBy(company, "part")
             .agg(F.count(F.lit(1)).alias("n_pages"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "piece"))),
                                           lambda x: x["piece"]), "").alias("context"))
             .withColumn("context_chars", F.length("context").cast("long")))
