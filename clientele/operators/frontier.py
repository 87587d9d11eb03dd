"""Link discovery over crawled pages -- absolute links of every page, and the pages of a
company that can be reached from its seeds, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, references, urls
from ..functions.text import bind
from ..session import ensure_checkpoint_dir


def company_of(url: Column) -> Column:
    return urls.company_key(urls.strip_www(urls.netloc(url)))


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """(from_url, pos, href, to_url, and the columns ``keep``): the anchors of every page (``url, html``) in page order; ``to_url``
    is resolved against the page's ``base`` or URL, without its fragment."""
    base = F.coalesce(references.resolve(F.col("url"), H.base_href(F.col("html"))), F.col("url"))
    # resolved inside the generator, so that a filter on the result does not compute it again
    links = bind(base, lambda b: F.transform(H.hrefs(F.col("html")), lambda h, i: F.struct(
        (i + 1).cast("long").alias("pos"), h.alias("href"), references.resolve(b, h).alias("to_url"))))
    return pages.select(*keep, F.col("url").alias("from_url"), F.explode(links).alias("l")).select(*keep, "from_url", "l.*")


def is_web(url: Column) -> Column:
    return F.lower(url).rlike("^https?://[^/?#]")


def site_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url, pos): the links a crawl of a company's site follows, each once per
    page: web links to the same company whose path names a known page type."""
    to = F.col("to_url")
    links = page_links(pages).where(is_web(to)).where(urls.page_type(to) != "other").where(company_of(to) == company_of(F.col("from_url")))
    return links.groupBy("from_url", "to_url").agg(F.min("pos").alias("pos"))


def frontier(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(company_key, url, hop, via_url, pos): what can be reached from the seeds (``company_key,
    url``) over ``links`` (``site_links``), each URL once per company, by the fewest hops and then
    the smallest (via_url, pos).  Seeds are hop 0.  Runs until a round finds nothing new (or
    ``max_rounds``).

    A round joins the newest URLs with the links, keeps the first way to each and drops
    what was seen.  Links and rounds are checkpointed, so every round reads tables."""
    ensure_checkpoint_dir(seeds.sparkSession)
    links = links.checkpoint(eager=True)
    newest = (seeds.where(F.coalesce(F.col("url") != "", F.lit(False))).select("company_key", "url").distinct()
              .select("company_key", "url", F.lit(0).cast("long").alias("hop"), F.lit(None).cast("string").alias("via_url"), F.lit(None).cast("long").alias("pos"))
              .checkpoint(eager=True))
    found, hop = newest, 0
    while max_rounds is None or hop < max_rounds:
        hop += 1
        ways = newest.select("company_key", F.col("url").alias("from_url")).join(links, "from_url")
        first = ways.groupBy("company_key", F.col("to_url").alias("url")).agg(F.min(F.struct("from_url", "pos")).alias("way"))
        newest = (first.join(found.select("company_key", "url"), ["company_key", "url"], "left_anti")
                  .select("company_key", "url", F.lit(hop).cast("long").alias("hop"), F.col("way.from_url").alias("via_url"), F.col("way.pos").alias("pos"))
                  .checkpoint(eager=True))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return found
