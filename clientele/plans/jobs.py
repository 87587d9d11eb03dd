"""End-to-end jobs (E1 build_repository, E2 apply_results, A10 export).

E1 is the reference's scrape flow for *all* companies at once, split at
its two model calls into materialisable steps (requests -> replies ->
results) so each can be restarted on its own:

    companies --P1-P7--> identity, locale
    discovery candidates (+ X2 frontier) --A1--> unique --F9--> fallback
      --S1--> ends of redirects --J2/P9--> fetched text (S11 status)   [html dropped right after P9]
      --W4/W3/A8--> context in parts --P19/P20--> analysis requests
    replies (J6 table, or U2 model step) --P10-P12--> decoded
      --P15/P16/SO1--> records --F2/A2--> clean clients --A9--> document

Request texts are collected per part, whose size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from ..functions import extract as X, html as H, replies as R, urls
from ..operators import context, udfs
from ..operators.dedupe import keep_first
from ..operators.frontier import frontier
from ..operators.ordinal import ordinal
from ..sources import store as S
from ..functions.text import ustrip
from ..session import staged


def company_inputs(inputs: DataFrame, url_col: str = "input_url") -> DataFrame:
    """Identity and locale of each input URL."""
    c = urls.company_identity(inputs, url_col)
    c = urls.with_locale(c)
    # two URLs of one company are one company: the last one wins, in the order of the URLs
    c = S.latest_per_key(c, ["company_key"], ["url_norm", url_col])
    return c.select(url_col, "url_norm", "netloc", "domain", "tld", "company_key",
                    F.col("language").alias("detected_language"), F.col("country").alias("detected_country"),
                    urls.default_company_name(F.col("domain")).alias("default_name"))


def page_items() -> Column:
    """Candidate names of a page in order -- list items, image texts, the headline's client."""
    html = F.col("html")
    return F.concat(F.transform(H.list_items(html), lambda x: H.strip_tags(x)), H.image_alts(html),
                    F.array(X.headline_client(H.title(html))))


def fetched_pages(companies: DataFrame, candidates: DataFrame, pages: DataFrame, redirects: DataFrame | None = None,
                  fields: dict[str, Column] | None = None) -> DataFrame:
    """A1 -> F9 -> J2/P9: the fetched pages of every company, in the order of ``seq``
    (the fallback page stands alone).

    ``candidates``: ``company_key, url, type, description, seq`` with ``seq`` unique in a
    company; ``fields``: columns over ``html`` to keep, computed where the page is parsed."""
    uniq = keep_first(candidates.filter(F.coalesce(F.col("url") != "", F.lit(False))),
                      ["company_key", "url"], F.col("seq"))
    fb = (companies.select("company_key", F.col("url_norm").alias("url"))
                   .join(uniq.select("company_key"), "company_key", "left_anti")
                   .select("company_key", "url", F.lit("homepage").alias("type"),
                           F.lit("direct input").alias("description"), F.lit(0).cast("long").alias("seq")))
    cands = uniq.select("company_key", "url", "type", "description", "seq").unionByName(fb)
    return context.fetch(cands, pages, company="company_key", redirects=redirects, fields=fields)


def discovery_results(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What discovery replies (``company_key, reply_id, chunk, reply``) say.

    Returns the companies' names and descriptions (first chunk that has one) and the
    candidates, numbered over all replies of a company by (chunk, reply_id, place in the reply).
    (reply_id, chunk) names a reply; without a ``reply_id`` a company has one per chunk.  A reply that
    does not decode gives neither: its company keeps its default name and its own URL as the only page (F9)."""
    if "reply_id" not in replies.columns:
        replies = replies.withColumn("reply_id", F.lit(""))
    d = replies.withColumn("_r", F.from_json(R.first_json_object(F.col("reply")), schemas.DISCOVERY_REPLY))
    place = F.struct("chunk", "reply_id")
    said = d.groupBy("company_key").agg(
        *[F.min_by(F.col(f"_r.{c}"), F.when(F.col(f"_r.{c}") != "", place)).alias(c) for c in ("company_name", "company_description")])
    x = d.select("company_key", "chunk", "reply_id", F.posexplode("_r.pages").alias("i", "c"))
    x = x.select("company_key", "chunk", "reply_id", "i", *R.candidate_defaults(F.col("c")))
    cands = ordinal(x, ["company_key"], [F.col("chunk"), F.col("reply_id"), F.col("i")], "seq")
    return said, cands.select("company_key", "url", "type", "description", "seq")


def with_linked_pages(candidates: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """The candidates and then every page that links of the site (``frontier.site_links``) reach
    from them, by hops; ``seq`` goes on where the candidates end."""
    found = frontier(candidates, links, max_rounds).filter(F.col("hop") > 0)
    none = F.lit(None).cast("string")
    old = candidates.select("company_key", "url", "type", "description", F.lit(0).cast("long").alias("hop"), F.col("seq").alias("n"), none.alias("at"))
    new = found.select("company_key", "url", urls.page_type(F.col("url")).alias("type"), F.concat(F.lit("link on "), "via_url").alias("description"),
                       "hop", F.lit(0).cast("long").alias("n"), F.col("url").alias("at"))
    both = ordinal(old.unionByName(new), ["company_key"], [F.col("hop"), F.col("n"), F.col("at")], "seq")
    return both.select("company_key", "url", "type", "description", "seq")


def page_parts(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that were fetched, and their pieces by part of the request text."""
    ok = fetched.filter(F.col("status") == "ok").withColumn("url", F.col("final_url"))
    return ok, context.context_blocks(ok, company="company_key", order="seq")


def request_id(company: Column, part: Column) -> Column:
    return F.concat_ws("#", company, part.cast("string"))


def analysis_requests(companies: DataFrame, fetched: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One analysis request per part of a company's fetched text."""
    ok, blocks = parts or page_parts(fetched)
    ctx = context.context_text(ok, blocks, company="company_key", order="seq")
    n_ok = ok.groupBy("company_key").agg(F.count(F.lit(1)).alias("n_fetched"))
    j = ctx.join(n_ok, "company_key").join(companies.select("company_key", "default_name", "domain"), "company_key")
    prompt = R.analysis_prompt(F.col("default_name"), F.col("domain"), F.col("n_fetched"), F.col("context"))
    return j.select(request_id(F.col("company_key"), F.col("part")).alias("request_id"),
                    "company_key", "part",
                    R.request_body(prompt, schemas.ANALYSIS_MAX_TOKENS, False).alias("body"))


def rule_based_replies(fetched: DataFrame, blocks: DataFrame) -> DataFrame:
    """Offline stand-in for the analysis model (X3-X10): candidate names from
    list items, logo alts and headlines of each company's fetched pages (``page_items`` as
    column ``items``), normalised, split into clients and vendors, stop words and the own
    name removed, with an evidence sentence; emitted as the JSON replies a
    model would give (so the decode path is the same), one per request: a page
    answers in the part where its block starts, and a part without a name answers with
    empty lists."""
    first = blocks.where(F.col("piece_from") == 1).select("company_key", "seq", "part")
    j = (fetched.filter(F.col("status") == "ok").select("company_key", "seq", "type", "text", "items")
                .join(first, ["company_key", "seq"]))
    items = F.col("items")
    c = (j.select("company_key", "part", "seq", "type", "text", F.posexplode(items).alias("i", "raw"))
          .withColumn("name", X.normalize_name(F.col("raw")))
          .filter(F.col("name").isNotNull() & (F.col("name") != "") & ~X.is_stop_name(F.col("name"))))
    c = c.filter(F.lower(F.col("name")) != F.lower(urls.default_company_name(F.col("company_key"))))
    c = c.withColumn("vendor", X.is_tech_vendor(F.col("name")))
    src = (F.when(F.col("type").isin("case_study", "case_studies_index"), "case_study")
            .when(F.col("type") == "testimonials", "testimonial").when(F.col("type") == "blog_post", "blog")
            .when(F.col("type") == "job_listing", "job_listing").otherwise("reference_list"))
    client = F.struct(F.col("name"), F.lit("").alias("industry"), F.lit("").alias("country"),
                      src.alias("source_type"),
                      F.coalesce(X.evidence_sentence(F.col("text"), F.col("name")), F.lit("")).alias("evidence"))
    partner = F.struct(F.col("name"), F.lit("technology partner").alias("role"))
    order = F.struct("seq", "i")
    g = c.groupBy("company_key", "part").agg(
        F.array_sort(F.collect_list(F.when(~F.col("vendor"), F.struct(order.alias("o"), client.alias("c"))))).alias("cl"),
        F.array_sort(F.collect_list(F.when(F.col("vendor"), F.struct(order.alias("o"), partner.alias("p"))))).alias("pl"))
    g = blocks.select("company_key", "part").distinct().join(g, ["company_key", "part"], "left")
    none = F.array()
    doc = F.struct(F.coalesce(F.transform("cl", lambda x: x["c"]), none).alias("clients"),
                   F.coalesce(F.transform("pl", lambda x: x["p"]), none).alias("technology_partners"))
    reply = F.concat(F.lit("```json\n"), F.to_json(doc), F.lit("\n```"))
    env = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), reply.alias("text"))).alias("content")))
    return g.select(request_id(F.col("company_key"), F.col("part")).alias("reply_id"), F.lit(200).alias("http_status"), env.alias("body"))


def decode_results(replies: DataFrame, strict_null: bool = False) -> tuple[DataFrame, DataFrame]:
    """P13/P14/P10-P12 -> P15/P16 -> SO1 -> F2 -> A2: clean client rows per
    company plus the company's error.  ``replies``: request_id, http_status,
    reply_body, and where a company has several parts company_key and part; without
    them the request is the company.  ``request_id`` of both results is the company.

    Q8: a name that is JSON null or not a string drops its row and is
    counted in ``n_bad_names``; ``strict_null=True`` instead fails the whole
    reply, as the reference does (its ``.strip()`` raises)."""
    api_err = R.reply_error(F.col("http_status"), F.col("reply_body"))
    text = F.when(api_err.isNull(), R.reply_text(F.col("reply_body")))
    obj = R.first_json_object(text)
    v = R.decode(obj)
    if "company_key" not in replies.columns:
        replies = replies.withColumn("company_key", F.col("request_id")).withColumn("part", F.lit(0).cast("long"))
    replies = replies.withColumn("request_id", F.col("company_key"))
    d = (replies.withColumn("api_error", api_err).withColumn("_obj", obj).withColumn("_v", v)
                .withColumn("error", F.coalesce(F.col("api_error"), R.parse_error(F.col("_obj"), F.col("_v")))))

    def items(key: str, section: int) -> DataFrame:
        arr = F.try_variant_get(F.col("_v"), f"$.{key}", "array<variant>")
        raw = F.variant_get(F.col("item"), "$.name", "variant")
        return (d.filter(F.col("error").isNull())
                 .select("request_id", "part", F.posexplode_outer(arr).alias("pos", "item"))
                 .filter(F.col("item").isNotNull())
                 .withColumn("section", F.lit(section))
                 .withColumn("bad_name", F.coalesce(raw.isNotNull() & (F.schema_of_variant(raw) != "STRING"),
                                                    F.lit(False))))

    it = F.col("item")
    ci, pi = items("clients", 0), items("technology_partners", 1)
    bad = (ci.select("request_id", "bad_name").unionByName(pi.select("request_id", "bad_name"))
             .groupBy("request_id").agg(F.count_if("bad_name").cast("long").alias("n_bad_names")))
    cl = ci.filter(~F.col("bad_name")).select(
        "request_id", "section", "part", "pos",
        ustrip(R.get_or_default(it, "name", "")).alias("name"),
        R.get_or_default(it, "industry", "").alias("industry"),
        R.get_or_default(it, "country", "").alias("country"),
        R.get_or_default(it, "source_type", schemas.DEFAULT_CLIENT_SOURCE).alias("source"),
        R.get_or_default(it, "evidence", "").alias("ai_note"),
        R.get_or_default(it, "confidence", schemas.DEFAULT_CONFIDENCE, "bigint").alias("confidence"))
    pt = pi.filter(~F.col("bad_name")).select(
        "request_id", "section", "part", "pos",
        ustrip(R.get_or_default(it, "name", "")).alias("name"),
        F.lit(schemas.PARTNER_INDUSTRY).alias("industry"), F.lit("").alias("country"),
        F.lit(schemas.PARTNER_SOURCE).alias("source"),
        R.get_or_default(it, "role", "").alias("ai_note"),
        F.lit(schemas.PARTNER_CONFIDENCE).cast("long").alias("confidence"))
    recs = cl.unionByName(pt).filter(F.col("name") != "")        # F2
    errors = (d.groupBy("request_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"))
               .join(bad, "request_id", "left")
               .withColumn("n_bad_names", F.coalesce("n_bad_names", F.lit(0)).cast("long")))
    if strict_null:
        errors = errors.withColumn("error", F.coalesce(
            "error", F.when(F.col("n_bad_names") > 0, F.lit("client name is not a string"))))
        recs = recs.join(errors.filter(F.col("n_bad_names") > 0).select("request_id"), "request_id", "left_anti")
    clean = keep_first(recs.withColumn("name_key", F.lower("name")), ["request_id", "name_key"],
                       F.struct("section", "part", "pos"))
    return clean, errors


PART_ROWS = 1000  # clients, and sources, in one part of a company's document


def build_documents(companies: DataFrame, fetched: DataFrame, clean: DataFrame, errors: DataFrame,
                    scraped_at: str, said: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The company document, for each input company (company_key, part, n_parts,
    document, n_bad_names); name and description come from the discovery (``said``) where it gave them.

    A company's clients and sources are numbered by the skew-safe ordinal and laid into parts
    of ``part_rows`` each, so no group grows with a company; a company with no more than
    that has part 0 only.  Every part repeats the head of the document.

    Zero fetched pages -> empty clients and no error (Q6); a failed
    analysis -> empty clients with the error."""
    def part_of(n: str) -> Column:
        return F.floor((F.col(n) - 1) / F.lit(part_rows)).cast("long")

    ok = fetched.filter(F.col("status") == "ok").select("company_key", "seq", "final_url")
    src = (ordinal(ok, ["company_key"], [F.col("seq")], "n").groupBy("company_key", part_of("n").alias("part"))
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "final_url"))), lambda x: x["final_url"]).alias("sources_checked")))
    rec = F.struct("name", "industry", "country", "source", "ai_note", "confidence")
    rows = clean.select(F.col("request_id").alias("company_key"), F.struct("section", "part", "pos").alias("o"), rec.alias("c"))
    cl = (ordinal(rows, ["company_key"], [F.col("o")], "n").groupBy("company_key", part_of("n").alias("part"))
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("clients")))
    first = companies.select("company_key", F.lit(0).cast("long").alias("part"))
    parts = first.unionByName(src.select("company_key", "part")).unionByName(cl.select("company_key", "part")).distinct()
    n_parts = parts.groupBy("company_key").agg((F.max("part") + 1).alias("n_parts"))
    err = errors.select(F.col("request_id").alias("company_key"), "error", "n_bad_names")
    has = src.filter(F.col("part") == 0).select("company_key", F.lit(True).alias("has_sources"))
    head = companies.join(n_parts, "company_key").join(err, "company_key", "left").join(has, "company_key", "left")
    none = F.lit(None).cast("string")
    head = head.join(said, "company_key", "left") if said is not None else head.withColumn("company_name", none).withColumn("company_description", none)
    j = parts.join(head, "company_key").join(src, ["company_key", "part"], "left").join(cl, ["company_key", "part"], "left")
    empty_clients = F.array().cast(schemas.COMPANY_DOCUMENT["clients"].dataType)
    doc = F.struct(
        F.col("company_key").alias("key"),
        F.coalesce("company_name", "default_name").alias("company_name"),
        F.col("domain").alias("company_domain"),
        F.coalesce("company_description", F.lit("")).alias("company_description"),
        F.col("detected_language"), F.col("detected_country"),
        F.coalesce(F.col("clients"), empty_clients).alias("clients"),
        F.coalesce(F.col("sources_checked"), F.array().cast("array<string>")).alias("sources_checked"),
        F.lit(scraped_at).alias("scraped_at"),
        F.lit(True).alias("ai_cleaned"),
        F.when(F.col("has_sources"), F.col("error")).alias("error"))
    return j.select("company_key", "part", "n_parts", doc.alias("document"),
                    F.coalesce("n_bad_names", F.lit(0)).cast("long").alias("n_bad_names"))


def build_repository(inputs: DataFrame, candidates: DataFrame, pages: DataFrame,
                     replies: DataFrame | None, scraped_at: str, strict_null: bool = False,
                     said: DataFrame | None = None, redirects: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """E1.  ``inputs``: input_url; ``candidates``: company_key, url, type,
    description, seq; ``said``: company_key, company_name, company_description
    (both as ``discovery_results`` gives them); ``replies``: request_id, http_status,
    reply_body (None = the offline rule-based step); ``redirects``: from_url, to_url."""
    comps = company_inputs(inputs)
    # Materialisation point (the fetched-pages table): several consumers read it, each its
    # columns (only two need the texts), and a table in the shared ``spark.checkpoint.dir``
    # cuts the lineage, so a lost executor re-reads it instead of
    # re-fetching and re-parsing.  The rules' names are taken in the pass that parses the page.
    fields = {"items": page_items()} if replies is None else None
    fetched = staged(fetched_pages(comps, candidates, pages, redirects, fields), "fetched")
    if replies is None:
        ok, blocks = page_parts(fetched)
        reqs = analysis_requests(comps, fetched, (ok, blocks))
        replies = udfs.replies_from_table(reqs, rule_based_replies(fetched, blocks)).drop("has_reply")
        replies = replies.join(reqs.select("request_id", "company_key", "part"), "request_id")
        # second materialisation point (the replies table; one row per request),
        # read by the record, error and bad-name branches of the decode
        replies = staged(replies, "replies")
    clean, errors = decode_results(replies, strict_null)
    return build_documents(comps, fetched, clean, errors, scraped_at, said, part_rows)


def apply_results(repo: DataFrame, results: DataFrame, stamp: str, on_error: str = "overwrite") -> DataFrame:
    """E2 (S5 + Q7): upsert result documents into the repository with
    last write wins per (email, company_key, part); parts that a company no longer has
    are deleted.  Without ``part`` and ``n_parts`` rows are part 0 of 1.  ``on_error='keep'`` does not let
    an error result replace an existing good row (the reference overwrites)."""
    def parted(df: DataFrame, **missing: int) -> DataFrame:
        return df.withColumns({c: F.lit(v).cast("long") for c, v in missing.items() if c not in df.columns})
    repo, results = parted(repo, part=0), parted(results, part=0, n_parts=1)
    key = ["email", "company_key"]
    new = results.select(*key, "part", "n_parts", F.to_json("document").alias("data"),
                         F.col("document.error").isNotNull().alias("_is_error"))
    if on_error == "keep":
        blocked = new.filter("_is_error").join(repo.select(*key), key, "left_semi")
        new = new.join(blocked.select(*key), key, "left_anti")
    gone = (repo.filter(F.col("part") > 0).select(*key, "part").join(new.select(*key, "n_parts").distinct(), key)
                .filter(F.col("part") >= F.col("n_parts")).select(*key, "part", F.lit(None).cast("string").alias("data"), F.lit("delete").alias("op")))
    log = new.select(*key, "part", "data", F.lit("upsert").alias("op")).unionByName(gone)
    log = log.withColumns({"updated_at": F.lit(stamp).cast("timestamp_ntz"), "seq": F.lit(None).cast("long")})
    return S.apply_log(log, [*key, "part"], ["updated_at", "seq"], repo.select(*key, "part", "data", "updated_at", "seq"))


def repository_export(repo: DataFrame, chunk_size: int = 1000) -> DataFrame:
    """A10: ``{company_key: document}`` per tenant, as JSON, for export.

    A tenant may own a third of the repository, so its map is cut into
    chunks of ``chunk_size`` companies (skew-safe numbering by key).  A row
    whose document is not valid JSON is left out of the map and counted in
    ``n_quarantined``."""
    n = ordinal(repo, ["email"], [F.col("company_key")], "_n")
    good = F.try_parse_json("data").isNotNull()
    g = (n.withColumn("chunk", F.floor((F.col("_n") - 1) / F.lit(chunk_size)).cast("long"))
          .groupBy("email", "chunk")
          # entries sorted by key (as strings), then parsed: deterministic JSON text
          .agg(F.map_from_entries(F.transform(
                   F.array_sort(F.collect_list(F.when(good, F.struct("company_key", "data")))),
                   lambda x: F.struct(x["company_key"], F.try_parse_json(x["data"])))).alias("m"),
               F.count_if(good).alias("n_companies"), F.count_if(~good).alias("n_quarantined")))
    return g.select("email", "chunk", "n_companies", "n_quarantined", F.to_json("m").alias("export"))
