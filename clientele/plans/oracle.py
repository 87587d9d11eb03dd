"""DuckDB oracle SQL, one statement per registered query.

Only the base tables exist on the DuckDB side, so the derived views are
inlined as CTEs.  Integers are cast to BIGINT so types line up with Spark.
"""

from __future__ import annotations

# Unicode strip, same class as functions.text.STRIP_PATTERN
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = rf"^{WS}+|{WS}+$"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def ckey(netloc: str) -> str:
    return f"regexp_replace(ltrim({netloc}, 'w.'), '[^a-z0-9.-]', '', 'g')"


CLIENT_ROWS = """client_rows AS (
SELECT s.s_suppkey AS company_id,
  concat('www.', CASE WHEN s.s_suppkey % 5 = 0 THEN 'w' ELSE '' END, 'supplier-', s.s_suppkey, '.',
    CASE s.s_suppkey % 6 WHEN 0 THEN 'si' WHEN 1 THEN 'de' WHEN 2 THEN 'at' WHEN 3 THEN 'br' WHEN 4 THEN 'uk' ELSE 'com' END) AS netloc,
  concat('user', s.s_suppkey % 10, '@example.com') AS email,
  CASE WHEN l.l_partkey % 41 = 0 THEN '   ' WHEN l.l_partkey % 3 = 0 THEN upper(c.c_name)
       WHEN l.l_partkey % 3 = 1 THEN concat('  ', c.c_name, ' ') ELSE c.c_name END AS name,
  CASE WHEN l.l_quantity < 5 THEN '' ELSE c.c_mktsegment END AS industry,
  CASE WHEN l.l_quantity > 45 THEN '' ELSE n.n_name END AS country,
  CASE l.l_linenumber WHEN 1 THEN 'case_study' WHEN 2 THEN 'reference_list' WHEN 3 THEN 'logo' WHEN 4 THEN 'testimonial'
       WHEN 5 THEN 'blog' WHEN 6 THEN 'job_listing' ELSE 'technology_partner' END AS source_type,
  concat(p.p_name, ' (', p.p_brand, ') delivered for ', c.c_name) AS evidence,
  CASE WHEN l.l_quantity = 1 THEN NULL ELSE CAST(l.l_quantity AS INT) + 50 END AS confidence,
  row_number() OVER (PARTITION BY l.l_suppkey ORDER BY CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END,
     l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate) AS pos
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

COMPANY_ROWS = """company_rows AS (
SELECT s_suppkey AS company_id, concat('www.', CASE WHEN s_suppkey % 5 = 0 THEN 'w' ELSE '' END, 'supplier-', s_suppkey, '.',
    CASE s_suppkey % 6 WHEN 0 THEN 'si' WHEN 1 THEN 'de' WHEN 2 THEN 'at' WHEN 3 THEN 'br' WHEN 4 THEN 'uk' ELSE 'com' END) AS netloc,
  concat('user', s_suppkey % 10, '@example.com') AS email FROM supplier
UNION ALL
SELECT s_suppkey, concat('www.idle-', s_suppkey, '.si'), concat('user', s_suppkey % 10, '@example.com') FROM supplier WHERE s_suppkey % 7 = 0
)"""

UPSERT_LOG = """upsert_log AS (
SELECT event_id AS seq, concat('user', user_id % 15, '@example.com') AS email, concat('co-', user_id, '.si') AS company_key,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS data, ts AS updated_at FROM events
)"""

PAGE_CANDIDATES = """page_candidates AS (
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc, CASE WHEN k.k = 2 THEN concat('mailto:x', page_id) ELSE url END AS url,
  CASE page_id % 8 WHEN 0 THEN 'homepage' WHEN 1 THEN 'case_studies_index' WHEN 2 THEN 'case_study' WHEN 3 THEN 'reference_list'
       WHEN 4 THEN 'testimonials' WHEN 5 THEN 'blog_post' WHEN 6 THEN 'job_listing' ELSE 'partners' END AS type,
  page_id * 3 + k.k AS seq
FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k
WHERE k.k = 0 OR (k.k = 1 AND page_id % 7 = 0) OR (k.k = 2 AND page_id % 11 = 0)
)"""

DOC_PAGES = """doc_pages AS (
SELECT source AS company_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq,
  concat('https://', source, '.example.com/', doc_id) AS url, lang AS type, text FROM documents
)"""

MODEL_REPLIES = """model_replies AS (
SELECT c_custkey AS reply_id, CASE WHEN c_custkey % 13 = 0 THEN 'no json here'
  WHEN c_custkey % 13 = 1 THEN concat('{"name":"', c_name, '","confidence":')
  ELSE concat('Result: ```json', chr(10), '{"name":"', c_name, '"', CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ',"confidence":null' ELSE ',"confidence":95' END,
    ',"industry":"', c_mktsegment, '"}', chr(10), '```') END AS reply FROM customer
)"""

# Raw mentions -> records (clients and partners) -> blank drop.
RECS = f"""recs AS (
SELECT email, {ckey('netloc')} AS company_key, ltrim(netloc, 'w.') AS domain,
  {ustrip('name')} AS name,
  CASE WHEN source_type = 'technology_partner' THEN 'Technology vendor' ELSE coalesce(industry, '') END AS industry,
  CASE WHEN source_type = 'technology_partner' THEN '' ELSE coalesce(country, '') END AS country,
  CASE WHEN source_type = 'technology_partner' THEN 'technology_partner' ELSE coalesce(source_type, 'reference_list') END AS source,
  coalesce(evidence, '') AS ai_note,
  CAST(CASE WHEN source_type = 'technology_partner' THEN 99 ELSE coalesce(confidence, 80) END AS BIGINT) AS confidence,
  source_type = 'technology_partner' AS is_partner,
  pos
FROM client_rows
), nonblank AS (SELECT * FROM recs WHERE name <> '')"""

# Keep-first dedupe on lower(name) inside a company.
CLEAN = """clean AS (
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY email, company_key, lower(name) ORDER BY pos) AS rn FROM nonblank)
WHERE rn = 1
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


KEYS = f"""company_keys AS (SELECT DISTINCT email, {ckey('netloc')} AS company_key FROM company_rows)"""

COMPANY_COUNTS = COMPANY_ROWS + ",\n" + KEYS + """, counts AS (
SELECT k.email, k.company_key, count(*) FILTER (WHERE NOT is_partner) AS n_real,
  count(*) FILTER (WHERE is_partner) AS n_partners, count(is_partner) AS n_total
FROM company_keys k LEFT JOIN clean c USING (email, company_key) GROUP BY ALL
)"""

SQL: dict[str, str] = {}

SQL["companies_ranked"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_COUNTS, body="""
SELECT email, company_key, n_real, n_partners, n_total,
  row_number() OVER (PARTITION BY email ORDER BY n_real DESC, company_key ASC) AS rank
FROM counts""")

SQL["top_companies"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_COUNTS, body="""
SELECT * FROM (
  SELECT email, company_key, n_real, n_partners, n_total,
    row_number() OVER (PARTITION BY email ORDER BY n_real DESC, company_key ASC) AS rank
  FROM counts) WHERE rank <= 3""")

REC_COLS = "email, company_key, CAST(pos AS BIGINT) AS pos, name, industry, country, source, ai_note, confidence"

SQL["client_records"] = with_ctes(CLIENT_ROWS, RECS, body=f"""
SELECT {REC_COLS} FROM nonblank WHERE source <> 'technology_partner'""")

SQL["partner_records"] = with_ctes(CLIENT_ROWS, RECS, body=f"""
SELECT {REC_COLS} FROM nonblank WHERE source = 'technology_partner'""")

SQL["clients_union"] = with_ctes(CLIENT_ROWS, RECS, body="""
SELECT email, company_key, CAST(CASE WHEN source = 'technology_partner' THEN 1 ELSE 0 END AS BIGINT) AS section,
  CAST(pos AS BIGINT) AS pos, name, source FROM nonblank""")

SQL["clients_dedupe"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body="""
SELECT email, company_key, name, source, CAST(pos AS BIGINT) AS pos FROM clean""")

SQL["company_documents"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body="""
SELECT email, company_key, chunk, CAST(count(*) AS BIGINT) AS n_clients,
  to_json({'key': company_key, 'chunk': chunk,
           'clients': list({'name': name, 'industry': industry, 'country': country, 'source': source,
                            'ai_note': ai_note, 'confidence': confidence} ORDER BY pos)})::VARCHAR AS document
FROM (SELECT *, CAST((pos - 1) // 1000 AS BIGINT) AS chunk FROM clean)
GROUP BY email, company_key, chunk""")

SQL["real_partner_split"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_COUNTS, body="""
SELECT email, company_key, n_real, n_partners,
  format('Extracted {} clients + {} technology partners', n_real, n_partners) AS summary FROM counts""")

BADGE_LABEL = """CASE WHEN source = 'technology_partner' THEN 'Tech Partner' WHEN source = 'case_study' THEN 'Case Study'
  WHEN source IN ('reference_list', 'reference') THEN 'Reference' WHEN source = 'logo' THEN 'Logo'
  WHEN source = 'testimonial' THEN 'Testimonial' WHEN source = 'blog' THEN 'Blog'
  WHEN source = 'job_listing' THEN 'Job Listing' ELSE coalesce(nullif(source, ''), 'reference') END"""

SQL["source_badges"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT email, company_key, label, n,
  concat(n, ' ', label, CASE WHEN n > 1 THEN 's' ELSE '' END) AS badge,
  row_number() OVER (PARTITION BY email, company_key ORDER BY n DESC, first_pos ASC) AS badge_rank
FROM (SELECT email, company_key, {BADGE_LABEL} AS label, count(*) AS n, min(pos) AS first_pos
      FROM clean GROUP BY ALL)""")

TAG_LABEL = """coalesce(CASE source WHEN 'case_study' THEN 'Case Study' WHEN 'reference_list' THEN 'Reference'
  WHEN 'reference' THEN 'Reference' WHEN 'logo' THEN 'Logo' WHEN 'testimonial' THEN 'Testimonial' WHEN 'blog' THEN 'Blog'
  WHEN 'job_listing' THEN 'Job Listing' WHEN 'technology_partner' THEN 'Tech Partner' END, nullif(source, ''), 'Reference')"""

SQL["source_tags"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT source, count(*) AS n, {TAG_LABEL} AS tag FROM clean GROUP BY source""")

SQL["industry_country_counts"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_ROWS, KEYS, body="""
SELECT email, company_key, count(DISTINCT nullif(industry, '')) AS n_industries,
  count(DISTINCT nullif(country, '')) AS n_countries, count(DISTINCT nullif(country, '')) > 0 AS show_countries
FROM company_keys LEFT JOIN (SELECT * FROM clean WHERE NOT is_partner) USING (email, company_key) GROUP BY email, company_key""")

SQL["repo_totals"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_ROWS, KEYS, body="""
SELECT email, n_companies, n_clients, format('{} companies, {} clients', n_companies, n_clients) AS summary
FROM (SELECT email, count(DISTINCT company_key) AS n_companies,
        count(DISTINCT CASE WHEN NOT is_partner THEN lower(name) END) AS n_clients
      FROM company_keys LEFT JOIN clean USING (email, company_key) GROUP BY email)""")


def _has(col: str, q: str) -> str:
    return f"contains(lower(coalesce({col}, '')), '{q}')"


CLIENT_Q = "building"
_HIT = " OR ".join(_has(c, CLIENT_Q) for c in ("name", "industry", "country", "ai_note"))

SQL["client_search"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT email, company_key, n_match, n_match_partners, n_total, format('{{}} of {{}} clients', n_match, n_total) AS caption
FROM (SELECT email, company_key, count(*) FILTER (WHERE ({_HIT}) AND NOT is_partner) AS n_match,
        count(*) FILTER (WHERE ({_HIT}) AND is_partner) AS n_match_partners,
        count(*) FILTER (WHERE NOT is_partner) AS n_total FROM clean GROUP BY email, company_key)""")

SQL["client_table"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT email, company_key, is_partner,
  row_number() OVER (PARTITION BY email, company_key, is_partner ORDER BY pos) AS row_no,
  name, industry, country, {TAG_LABEL} AS tag,
  concat(substring(coalesce(ai_note, ''), 1, 100), CASE WHEN length(coalesce(ai_note, '')) > 100 THEN '...' ELSE '' END) AS note_preview
FROM clean""")

SQL["client_table_search"] = SQL["client_table"] + f" WHERE {_HIT}"

# ---------------------------------------------------------------------------
# Company level
# ---------------------------------------------------------------------------
from .. import schemas  # noqa: E402


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda t: concat(upper(left(t, 1)), lower(substr(t, 2)))), '')")


def default_name(domain: str, dash_to_space: bool = True) -> str:
    first = f"string_split({domain}, '.')[1]"
    if dash_to_space:
        first = f"replace({first}, '-', ' ')"
    return title_case(first)


def tld(domain: str) -> str:
    return f"lower(string_split({domain}, '.')[-1])"


def _values(d: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in sorted(d.items()))


LOCALE = f"""lang_map(tld, map_language) AS (VALUES {_values(schemas.TLD_LANGUAGE)}),
country_map(tld, map_country) AS (VALUES {_values(schemas.TLD_COUNTRY)})"""

COMPANIES = COMPANY_ROWS + f""", companies AS (
SELECT c.email, c.company_key, c.domain, {default_name('c.domain')} AS company_name,
  coalesce(l.map_language, 'english') AS detected_language, coalesce(m.map_country, '') AS detected_country
FROM (SELECT DISTINCT email, {ckey('netloc')} AS company_key, ltrim(netloc, 'w.') AS domain FROM company_rows) c
LEFT JOIN lang_map l ON l.tld = {tld('c.domain')} LEFT JOIN country_map m ON m.tld = {tld('c.domain')}
)"""

DOMAINS = COMPANY_ROWS + f""", domains AS (
SELECT DISTINCT ltrim(regexp_extract(CASE WHEN regexp_matches({ustrip('url')}, '^https?://') THEN {ustrip('url')}
    ELSE concat('https://', {ustrip('url')}) END, '^https?://([^/?#]*)', 1), 'w.') AS domain FROM pages
UNION SELECT DISTINCT ltrim(netloc, 'w.') FROM company_rows
)"""

SQL["url_parts"] = with_ctes(COMPANY_ROWS, f"""u AS (
SELECT concat('page-', page_id) AS id, url AS raw FROM pages
UNION ALL SELECT concat('company-', company_id), netloc FROM company_rows
), n AS (
SELECT id, CASE WHEN regexp_matches(s, '^https?://') THEN s ELSE concat('https://', s) END AS url_norm
FROM (SELECT id, {ustrip('raw')} AS s FROM u)
), h AS (SELECT *, regexp_extract(url_norm, '^https?://([^/?#]*)', 1) AS netloc FROM n),
d AS (SELECT *, ltrim(netloc, 'w.') AS domain FROM h)""", body=f"""
SELECT id, url_norm, netloc, domain, {tld('domain')} AS tld, regexp_replace(domain, '[^a-z0-9.-]', '', 'g') AS company_key FROM d""")

SQL["company_names"] = with_ctes(DOMAINS, body=f"""
SELECT domain, {default_name('domain')} AS company_name, {default_name('domain', False)} AS company_name_nokey FROM domains""")

SQL["locale_lookup"] = with_ctes(DOMAINS, LOCALE, body=f"""
SELECT d.domain, {tld('d.domain')} AS tld, coalesce(l.map_language, 'english') AS language,
  coalesce(m.map_country, '') AS country
FROM domains d LEFT JOIN lang_map l ON l.tld = {tld('d.domain')} LEFT JOIN country_map m ON m.tld = {tld('d.domain')}""")

SQL["tenant_key"] = with_ctes(UPSERT_LOG, body=f"""
SELECT lower({ustrip('email')}) AS tenant, count(*) AS n_rows, count(DISTINCT company_key) AS n_companies
FROM upsert_log GROUP BY 1""")

SQL["facets"] = with_ctes(LOCALE, COMPANIES, body="""
SELECT DISTINCT email, detected_country AS facet FROM companies WHERE detected_country <> ''
UNION SELECT DISTINCT email, 'all' FROM companies""")

SQL["facet_filter"] = with_ctes(LOCALE, COMPANIES, body="""
SELECT email, company_key, company_name, detected_country FROM companies WHERE detected_country = 'Germany'""")

COMPANY_Q = "customer#000000123"
SEARCH = f"""hits AS (
SELECT * FROM companies c WHERE contains(lower(c.company_name), '{COMPANY_Q}')
  OR EXISTS (SELECT 1 FROM clean k WHERE k.email = c.email AND k.company_key = c.company_key
             AND contains(lower(k.name), '{COMPANY_Q}'))
)"""

SQL["company_search"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, LOCALE, COMPANIES, SEARCH, body="""
SELECT email, company_key, company_name FROM hits""")

SQL["indexed_company_search"] = SQL["company_search"]

SQL["tenant_sketches"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body="""
SELECT email, count(DISTINCT lower(name)) AS n_clients, count(DISTINCT nullif(industry, '')) AS n_kinds, count(DISTINCT nullif(country, '')) AS n_places,
  true AS names_near, true AS kinds_near, true AS places_near FROM clean WHERE NOT is_partner GROUP BY email""")

SQL["company_search_count"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, LOCALE, COMPANIES, SEARCH, body="""
SELECT email, count(*) AS n_companies FROM hits GROUP BY email""")

SQL["repository_overview"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, LOCALE, COMPANIES, body="""
SELECT c.email, c.company_key, c.company_name,
  coalesce(nullif(c.detected_country, ''), nullif(c.detected_language, ''), '') AS place,
  coalesce(k.n_real, 0) AS n_real,
  row_number() OVER (PARTITION BY c.email ORDER BY coalesce(k.n_real, 0) DESC, c.company_key) AS rank
FROM companies c LEFT JOIN (SELECT email, company_key, count(*) FILTER (WHERE NOT is_partner) AS n_real
                            FROM clean GROUP BY ALL) k USING (email, company_key)""")

SQL["company_detail"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, COMPANY_ROWS, KEYS, f"""badges AS (
SELECT email, company_key, string_agg(badge, ' | ' ORDER BY badge_rank) AS badges FROM (
  SELECT email, company_key, concat(n, ' ', label, CASE WHEN n > 1 THEN 's' ELSE '' END) AS badge,
    row_number() OVER (PARTITION BY email, company_key ORDER BY n DESC, first_pos) AS badge_rank
  FROM (SELECT email, company_key, {BADGE_LABEL} AS label, count(*) AS n, min(pos) AS first_pos
        FROM clean GROUP BY ALL)) GROUP BY ALL
), stats AS (
SELECT email, company_key, count(*) FILTER (WHERE NOT is_partner) AS n_total,
  count(*) FILTER (WHERE NOT is_partner AND ({_HIT})) AS n_match,
  count(DISTINCT CASE WHEN NOT is_partner THEN nullif(industry, '') END) AS n_industries,
  count(DISTINCT CASE WHEN NOT is_partner THEN nullif(country, '') END) AS n_countries
FROM clean GROUP BY ALL
)""", body="""
SELECT k.email, k.company_key, coalesce(b.badges, '') AS badges, coalesce(s.n_total, 0) AS n_total,
  coalesce(s.n_industries, 0) AS n_industries, coalesce(s.n_countries, 0) AS n_countries,
  format('{} of {} clients', coalesce(s.n_match, 0), coalesce(s.n_total, 0)) AS caption
FROM company_keys k LEFT JOIN badges b USING (email, company_key) LEFT JOIN stats s USING (email, company_key)""")

# ---------------------------------------------------------------------------
# Page path
# ---------------------------------------------------------------------------
DEDUPED = """deduped AS (
SELECT netloc, url, type, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY netloc, url ORDER BY seq) AS rn FROM page_candidates
  WHERE coalesce(url <> '', false)) WHERE rn = 1
)"""
CAPPED = """capped AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY netloc ORDER BY seq) AS rank FROM deduped) WHERE rank <= 15
)"""

SQL["url_dedupe"] = with_ctes(PAGE_CANDIDATES, DEDUPED, body="SELECT netloc, url, type, seq FROM deduped")

SQL["page_cap_then_http"] = with_ctes(PAGE_CANDIDATES, DEDUPED, CAPPED, body="""
SELECT netloc, url, type, seq, rank FROM capped WHERE starts_with(url, 'http')""")

SQL["candidate_fallback"] = with_ctes(COMPANY_ROWS, PAGE_CANDIDATES, DEDUPED, body="""
SELECT netloc, url, type, seq, false AS is_fallback FROM deduped
UNION ALL
SELECT netloc, concat('https://', netloc), 'homepage', CAST(0 AS BIGINT), true
FROM (SELECT netloc FROM company_rows UNION SELECT netloc FROM page_candidates)
WHERE netloc NOT IN (SELECT netloc FROM deduped)""")

_DROPPED = ("script", "style", "nav", "footer", "head", "noscript", "svg", "iframe")


def page_text_sql(html: str) -> str:
    s = f"regexp_replace({html}, '(?is)<!--.*?-->|<!doctype[^>]*>', chr(1), 'g')"
    for tag in _DROPPED:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    s = f"regexp_replace({s}, '(?s)</?[a-zA-Z][^>]*>', chr(1), 'g')"
    dec = "p"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
                    ("&amp;", "&")):
        dec = f"replace({dec}, '{ent}', '{ch}')"
    parts = f"list_filter(list_transform(string_split({s}, chr(1)), lambda p: {ustrip(dec)}), lambda p: p <> '')"
    return f"regexp_replace(array_to_string({parts}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"


# the chains step by step, each with the URLs it has seen
REDIRECT_ENDS = """redirects AS (
SELECT p.url AS from_url, t.url AS to_url FROM (
  SELECT *, CASE WHEN page_id % 100 = 80 THEN page_id + 2 WHEN page_id % 100 = 95 THEN page_id WHEN page_id % 100 = 90 THEN -1
                 WHEN page_id % 10 BETWEEN 1 AND 3 OR page_id % 100 BETWEEN 41 AND 75 THEN page_id - 1 END AS to_id FROM pages) p JOIN pages t ON t.page_id = p.to_id
UNION ALL SELECT url, 'https://gone.example.org/' FROM pages WHERE page_id % 100 = 90
), chain AS (
SELECT from_url AS url, to_url AS reached, CAST(1 AS BIGINT) AS hops, [from_url] AS seen, to_url = from_url AS looped FROM redirects
UNION ALL
SELECT c.url, r.to_url, c.hops + 1, list_append(c.seen, c.reached), list_contains(list_append(c.seen, c.reached), r.to_url)
FROM chain c JOIN redirects r ON r.from_url = c.reached WHERE NOT c.looped
), ends AS (
SELECT url, CASE WHEN looped THEN 'loop' WHEN hops > 30 THEN 'redirects' ELSE 'ok' END AS outcome, reached, hops
FROM (SELECT url, arg_max(reached, hops) AS reached, max(hops) AS hops, bool_or(looped) AS looped FROM chain GROUP BY url)
)"""

SQL["redirect_ends"] = with_ctes(REDIRECT_ENDS, body="""
SELECT url, CASE WHEN outcome = 'ok' THEN reached END AS final_url, CASE WHEN outcome <> 'loop' THEN hops END AS hops, outcome FROM ends""")

SQL["fetch_status"] = with_ctes(PAGE_CANDIDATES, DEDUPED, REDIRECT_ENDS, f"""asked AS (
SELECT c.*, CASE WHEN e.outcome <> 'ok' THEN concat('failed(', e.outcome, ')') END AS lost, CASE WHEN e.url IS NULL THEN c.url ELSE e.reached END AS target
FROM deduped c LEFT JOIN ends e ON e.url = c.url AND starts_with(c.url, 'http')
), fetched AS (
SELECT c.netloc, c.seq, c.url, c.type,
  CASE WHEN NOT starts_with(c.url, 'http') THEN 'skipped' WHEN c.lost IS NOT NULL THEN c.lost WHEN p.code >= 400 THEN 'http' WHEN p.url IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN p.code >= 400 THEN p.code END AS http_code,
  CASE WHEN p.code < 400 THEN p.url END AS final_url, CASE WHEN p.code < 400 THEN {page_text_sql('p.html')} END AS text
FROM asked c LEFT JOIN (SELECT *, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 ELSE 200 END AS code FROM pages) p ON c.target = p.url AND starts_with(c.url, 'http') AND c.lost IS NULL
)""", body="SELECT netloc, seq, url, type, status, http_code, final_url, CAST(length(text) AS BIGINT) AS n_chars FROM fetched")

SQL["fetch_status_counts"] = SQL["fetch_status"].replace(
    "SELECT netloc, seq, url, type, status, http_code, final_url, CAST(length(text) AS BIGINT) AS n_chars FROM fetched",
    "SELECT netloc, status, http_code, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars "
    "FROM fetched GROUP BY netloc, status, http_code")

SQL["page_text"] = f"""
SELECT page_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, {page_text_sql('html')} AS text FROM (
  -- what the references and the menu inside a menu of the given pages must read as, written out
  SELECT page_id, replace(html, '<body>', concat('<body>', CASE page_id % 4
    WHEN 0 THEN concat('<p>Café ''Zoo'' – 5', chr(160), '€…</p>') WHEN 1 THEN '<p>a€b ¬it; &lt;i&gt; &amp;amp; &amp;bogus; © 2024 ∳</p>'
    WHEN 3 THEN '<p>Über</p>' ELSE '' END)) AS html FROM pages))"""

BLOCKS = """laid AS (
SELECT *, CAST(sum(block_chars) OVER (PARTITION BY company_key ORDER BY page_no) - block_chars AS BIGINT) AS start_char FROM (
  SELECT *, CAST(length(block) AS BIGINT) AS block_chars FROM (
    SELECT company_key, seq AS page_no, url,
      concat(chr(10), chr(10), repeat('=', 60), chr(10), 'PAGE ', seq, ' | ', url, ' | type: ', type, chr(10),
             repeat('=', 60), chr(10), coalesce(text, '')) AS block
    FROM doc_pages))
), cut AS (
SELECT *, unnest(generate_series(start_char // 35000, (start_char + block_chars - 1) // 35000)) AS part FROM laid
), blocks AS (
SELECT * EXCLUDE (block), substring(block, greatest(part * 35000 - start_char, 0) + 1,
         least(start_char + block_chars, (part + 1) * 35000) - greatest(start_char, part * 35000)) AS piece FROM cut
)"""
CTX = """ctx AS (SELECT company_key, part, count(*) AS n_pages, string_agg(piece, '' ORDER BY page_no) AS context
             FROM blocks GROUP BY company_key, part)"""

SQL["context_blocks"] = with_ctes(DOC_PAGES, BLOCKS, body="""
SELECT company_key, page_no, part, url, block_chars, start_char, CAST(length(piece) AS BIGINT) AS piece_chars FROM blocks""")

SQL["context_text"] = with_ctes(DOC_PAGES, BLOCKS, CTX, body="""
SELECT company_key, part, n_pages, CAST(length(context) AS BIGINT) AS context_chars, context FROM ctx""")

# ---------------------------------------------------------------------------
# Replies and requests
# ---------------------------------------------------------------------------
from ..functions import replies as _R  # noqa: E402


def sq(s: str = "") -> str:
    return "'" + s.replace("'", "''") + "'"


def first_json(x: str) -> str:
    fence = "'```json|```'"
    return f"nullif(regexp_extract({ustrip(f'regexp_replace({x}, {fence}, {sq()}, {sq(chr(103))})')}, '(?s)\\{{.*\\}}', 0), '')"


PARSED = f"""parsed AS (
SELECT reply_id, j, coalesce(json_valid(j), false) AS ok FROM (SELECT reply_id, {first_json('reply')} AS j FROM model_replies)
)"""

PARSE_ERROR = ("CASE WHEN j IS NULL THEN 'No JSON found in response' "
               "WHEN NOT json_valid(j) THEN 'Invalid JSON in response' END")

SQL["reply_json"] = with_ctes(MODEL_REPLIES, PARSED, body=f"""
SELECT reply_id, j AS json_text, ok AS parsed_ok, CASE WHEN ok THEN json_extract_string(j, '$.name') END AS name,
  {PARSE_ERROR} AS error FROM parsed""")


def get_default(key: str, default: str) -> str:
    return f"CASE WHEN json_type(j, '$.{key}') IS NULL THEN {default} ELSE json_extract_string(j, '$.{key}') END"


SQL["reply_defaults"] = with_ctes(MODEL_REPLIES, PARSED, body=f"""
SELECT reply_id, coalesce(json_extract_string(j, '$.name'), '') AS name,
  {get_default('industry', "''")} AS industry, {get_default('country', "''")} AS country,
  {get_default('source_type', "'reference_list'")} AS source,
  CAST(CASE WHEN json_type(j, '$.confidence') IS NULL THEN 80
            ELSE TRY_CAST(json_extract_string(j, '$.confidence') AS BIGINT) END AS BIGINT) AS confidence,
  CASE WHEN json_type(j, '$.confidence') IS NULL THEN 'missing' WHEN json_type(j, '$.confidence') = 'NULL' THEN 'null'
       ELSE 'set' END AS confidence_state
FROM parsed WHERE ok""")

RESPONSES = """responses AS (
SELECT reply_id, http_status, body,
  CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN concat('Model API ', http_status, ': ', substring(body, 1, 300))
       WHEN json_valid(body) AND json_type(body, '$.error') IS NOT NULL
         THEN coalesce(json_extract_string(body, '$.error.message'), 'Model API error') END AS api_error
FROM (SELECT reply_id, CASE WHEN reply_id % 19 = 0 THEN 529 WHEN reply_id % 5 = 0 THEN 201 ELSE 200 END AS http_status,
        CASE WHEN reply_id % 19 = 0 THEN concat('overloaded ', repeat('.', 400))
             WHEN reply_id % 17 = 0 THEN '{"type":"error","error":{"message":"rate limited"}}'
             WHEN reply_id % 23 = 0 THEN '{"type":"error","error":{}}'
             ELSE to_json({'content': [{'type': 'text', 'text': substring(reply, 1, 10)},
                                       {'type': 'tool_use', 'text': NULL},
                                       {'type': 'text', 'text': substring(reply, 11)}]})::VARCHAR END AS body
      FROM model_replies)
), texts AS (
SELECT *, CASE WHEN api_error IS NULL THEN array_to_string(list_transform(list_filter(
    from_json(body, '{"content":[{"type":"VARCHAR","text":"VARCHAR"}]}').content,
    lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), '') END AS text
FROM responses
)"""

SQL["reply_text"] = with_ctes(MODEL_REPLIES, RESPONSES, body="""
SELECT reply_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts WHERE api_error IS NULL""")

SQL["reply_errors"] = with_ctes(MODEL_REPLIES, RESPONSES, f"""p AS (SELECT *, {first_json('text')} AS j FROM texts)""",
                                body=f"""
SELECT reply_id, CASE WHEN api_error IS NOT NULL THEN 'api' ELSE 'parse' END AS stage,
  coalesce(api_error, {PARSE_ERROR}) AS error FROM p WHERE coalesce(api_error, {PARSE_ERROR}) IS NOT NULL""")

SQL["request_reply_join"] = with_ctes(MODEL_REPLIES, RESPONSES, body="""
SELECT c.c_custkey AS request_id, r.reply_id IS NOT NULL AS has_reply, coalesce(r.http_status, 0) AS http_status,
  CASE WHEN r.reply_id IS NULL THEN 'no reply' ELSE r.api_error END AS error
FROM customer c LEFT JOIN responses r ON r.reply_id = c.c_custkey""")


def body_sql(prompt: str, max_tokens: int, use_search: bool) -> str:
    tools = ", 'tools': [{'type': 'web_search', 'name': 'web_search'}]" if use_search else ""
    return (f"to_json({{'model': '{schemas.MODEL_NAME}', 'max_tokens': {max_tokens}, "
            f"'messages': [{{'role': 'user', 'content': {prompt}}}]{tools}}})::VARCHAR")


_DISC = f"printf({sq(_R.DISCOVERY_TEMPLATE)}, concat('https://', netloc), domain, detected_language)"
_ANAL = (f"printf({sq(_R.ANALYSIS_TEMPLATE)}, {default_name(chr(39) + '.example.com' + chr(39))}, "
         "concat(company_key, '.example.com'), CAST(n_fetched AS INTEGER), context)")
_ANAL = _ANAL.replace(default_name("'.example.com'"), default_name("concat(company_key, '.example.com')"))

SQL["request_rows"] = with_ctes(
    LOCALE,
    COMPANIES.replace("SELECT c.email,", "SELECT c.email, c.netloc,").replace(
        "SELECT DISTINCT email, ", "SELECT DISTINCT email, netloc, "),
    DOC_PAGES, BLOCKS,
    CTX, "fetched AS (SELECT company_key, count(*) AS n_fetched FROM doc_pages GROUP BY company_key)",
    f"""reqs AS (
SELECT company_key, CAST(0 AS BIGINT) AS part, 'discovery' AS kind, CAST(4000 AS BIGINT) AS max_tokens, true AS use_search, {_DISC} AS prompt,
  true AS s FROM companies
UNION ALL
SELECT company_key, part, 'analysis', CAST(8000 AS BIGINT), false, {_ANAL}, false FROM ctx JOIN fetched USING (company_key)
)""", body=f"""
SELECT company_key, part, kind, max_tokens, use_search, CAST(length(prompt) AS BIGINT) AS prompt_chars,
  CASE WHEN s THEN {body_sql('prompt', 4000, True)} ELSE {body_sql('prompt', 8000, False)} END AS body FROM reqs""")

# ---------------------------------------------------------------------------
# Store and streaming
# ---------------------------------------------------------------------------
TS = "strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f')"
STATE = """state AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email, company_key ORDER BY updated_at DESC, seq DESC) AS rn
               FROM upsert_log) WHERE rn = 1 AND op <> 'delete'
)"""

SQL["latest_upsert"] = with_ctes(UPSERT_LOG, body=f"""
SELECT email, company_key, data, {TS} AS updated_at, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY email, company_key ORDER BY updated_at DESC, seq DESC) AS rn
  FROM upsert_log WHERE op = 'upsert') WHERE rn = 1""")

SQL["upsert_with_delete"] = with_ctes(UPSERT_LOG, STATE, body=f"""
SELECT email, company_key, data, {TS} AS updated_at, seq FROM state""")

SQL["stream_upsert"] = SQL["upsert_with_delete"]

SQL["insert_if_absent"] = with_ctes(UPSERT_LOG, body="""
SELECT email, company_key, seq, CAST(n - 1 AS BIGINT) AS n_rejected FROM (
  SELECT *, row_number() OVER (PARTITION BY email, company_key ORDER BY updated_at, seq) AS rn,
         count(*) OVER (PARTITION BY email, company_key) AS n
  FROM upsert_log WHERE op = 'upsert' AND updated_at >= TIMESTAMP '2024-01-02 00:00:00') u
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM upsert_log d WHERE d.op = 'upsert' AND d.updated_at < TIMESTAMP '2024-01-02 00:00:00'
                             AND d.email = u.email AND d.company_key = u.company_key)""")

SQL["tenant_scan"] = with_ctes(UPSERT_LOG, STATE, body="""
SELECT company_key, data FROM state WHERE email = 'user3@example.com'""")

SQL["point_lookup"] = with_ctes(UPSERT_LOG, STATE, body="""
SELECT l.seq AS lookup_id, l.email, l.company_key, s.data, s.data IS NOT NULL AS found
FROM upsert_log l LEFT JOIN state s USING (email, company_key) WHERE l.op = 'delete'""")

SQL["settings_upsert"] = with_ctes(UPSERT_LOG, body="""
SELECT email, name, value FROM (
  SELECT l.email, e.event_type AS name, l.data AS value,
         row_number() OVER (PARTITION BY l.email, e.event_type ORDER BY l.seq DESC) AS rn
  FROM upsert_log l JOIN events e ON e.event_id = l.seq) WHERE rn = 1""")

SQL["contract_check"] = with_ctes(UPSERT_LOG, STATE, CLIENT_ROWS, body="""
SELECT 'null_email' AS "check", count(*) FILTER (WHERE email IS NULL) AS n FROM state
UNION ALL SELECT 'null_company_key', count(*) FILTER (WHERE company_key IS NULL) FROM state
UNION ALL SELECT 'null_data', count(*) FILTER (WHERE data IS NULL) FROM state
UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (
  SELECT count(*) AS c FROM state GROUP BY email, company_key HAVING count(*) > 1)
UNION ALL SELECT 'bad_source', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 97 = 0)
UNION ALL SELECT 'null_confidence', count(*) FILTER (WHERE confidence IS NULL) FROM client_rows""")

# arrivals by time; a key's state goes after the first arrival (with its closing batch) whose latest time, less
# the delay, has reached the kept row's time plus the delay
SQL["stream_dedupe"] = with_ctes("""bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), arrived AS (
SELECT e.*, CASE WHEN event_id % 50 = 0 THEN 3 ELSE CAST(floor(CAST((epoch_us(ts) - epoch_us(lo)) * 4 AS DOUBLE) / (epoch_us(hi) - epoch_us(lo) + 1)) AS BIGINT) END AS part
FROM events e, bounds
), tops AS (
SELECT part, max(max(ts)) OVER (ORDER BY part) AS top FROM arrived GROUP BY part
), judged AS (
SELECT a.*, coalesce(a.ts <= t.top - INTERVAL 4 DAY, false) AS is_late FROM arrived a LEFT JOIN tops t ON t.part = a.part - 1
), firsts AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id) AS rn FROM judged WHERE NOT is_late) WHERE rn = 1
), kept AS (
SELECT user_id, event_type, part, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY part) AS k FROM firsts) WHERE k = 1
UNION ALL
SELECT f.user_id, f.event_type, f.part, f.ts FROM kept c JOIN firsts f USING (user_id, event_type)
WHERE f.part = (SELECT min(g.part) FROM firsts g WHERE g.user_id = c.user_id AND g.event_type = c.event_type
                AND g.part > (SELECT min(t.part) FROM tops t WHERE t.part >= c.part AND t.top - INTERVAL 4 DAY >= c.ts + INTERVAL 4 DAY))
)""", body=f"""
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, false AS is_late FROM kept
UNION ALL SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), true FROM judged WHERE is_late""")

SQL["model_step"] = """
SELECT c_custkey AS request_id, 200 AS http_status, c_name AS first_client, '2024-02-01T00:00:00' AS scraped_at FROM customer"""

SQL["stream_reply_join"] = with_ctes(MODEL_REPLIES, RESPONSES, body="""
SELECT c.c_custkey AS request_id, r.reply_id IS NOT NULL AS has_reply, coalesce(r.http_status, 0) AS http_status,
  CASE WHEN r.reply_id IS NULL THEN 'no reply' ELSE r.api_error END AS error
FROM customer c LEFT JOIN responses r ON r.reply_id = c.c_custkey AND r.reply_id % 13 <= 10""")

# ---------------------------------------------------------------------------
# Extraction rules
# ---------------------------------------------------------------------------
from ..functions import extract as _X  # noqa: E402


def url_path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def page_type(u: str) -> str:
    p = f"lower({url_path(u)})"
    ref = "|".join(k.replace("-", "\\-") for k in schemas.REFERENCE_PATH_KEYWORDS)
    return (f"CASE WHEN regexp_matches({p}, '/(case-stud(y|ies)|case_stud(y|ies))(/|$)') THEN 'case_study' "
            f"WHEN regexp_matches({p}, '/({ref})(/|$)') THEN 'reference_list' "
            f"WHEN regexp_matches({p}, '/(testimonials?)(/|$)') THEN 'testimonials' "
            f"WHEN regexp_matches({p}, '/(blog|news|insights?)(/|$)') THEN 'blog_post' "
            f"WHEN regexp_matches({p}, '/(jobs?|careers?|karriere|kariera)(/|$)') THEN 'job_listing' "
            f"WHEN regexp_matches({p}, '/(partners?|technolog(y|ies))(/|$)') THEN 'partners' "
            f"WHEN {p} = '' OR {p} = '/' THEN 'homepage' ELSE 'other' END")


def decode_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def strip_tags_sql(x: str) -> str:
    return ustrip(decode_sql(f"regexp_replace({x}, '(?s)</?[a-zA-Z][^>]*>', ' ', 'g')"))


def normalize_sql(x: str) -> str:
    s = f"regexp_replace({ustrip(x)}, '{_X.TRAILING_PUNCT}', '')"
    return (f"CASE WHEN {s} = upper({s}) AND length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g')) >= 5 "
            f"THEN {title_case(s)} ELSE {s} END")


SITE_PAGES = """site_pages AS (
SELECT page_id, CASE WHEN page_id % 9 < 7 THEN concat(regexp_extract(url, '^https?://[^/?#]*', 0),
    ['/case-studies/shop', '/reference', '/blog/launch', '/karriere', '/partners', '/testimonials', '/'][(page_id % 9 + 1)::INT]) ELSE url END AS url,
  replace(replace(html, '<title>', CASE page_id % 5 WHEN 0 THEN concat('<title>How Acme Foods ', page_id, ' grew ')
      WHEN 1 THEN concat('<title>New shop for Nordica ', page_id, ' ') ELSE '<title>' END),
    '<body>', CASE WHEN page_id % 3 = 0 THEN concat('<body><img src="l.png" alt="', CASE WHEN page_id % 6 = 0 THEN concat(' Client ', page_id, ' ') ELSE concat('Café ', page_id) END,
      '"><ul><li>SAP</li><li> Home</li><li><b>ACME</b> FOODS.</li></ul><a href="https://other.example.org/clients/">x</a>')
      ELSE '<body>' END) AS html
FROM pages)"""

SQL["page_types"] = f"WITH {SITE_PAGES} SELECT page_id, url, {page_type('url')} AS page_type FROM site_pages"

SQL["link_discovery"] = f"""
WITH {SITE_PAGES}, places AS (
  SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*') AS root, regexp_replace(url, '[?#].*$', '') AS file,
    regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS dir FROM site_pages
), first_links AS (
  -- the added link of each page and the URL it means, written out
  SELECT page_id, url, 1 AS link_pos, CASE page_id % 6 WHEN 0 THEN '../reference/a.html' WHEN 1 THEN concat(regexp_replace(root, '^https?:', ''), '/partners/?a=1&b=2&copy=3#top')
      WHEN 2 THEN '?page=2' WHEN 3 THEN ' ./x/./y/../z ' WHEN 4 THEN 'mailto:info@x.si' ELSE '/reference/list' END AS href,
    CASE page_id % 6 WHEN 0 THEN CASE WHEN page_id % 10 = 0 THEN concat(root, '/sub/reference/a.html')
        WHEN dir = concat(root, '/') THEN concat(dir, 'reference/a.html') ELSE concat(regexp_replace(dir, '[^/]+/$', ''), 'reference/a.html') END
      WHEN 1 THEN concat(root, '/partners/?a=1&b=2&copy=3') WHEN 2 THEN concat(CASE WHEN page_id % 10 = 0 THEN concat(root, '/sub/dir/') ELSE file END, '?page=2')
      WHEN 3 THEN concat(dir, 'x/z') WHEN 4 THEN 'mailto:info@x.si' ELSE concat(root, '/reference/list') END AS abs_url
  FROM places
), l AS (
  SELECT page_id, url, unnest(generate_series(1, len(h))) AS link_pos, unnest(h) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM site_pages)
), a AS (
  SELECT page_id, url, link_pos + 1 AS link_pos, href,
    CASE WHEN regexp_matches(href, '^https?://') THEN href
         WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^([a-zA-Z]+)://', 1), ':', href)
         WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^([a-zA-Z]+)://', 1), '://',
                                                 regexp_extract(url, '^https?://([^/?#]*)', 1), href) END AS abs_url
  FROM l UNION ALL SELECT * FROM first_links
)
SELECT page_id, CAST(link_pos AS BIGINT) AS link_pos, href, abs_url,
  lower(regexp_extract(abs_url, '^https?://([^/?#]*)', 1)) = lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS same_host,
  CASE WHEN abs_url IS NOT NULL THEN {page_type('abs_url')} END AS link_type FROM a"""


def site_path(r: str) -> str:
    return (f"concat(['/case-studies/', '/reference/', '/blog/', '/partners/', '/about/'][({r} % 5 + 1)::INT], {r}, "
            f"CASE WHEN {r} % 2 = 1 THEN '.html' ELSE '/' END)")


# the links between the pages as numbers, without their html
SQL["frontier"] = with_ctes("""sites AS (SELECT regexp_extract(url, '^https?://[^/?#]*') AS root, count(*) AS n FROM pages GROUP BY 1)""", """reached AS (
SELECT root, n, CAST(1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS hop, CAST(NULL AS BIGINT) AS via FROM sites
UNION ALL
SELECT root, n, child, hop + 1, r FROM (SELECT *, unnest([2 * r, 2 * r + 1]) AS child FROM reached WHERE r <= n) WHERE child % 5 <> 4
)""", body=f"""
SELECT {ckey("regexp_replace(root, '^https?://', '')")} AS company_key, concat(root, {site_path('r')}) AS url, hop,
  CASE WHEN via IS NOT NULL THEN concat(root, {site_path('via')}) END AS via_url,
  ['case_study', 'reference_list', 'blog_post', 'partners'][(r % 5 + 1)::INT] AS type FROM reached""")

LIST_NAMES = SITE_PAGES + f""", list_names AS (
SELECT page_id, url, item_pos, name FROM (
  SELECT page_id, url, CAST(item_pos AS BIGINT) AS item_pos, {strip_tags_sql('item')} AS name FROM (
    SELECT page_id, url, unnest(generate_series(1, len(li))) AS item_pos, unnest(li) AS item
    FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS li FROM site_pages)))
WHERE name <> ''
)"""

SQL["list_names"] = with_ctes(LIST_NAMES, body="SELECT page_id, item_pos, name FROM list_names")

SQL["name_normalize"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT name, {normalize_sql('name')} AS normalized FROM (SELECT DISTINCT name FROM clean)""")

_VENDORS = ", ".join(f"'{v.lower()}'" for v in schemas.TECH_VENDORS)
SQL["tech_partner_flag"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, LIST_NAMES, body=f"""
SELECT name, coalesce(lower({normalize_sql('name')}) IN ({_VENDORS}), false) AS is_vendor
FROM (SELECT name FROM list_names UNION SELECT name FROM clean)""")

_STOP = ", ".join(f"'{w}'" for w in _X.STOP_NAMES)
_OWN = default_name("ltrim(regexp_extract(url, '^https?://([^/?#]*)', 1), 'w.')")
SQL["name_exclusion"] = with_ctes(LIST_NAMES, body=f"""
SELECT page_id, item_pos, name FROM list_names
WHERE NOT (lower({ustrip('name')}) IN ({_STOP})) AND lower(name) <> lower({_OWN})""")

_CMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(schemas.TLD_COUNTRY.items())) + "}"
SQL["country_guess"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body=f"""
SELECT email, company_key, name, country,
  coalesce(nullif(country, ''), nullif({_CMAP}[{tld('domain')}], ''), '') AS country_guess FROM clean""")

_TITLE = strip_tags_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_HEAD = ", ".join(f"nullif(regexp_extract(title, '{p}', 1), '')" for p in _X.HEADLINE_PATTERNS)
SQL["headline_clients"] = f"""
WITH {SITE_PAGES} SELECT page_id, title, coalesce({_HEAD}) AS client FROM (SELECT page_id, {_TITLE} AS title FROM site_pages)"""

SQL["logo_names"] = f"""
WITH {SITE_PAGES} SELECT page_id, CAST(pos AS BIGINT) AS pos, name FROM (
  SELECT page_id, pos, {ustrip('alt')} AS name FROM (
    SELECT page_id, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS alt
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<img\\b[^>]*\\balt="([^"]*)"', 1) AS a FROM site_pages)))
WHERE name <> ''"""

# the sentence that must come out, written out: the note's own one, or the one after it
SQL["evidence_sentences"] = with_ctes(CLIENT_ROWS, RECS, CLEAN, body="""
SELECT email, company_key, name, CASE WHEN (regexp_matches(name, '[02468]$') AND contains(lower(ai_note), lower(name)))
    OR (NOT regexp_matches(name, '[02468]$') AND contains(lower(replace(ai_note, name, 'a client')), lower(name)))
  THEN concat(CASE WHEN regexp_matches(name, '[02468]$') THEN ai_note ELSE replace(ai_note, name, 'a client') END, '!')
  ELSE concat('And ', name, ' stayed?') END AS evidence FROM clean""")

SQL["discovery_candidates"] = with_ctes(PAGE_CANDIDATES, f"""r AS (
SELECT netloc, chunk, to_json({{'company_name': {default_name("ltrim(netloc, 'w.')")},
  'pages': list({{'url': url, 'type': CASE WHEN type <> 'partners' THEN type END}} ORDER BY seq)}})::VARCHAR AS reply
FROM (SELECT *, CAST(floor(seq / 300) AS BIGINT) AS chunk FROM page_candidates) GROUP BY netloc, chunk
)""", body="""
SELECT netloc, chunk, CAST(pos AS BIGINT) AS pos, c.url AS url, coalesce(c.type, 'unknown') AS type,
  coalesce(c.description, '') AS description FROM (
  SELECT netloc, chunk, unnest(generate_series(1, len(p))) AS pos, unnest(p) AS c FROM (
    SELECT netloc, chunk, from_json(reply, '{"pages":[{"url":"VARCHAR","type":"VARCHAR","description":"VARCHAR"}]}').pages AS p
    FROM r))""")

SQL["repo_decode"] = with_ctes(UPSERT_LOG, STATE, body="""
SELECT email, company_key,
  CASE WHEN coalesce(json_valid(data) AND starts_with(data, '{'), false) THEN TRY_CAST(json_extract(data, '$.k') AS INTEGER) END AS k,
  NOT coalesce(json_valid(data) AND starts_with(data, '{'), false) AS quarantined FROM state""")

SQL["contract_write"] = """
WITH settings AS (
SELECT CASE WHEN event_id % 97 <> 0 THEN concat('user', user_id % 15, '@example.com') END AS email, concat(event_type, '-', event_id) AS row_key,
  CASE WHEN event_id % 9 <> 0 THEN props ELSE '' END AS value FROM events
), repos AS (
SELECT concat('co-', event_id) AS row_key, CASE WHEN event_id % 11 = 0 THEN '2024-02-01 00:00:00.000000' WHEN event_id % 13 = 0 THEN NULL
    ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') END AS value, CASE WHEN event_id % 17 = 0 THEN 'data is missing'
    WHEN event_id % 11 <> 0 AND event_id % 13 = 0 THEN 'updated_at is no timestamp_ntz' END AS reason FROM events
)
SELECT 'settings' AS contract, email, row_key, value, email IS NULL AS rejected, CASE WHEN email IS NULL THEN 'email is missing' END AS reason FROM settings
UNION ALL SELECT 'repos', 'a@example.com', row_key, value, reason IS NOT NULL, reason FROM repos"""

SQL["document_store"] = """
SELECT concat('k', s_suppkey) AS company_key, s_suppkey % 7 = 0 AS quarantined,
  CASE WHEN s_suppkey % 7 <> 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE 'set' END END AS description_state,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 4 > 1 THEN concat('from ', s_nationkey) END AS description,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(2 AS BIGINT) END AS n_clients, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 THEN CAST(95 AS BIGINT) END AS confidence,
  CASE WHEN s_suppkey % 7 <> 0 THEN true END AS ai_cleaned, CASE WHEN s_suppkey % 7 = 0 THEN left(concat('{"key":"k', s_suppkey, '"', CASE s_suppkey % 4 WHEN 0 THEN ''
    WHEN 1 THEN ',"company_description":null' ELSE concat(',"company_description":"from ', s_nationkey, '"') END, ',"clients":[{"name":"Acme"'), 20) END AS raw FROM supplier"""

SQL["repository_export"] = with_ctes(UPSERT_LOG, STATE, body="""
SELECT email, chunk, count(*) FILTER (json_valid(data)) AS n_companies, count(*) FILTER (NOT json_valid(data)) AS n_quarantined,
  coalesce(to_json(map_from_entries(list({'key': company_key, 'value': CASE WHEN json_valid(data) THEN json(data) END} ORDER BY company_key)
    FILTER (json_valid(data))))::VARCHAR, '{}') AS export
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY email ORDER BY company_key) - 1) // 1000 AS BIGINT) AS chunk FROM state)
GROUP BY email, chunk""")


# ---------------------------------------------------------------------------
# E1 and E2
# ---------------------------------------------------------------------------
_NAME = f"({normalize_sql('raw')})"
_E1_SOURCE = ("CASE WHEN type IN ('case_study', 'case_studies_index') THEN 'case_study' WHEN type = 'testimonials' THEN 'testimonial' "
              "WHEN type = 'blog_post' THEN 'blog' WHEN type = 'job_listing' THEN 'job_listing' ELSE 'reference_list' END")
_KEY_OF = ckey("ltrim(netloc, 'w.')")

E1 = [PAGE_CANDIDATES, REDIRECT_ENDS, LOCALE, f"""replied AS (
SELECT {_KEY_OF} AS company_key, netloc, CAST(floor(seq / 300) AS BIGINT) AS chunk, seq AS place, url, CASE WHEN type <> 'partners' THEN type ELSE 'unknown' END AS type
FROM page_candidates
), numbered AS (
SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY chunk, netloc, place) AS seq FROM replied
), wanted AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_key, url ORDER BY seq) AS rn FROM numbered WHERE url <> '') WHERE rn = 1
), aimed AS (
SELECT w.*, CASE WHEN e.url IS NULL THEN w.url WHEN e.outcome = 'ok' THEN e.reached END AS target FROM wanted w LEFT JOIN ends e ON e.url = w.url
), got AS (
SELECT a.company_key, a.seq, a.type, p.url AS final_url, p.html, {page_text_sql('p.html')} AS text,
  {strip_tags_sql("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title
FROM aimed a JOIN pages p ON p.url = a.target AND starts_with(a.url, 'http') WHERE p.page_id % 17 <> 0 AND p.page_id % 23 <> 0
), items AS (
SELECT *, list_concat(list_concat(list_transform(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1), lambda x: {strip_tags_sql('x')}),
  list_transform(regexp_extract_all(html, '(?is)<img\\b[^>]*\\balt="([^"]*)"', 1), lambda x: {decode_sql('x')})), [coalesce({_HEAD})]) AS raws FROM got
), named AS (
SELECT company_key, seq, type, text, i, {_NAME} AS name FROM (
  SELECT company_key, seq, type, text, unnest(generate_series(1, len(raws))) AS i, unnest(raws) AS raw FROM items) WHERE {_NAME} <> ''
), said AS (
SELECT *, lower({normalize_sql('name')}) IN ({_VENDORS}) AS vendor FROM named
WHERE NOT (lower({ustrip('name')}) IN ({_STOP})) AND lower(name) <> lower({default_name('company_key')})
), records AS (
SELECT company_key, {ustrip('name')} AS name, CASE WHEN vendor THEN 'Technology vendor' ELSE '' END AS industry, '' AS country,
  CASE WHEN vendor THEN 'technology_partner' ELSE {_E1_SOURCE} END AS source,
  CASE WHEN vendor THEN 'technology partner' ELSE coalesce(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: contains(lower(s), lower(name)))[1], '') END AS ai_note,
  CAST(CASE WHEN vendor THEN 99 ELSE 80 END AS BIGINT) AS confidence, row_number() OVER (PARTITION BY company_key ORDER BY vendor, seq, i) AS o FROM said
), kept AS (
SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY o) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY company_key, lower(name) ORDER BY o) AS rn FROM records) WHERE rn = 1
), clients AS (
SELECT company_key, CAST((n - 1) // 1000 AS BIGINT) AS part, list({{'name': name, 'industry': industry, 'country': country, 'source': source,
  'ai_note': ai_note, 'confidence': confidence}} ORDER BY n) AS clients FROM kept GROUP BY ALL
), sources AS (
SELECT company_key, CAST((n - 1) // 1000 AS BIGINT) AS part, list(final_url ORDER BY n) AS urls FROM (
  SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY seq) AS n FROM got) GROUP BY ALL
), hosts AS (
SELECT company_key, arg_max(netloc, concat('https://', netloc)) AS netloc FROM replied GROUP BY company_key
), first_names AS (
SELECT company_key, arg_min(netloc, {{'c': chunk, 'n': netloc}}) AS netloc FROM replied GROUP BY company_key
), parts AS (
SELECT company_key, CAST(0 AS BIGINT) AS part FROM hosts UNION SELECT company_key, part FROM clients UNION SELECT company_key, part FROM sources
), results AS (
SELECT p.company_key, p.part, {default_name("ltrim(f.netloc, 'w.')")} AS company_name, ltrim(h.netloc, 'w.') AS domain,
  coalesce(l.map_language, 'english') AS detected_language, coalesce(m.map_country, '') AS detected_country,
  coalesce(c.clients, []) AS clients, coalesce(s.urls, []) AS urls
FROM parts p JOIN hosts h USING (company_key) JOIN first_names f USING (company_key)
LEFT JOIN clients c USING (company_key, part) LEFT JOIN sources s USING (company_key, part)
LEFT JOIN lang_map l ON l.tld = {tld("ltrim(h.netloc, 'w.')")} LEFT JOIN country_map m ON m.tld = {tld("ltrim(h.netloc, 'w.')")}
), documents_made AS (
SELECT *, to_json({{'key': company_key, 'company_name': company_name, 'company_domain': domain, 'company_description': '', 'detected_language': detected_language,
  'detected_country': detected_country, 'clients': clients, 'sources_checked': urls, 'scraped_at': '2024-02-01T00:00:00', 'ai_cleaned': true}})::VARCHAR AS document FROM results
)"""]

SQL["build_repository"] = with_ctes(*E1, body="""
SELECT company_key, part, company_name, CAST(len(clients) AS BIGINT) AS n_clients,
  CAST(len(list_filter(clients, lambda c: c.source = 'technology_partner')) AS BIGINT) AS n_partners, CAST(len(urls) AS BIGINT) AS n_sources,
  CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS n_bad_names, document FROM documents_made""")

SQL["apply_results"] = with_ctes(UPSERT_LOG, STATE, *E1, body=f"""
SELECT email, company_key, CAST(0 AS BIGINT) AS part, data, {TS} AS updated_at, seq FROM state
WHERE (email, company_key) NOT IN (SELECT concat('user', length(company_key) % 15, '@example.com'), company_key FROM documents_made)
UNION ALL
SELECT concat('user', length(company_key) % 15, '@example.com'), company_key, part, document, '2024-02-01 00:00:00.000000', NULL FROM documents_made""")
