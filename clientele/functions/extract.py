"""Deterministic extraction rules.

The reference states these as instructions to a hosted model; here they
are column rules so the whole repository can be built without a network
(quality is below a model's; nothing is claimed about accuracy).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas
from .text import title_case, ustrip

# Headline patterns of the three documented examples
# ("Za Žak smo ..." -> Žak, "How Intersport expanded ..." -> Intersport,
# "Custom PIM for SIP Mehanizacija" -> SIP Mehanizacija).
HEADLINE_PATTERNS = (
    r"^Za (.+?) smo ",
    r"^How (\p{Lu}\S*(?: \p{Lu}\S*)*) \p{Ll}",
    r" for (\p{Lu}.*)$",
)

# Navigation, contact and generic words that are never clients.
STOP_NAMES = (
    "home", "about", "about us", "contact", "contact us", "services", "products", "solutions",
    "blog", "news", "careers", "jobs", "team", "privacy", "privacy policy", "imprint", "impressum",
    "terms", "login", "sign in", "menu", "search", "faq", "support", "cookies", "sitemap",
    "read more", "learn more", "more", "references", "clients", "portfolio", "case studies",
)

TRAILING_PUNCT = r"[.,;:!?\s]+$"


def headline_client(title: Column) -> Column:
    """Client named by a case-study headline, first matching pattern wins."""
    picks = [F.regexp_extract(title, p, 1) for p in HEADLINE_PATTERNS]
    return F.coalesce(*[F.when(x != "", x) for x in picks])


def normalize_name(name: Column) -> Column:
    """Strip, drop trailing punctuation, title-case shouting names
    (all capitals with 5+ letters; short acronyms like SAP stay)."""
    s = F.regexp_replace(ustrip(name), TRAILING_PUNCT, "")
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    shouting = (s == F.upper(s)) & (letters >= 5)
    return F.when(shouting, title_case(s)).otherwise(s)


def is_tech_vendor(name: Column) -> Column:
    """Normalised name is a known technology vendor."""
    return F.lower(normalize_name(name)).isin([v.lower() for v in schemas.TECH_VENDORS])


def is_stop_name(name: Column) -> Column:
    """Navigation / contact / generic word."""
    return F.lower(ustrip(name)).isin(list(STOP_NAMES))


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")


def evidence_sentence(text: Column, name: Column) -> Column:
    """First sentence that mentions the name (case-insensitive); NULL if none.
    ``get`` rather than ``[0]``: ANSI mode raises on an empty array index."""
    hits = F.filter(sentences(text), lambda s: F.contains(F.lower(s), F.lower(name)))
    return F.get(hits, 0)
