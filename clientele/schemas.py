"""Record schemas (data model) and fixed lookup values.

The company document, client record and page/candidate records are
typed structs; JSON text only appears at the edges (S9).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's for equal results.
# ---------------------------------------------------------------------------

# Top-level domain -> language of the site (default "english").
TLD_LANGUAGE = {
    "si": "slovenian", "de": "german", "at": "german", "ch": "german", "fr": "french",
    "es": "spanish", "it": "italian", "nl": "dutch", "pl": "polish", "cz": "czech",
    "sk": "slovak", "hr": "croatian", "rs": "serbian", "hu": "hungarian",
    "ro": "romanian", "pt": "portuguese", "ru": "russian", "br": "portuguese",
}
DEFAULT_LANGUAGE = "english"

# Top-level domain -> country of the site (default "").
TLD_COUNTRY = {
    "si": "Slovenia", "de": "Germany", "at": "Austria", "ch": "Switzerland",
    "fr": "France", "es": "Spain", "it": "Italy", "nl": "Netherlands", "pl": "Poland",
    "cz": "Czech Republic", "sk": "Slovakia", "hr": "Croatia", "rs": "Serbia",
    "hu": "Hungary", "ro": "Romania", "pt": "Portugal", "ru": "Russia",
    "uk": "United Kingdom", "be": "Belgium", "se": "Sweden", "no": "Norway",
    "dk": "Denmark", "fi": "Finland",
}
DEFAULT_COUNTRY = ""

# Source value -> table tag label (fallback: the source itself, else "Reference").
SOURCE_TAG_LABEL = {
    "case_study": "Case Study", "reference_list": "Reference", "reference": "Reference",
    "logo": "Logo", "testimonial": "Testimonial", "blog": "Blog",
    "job_listing": "Job Listing", "technology_partner": "Tech Partner",
}

# Source values a model reply may use for a client.
CLIENT_SOURCE_TYPES = ("case_study", "reference_list", "logo", "testimonial", "blog", "job_listing")
# Page types a discovery reply may use.
PAGE_TYPES = ("homepage", "case_studies_index", "case_study", "reference_list",
              "testimonials", "blog_post", "job_listing", "partners")

PARTNER_SOURCE = "technology_partner"
PARTNER_INDUSTRY = "Technology vendor"
PARTNER_CONFIDENCE = 99
DEFAULT_CONFIDENCE = 80
DEFAULT_CLIENT_SOURCE = "reference_list"

PAGES_PER_COMPANY = 15        # candidate cap (T3), only where it is asked for
CONTEXT_CHARS = 35000         # text in one request; more text makes more requests
ERROR_TEXT_CHARS = 300        # HTTP error body cut
NOTE_PREVIEW_CHARS = 100      # evidence preview in the client table
BLOCK_RULE = "=" * 60         # page block header rule

DISCOVERY_MAX_TOKENS = 4000
ANALYSIS_MAX_TOKENS = 8000
MODEL_NAME = "default"
SEARCH_TOOL = ("web_search", "web_search")
SERVICE_LABEL = "Model API"
NO_JSON_ERROR = "No JSON found in response"

# Path keywords that mark a reference / client page (discovery hint list).
REFERENCE_PATH_KEYWORDS = ("reference", "clients", "case-studies", "portfolio", "references",
                           "stranke", "klienti", "referenzen", "referencje")
# Vendors the extraction rules name as technology partners, not clients.
TECH_VENDORS = ("Pimcore", "Shopware", "SAP", "Salesforce", "Google", "Meta", "HubSpot")

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

CLIENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ai_note", T.StringType()),
    T.StructField("confidence", T.LongType()),
])

PAGE_CANDIDATE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
])

DISCOVERY_REPLY = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("company_description", T.StringType()),
    T.StructField("pages", T.ArrayType(PAGE_CANDIDATE)),
])

ANALYSIS_REPLY = T.StructType([
    T.StructField("clients", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("industry", T.StringType()),
        T.StructField("country", T.StringType()), T.StructField("source_type", T.StringType()),
        T.StructField("evidence", T.StringType()), T.StructField("confidence", T.LongType())]))),
    T.StructField("technology_partners", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("role", T.StringType())]))),
    T.StructField("summary", T.StringType()),
])

COMPANY_DOCUMENT = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("company_domain", T.StringType()),
    T.StructField("company_description", T.StringType()),
    T.StructField("detected_language", T.StringType()),
    T.StructField("detected_country", T.StringType()),
    T.StructField("clients", T.ArrayType(CLIENT)),
    T.StructField("sources_checked", T.ArrayType(T.StringType())),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("ai_cleaned", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

# Store tables (S10 contracts): name -> (schema, primary key, defaults)
REPOS = T.StructType([
    T.StructField("email", T.StringType(), False),
    T.StructField("company_key", T.StringType(), False),
    T.StructField("data", T.StringType(), False),
    T.StructField("updated_at", T.TimestampNTZType()),
])
SETTINGS = T.StructType([
    T.StructField("email", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])
CONTRACTS = {
    "repos": (REPOS, ("email", "company_key"), {"updated_at": "now"}),
    "settings": (SETTINGS, ("email", "name"), {"value": ""}),
}
