"""HTML -> text and HTML field extraction (P9, X2, X4, X5), native expressions.

``page_text`` follows the parse-tree rule of the reference: drop the elements
``script style nav footer head noscript svg iframe`` with their content, take every
remaining text node, decode its character references, strip it, drop empty ones, join
with newlines and collapse 3+ newlines to 2.

Ordinary pages need no parse: comments, the doctype, dropped elements and every tag
become a marker, and the text is split on it.  Pages where that would go wrong
(``irregular``: dropped elements that cross, hold their own kind or lack a tag, a ``>``
inside an attribute) are cut into tags and texts and folded in order, with the open
elements of the dropped region as state.  The fold goes block by block, so its work grows with
the number of tags and texts, not with its square.  Both are JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import charrefs
from .text import bind, ustrip

MARK = "\u0001"
DROPPED = ("script", "style", "nav", "footer", "head", "noscript", "svg", "iframe")
COMMENT_OR_DOCTYPE = r"(?is)<!--.*?-->|<!doctype[^>]*>"
DROPPED_ELEMENT = r"(?is)<(" + "|".join(DROPPED) + r")\b[^>]*>.*?</\1\s*>"
ANY_TAG = r"(?s)</?[a-zA-Z][^>]*>"


def decode_entities(c: Column) -> Column:
    return charrefs.decode(c)


def text_nodes(html: Column) -> Column:
    """Array of decoded, stripped, non-empty text nodes in document order."""
    s = F.regexp_replace(html, COMMENT_OR_DOCTYPE, MARK)
    s = F.regexp_replace(s, DROPPED_ELEMENT, MARK)
    s = F.regexp_replace(s, ANY_TAG, MARK)
    parts = F.transform(F.split(decode_entities(s), MARK), ustrip)  # no reference decodes to the marker
    return F.filter(parts, lambda p: p != F.lit(""))


RAW = ("script", "style", "noscript", "iframe")       # their content is never markup
NESTING = ("nav", "footer", "head", "svg")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
IN_HEAD = ("title", "meta", "link", "base", "template")
CONTAINERS = ("html", "body", "main", "div", "section", "article", "aside", "header", "form", "table", "tr", "td")
ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TAG = r"</?[a-zA-Z]" + ATTRIBUTES + ">"
TEXT = r"[^<\x01]++(?:<(?![a-zA-Z/!])[^<\x01]*+)*+|<"
COMMENT_OR_RAW = r"(?is)<!--.*?(?:-->|\z)|<!doctype[^>]*>|<(" + "|".join(RAW) + r")\b" + ATTRIBUTES + r">.*?(?:</\1\s*>|\z)"
BLOCK = 512


def _tag(token: Column) -> Column:
    """A token as (name or null for a text, closing, alone)."""
    name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    return bind(name, lambda n: F.struct(F.nullif(n, F.lit("")).alias("name"), token.startswith("</").alias("closing"),
                                          (n.isin(*VOID) | token.endswith("/>")).alias("alone")))


def _open_after(opened: Column, tag: Column) -> Column:
    """The open elements of the dropped region after one more tag (empty: outside).

    A closing tag closes what was opened inside it; one that closes an enclosing
    container ends the region; anything but head content ends an open head."""
    name, none = tag["name"], F.array().cast("array<string>")
    at = F.array_position(F.reverse(opened), name)
    closed = (F.when(at > 0, F.slice(opened, F.lit(1), F.greatest(F.size(opened) - at.cast("int"), F.lit(0))))
               .when(name.isin(*CONTAINERS), none).otherwise(opened))
    enters = F.when(name.isin(*NESTING), F.array(name)).otherwise(none)
    leaves_head = (F.get(opened, 0) == "head") & ~name.isin(*IN_HEAD)
    grown = (F.when((F.size(opened) == 0) | leaves_head, enters).otherwise(F.concat(opened, F.array(name))))
    alone = F.when(leaves_head & (F.size(opened) > 0) & ~name.isin(*VOID), none).otherwise(opened)
    return F.when(tag["closing"], F.when(F.size(opened) == 0, opened).otherwise(closed)).when(tag["alone"], alone).otherwise(grown)


def _kept(tags: Column) -> Column:
    """For every token whether it is a text outside the dropped regions.

    Two folds, one over blocks of ``BLOCK`` tokens and one inside a block: appending to an
    array copies it, and so the copied arrays stay short."""
    no_flags, no_names = F.array().cast("array<boolean>"), F.array().cast("array<string>")
    last = F.floor((F.size(tags) - 1) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(tags, b * BLOCK + 1, F.lit(BLOCK)))

    def step(state: Column, tag: Column) -> Column:
        text = tag["name"].isNull()
        return F.struct(F.when(text, state["open"]).otherwise(_open_after(state["open"], tag)).alias("open"),
                        F.concat(state["keep"], F.array(text & (F.size(state["open"]) == 0))).alias("keep"))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["open"].alias("open"), no_flags.alias("keep")), step)
        return bind(inner, lambda r: F.struct(r["open"].alias("open"), F.concat(state["keep"], F.array(r["keep"])).alias("keep")))
    start = F.struct(no_names.alias("open"), F.array().cast("array<array<boolean>>").alias("keep"))
    return F.aggregate(blocks, start, block, lambda state: F.flatten(state["keep"]))


def folded_text_nodes(html: Column) -> Column:
    """``text_nodes`` by a fold over the page's tags and texts in order."""
    tokens = F.regexp_extract_all(F.regexp_replace(html, COMMENT_OR_RAW, MARK), F.lit(f"(?s){TAG}|{TEXT}"), 0)

    def texts(tokens: Column) -> Column:
        keep = bind(F.transform(tokens, _tag), _kept)
        return F.zip_with(tokens, keep, lambda token, k: F.when(k, ustrip(decode_entities(token))))
    return F.filter(bind(tokens, texts), lambda t: t != F.lit(""))


def page_text(html: Column, max_chars: int | None = None) -> Column:
    """Readable text of a page, whole unless ``max_chars`` is given (T4)."""
    nodes = F.when(irregular(html), folded_text_nodes(html)).otherwise(text_nodes(html))
    t = F.regexp_replace(F.array_join(nodes, "\n"), r"\n{3,}", "\n\n")
    return t if max_chars is None else F.substring(t, 1, max_chars)


# the names of the dropped elements' tags in a row: elements side by side, with elements of other kinds inside
REGULAR = r"^(?:<([a-z]+)(?=<)(?:<(?!\1<)([a-z]+)(?=<)</\2(?=<|$))*+</\1(?=<|$))*+$"


def irregular(html: Column) -> Column:
    """True when the marker recipe may differ from a parse."""
    odd = html.rlike(r"=\s*(\"[^\"<]*>|'[^'<]*>)")
    names = F.regexp_extract_all(html, F.lit(r"(?i)</?(?:" + "|".join(DROPPED) + r")\b"), 0)
    return F.coalesce(odd | ~F.lower(F.array_join(names, "")).rlike(REGULAR), F.lit(False))


def tags(html: Column, element: str) -> Column:
    """The start tags of an element in page order, outside comments and raw content."""
    return F.regexp_extract_all(F.regexp_replace(html, COMMENT_OR_RAW, " "), F.lit(rf"(?is)<{element}(?=[\s/>]){ATTRIBUTES}>"), 0)


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's attribute, whatever its quotes, case and place; null if absent."""
    others = rf"(?:[\s/]++(?!{name}[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+"
    found = rf"(?is)^<[a-z][^\s/>]*+{others}[\s/]++{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*(F.regexp_extract(tag, found, i) for i in (1, 2, 3)))
    return F.when(tag.rlike(found), charrefs.decode(value, in_attribute=True))


def attributes(html: Column, element: str, name: str) -> Column:
    """The values of an attribute over all tags of an element that have it."""
    return F.filter(F.transform(tags(html, element), lambda t: attribute(t, name)), lambda v: v.isNotNull())


def hrefs(html: Column) -> Column:
    """``href`` values of anchors, in page order."""
    return attributes(html, "a", "href")


def base_href(html: Column) -> Column:
    """The ``href`` of the page's first ``base`` element that has one."""
    return F.get(attributes(html, "base", "href"), 0)


def list_items(html: Column) -> Column:
    """Inner markup of every list item, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)


def image_alts(html: Column) -> Column:
    """``alt`` texts of images (logo walls)."""
    return attributes(html, "img", "alt")


def strip_tags(c: Column) -> Column:
    return ustrip(decode_entities(F.regexp_replace(c, ANY_TAG, " ")))


def title(html: Column) -> Column:
    """Text of the page ``<title>``."""
    return strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
