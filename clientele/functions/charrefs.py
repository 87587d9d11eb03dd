"""Character references of HTML (``&eacute;``, ``&#233;``, ``&#xE9;``) as native expressions.

The rules are those of the HTML standard: numbers by code point with the 32 old
Windows codes replaced, surrogates and numbers out of range as U+FFFD, control and
non-characters dropped; names with a semicolon by the standard's table, and the
older names also without one, the longest that fits.  Inside an attribute a name without a
semicolon stays as it is before ``=``, a letter or a digit.  Anything else stays.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import bind

BUCKETS = 61


def _bucket(name: str) -> int:
    return (31 * ord(name[0]) + 7 * ord(name[1]) + len(name)) % BUCKETS


@cache
def _names() -> str:
    """The standard's names (with semicolon) as a JSON array of maps, by bucket."""
    maps: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, text in html5.items():
        if name.endswith(";"):
            maps[_bucket(name[:-1])][name[:-1]] = text
    return json.dumps(maps, ensure_ascii=False)


@cache
def _old_names() -> str:
    """The names that need no semicolon, longest first, as a pattern."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _lookup(name: Column) -> Column:
    at = (F.lit(31) * F.ascii(name) + F.lit(7) * F.ascii(F.substring(name, 2, 1)) + F.length(name)) % BUCKETS
    maps = F.from_json(F.lit(_names()), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, at), name)


def code_point(n: Column) -> Column:
    """The text of a numeric reference; a null number is one too large to read."""
    return bind(n, _code_point)


def _code_point(n: Column) -> Column:
    windows = F.array(*(F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)))
    # the leading U+FEFF is read as byte order mark and leaves no character
    plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    dropped = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
               | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(bad, F.lit("�")).when(n.between(128, 159), F.get(windows, (n - 128).cast("int"))).when(dropped, F.lit("")).otherwise(plain)


def _after_ampersand(p: Column, in_attribute: bool) -> Column:
    """One piece of a text that was split at ``&``."""
    decimal, hexa = (F.regexp_extract(p, f"^#{x};?", 1) for x in ("([0-9]+)", "[xX]([0-9a-fA-F]+)"))
    number = (F.when(decimal != "", decimal.try_cast("bigint"))
               .when(F.length(F.ltrim(hexa, F.lit("0"))) <= 8, F.conv(hexa, 16, 10).try_cast("bigint")))
    rest = F.regexp_replace(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
    name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]{1,31});", 1)
    named = F.when(name != "", _lookup(name))
    stop = r"(?![=A-Za-z0-9])" if in_attribute else ""
    old = F.regexp_extract(p, f"^({_old_names()}){stop}", 1)
    return (F.when((decimal != "") | (hexa != ""), F.concat(code_point(number), rest))
             .when(named.isNotNull(), F.concat(named, F.substr(p, F.length(name) + 2)))
             .when(old != "", F.concat(_lookup(old), F.substr(p, F.length(old) + 1)))
             .otherwise(F.concat(F.lit("&"), p)))


def decode(c: Column, in_attribute: bool = False) -> Column:
    """``c`` with its character references decoded, each once."""
    pieces = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(_after_ampersand(p, in_attribute)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)
