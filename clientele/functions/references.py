"""URL references resolved against a base, after RFC 3986 section 5.2, as native
expressions; fragments are dropped."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
_PARTS = _SCHEME + r"(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def remove_dot_segments(path: Column) -> Column:
    """Section 5.2.4 for a path that starts with ``/``; any other path stays."""
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        return (F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                 .when(s == ".", kept).otherwise(F.concat(kept, F.array(s))))

    def walked(p: Column) -> Column:
        whole = F.when(p.rlike(r"/\.{1,2}$"), F.concat(p, F.lit("/"))).otherwise(p)
        kept = F.aggregate(F.split(F.substr(whole, F.lit(2)), "/", -1), none, step)
        return F.when(p.startswith("/") & p.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)
    return bind(path, walked)


def _split(url: Column) -> Column:
    """A URL or reference as scheme, host and query (each null if absent) and path."""
    def parts(u: Column) -> Column:
        return F.struct(F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lower(_part(u, 1))).alias("scheme"),
                        F.when(u.rlike(_SCHEME + "//"), _part(u, 2)).alias("host"), _part(u, 3).alias("path"),
                        F.when(u.rlike(r"^[^#]*\?"), _part(u, 4)).alias("query"))
    return bind(url, parts)


def resolve(base: Column, ref: Column) -> Column:
    """The absolute URL of ``ref`` on a page at ``base``; blanks around it and line
    breaks in it do not count.  Null if either is null or ``base`` has no scheme."""
    def joined(b: Column, r: Column) -> Column:
        own = r["scheme"].isNotNull() | r["host"].isNotNull()
        folder = F.when(b["host"].isNotNull() & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_extract(b["path"], "^(.*/)?", 0))
        path = (F.when(own | r["path"].startswith("/"), remove_dot_segments(r["path"])).when(r["path"] == "", b["path"])
                 .otherwise(remove_dot_segments(F.concat(folder, r["path"]))))
        query = F.coalesce(r["query"], F.when(~own & (r["path"] == ""), b["query"]))
        host = F.coalesce(r["host"], F.when(r["scheme"].isNull(), b["host"]))
        some = lambda lead, x: F.coalesce(F.concat(F.lit(lead), x), F.lit(""))
        return F.when(b["scheme"].isNotNull(), F.concat(F.coalesce(r["scheme"], b["scheme"]), F.lit(":"), some("//", host), path, some("?", query)))
    clean = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    both = F.struct(_split(base).alias("b"), _split(clean).alias("r"))
    return F.when(base.isNotNull() & ref.isNotNull(), bind(both, lambda x: joined(x["b"], x["r"])))
