"""String helpers shared by every operator (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Whitespace as a Python ``str.strip()`` sees it: Unicode separators,
# ASCII controls 0x09-0x0d and 0x1c-0x1f, and NEL.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def ustrip(c: Column) -> Column:
    """Unicode-aware strip (``trim`` alone only removes ASCII spaces)."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True when NULL or only whitespace."""
    return F.coalesce(ustrip(c) == F.lit(""), F.lit(True))


def title_case(c: Column) -> Column:
    """Python ``str.title()``: a word starts after any non-letter.

    Letter runs are capitalised one by one; ``initcap`` on its own only
    starts words after spaces (``My-shop``, ``3com``).
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")


def nullif_empty(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def first_nonempty(*cols: Column) -> Column:
    """First argument that is neither NULL nor ''; '' when none is."""
    return F.coalesce(*[nullif_empty(c) for c in cols], F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
