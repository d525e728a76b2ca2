"""Small column helpers: missing values, trimming, guarded rates, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters a Unicode-aware trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def present(c: Column | str) -> Column:
    """'' counts as missing."""
    return F.nullif(col(c), F.lit(""))


def first_present(*cs: Column | str) -> Column:
    """coalesce that also skips ''."""
    return F.coalesce(*[present(c) for c in cs])


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Decimal half-up rounding of a non-negative number."""
    rounded = F.round(col(c), digits)
    return rounded.cast("bigint") if digits == 0 else rounded


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    return half_up(F.lit(100.0) * ratio(part, whole), digits)


def cut(c: Column | str, n: int) -> Column:
    """First n code points."""
    return F.substring(col(c), 1, n)


def matches(c: Column | str, pattern: str) -> Column:
    """rlike, with a null text counted as no match."""
    return F.coalesce(F.rlike(col(c), F.lit(pattern)), F.lit(False))


def join_sorted(entry: Column, separator: str) -> Column:
    """Aggregate: join ``entry.text`` ordered by ``entry.pos``. Only for groups of bounded size."""
    ordered = F.array_sort(F.collect_list(entry))
    return F.array_join(F.transform(ordered, lambda e: e["text"]), separator)
