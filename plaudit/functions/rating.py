"""Rating and price predicates as Column expressions (stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit.constants import (DEFAULT_BASE_SCORE, FREE_PRICE_WORDS, NO_RATING, RATING_BASE_SCORE,
                               RATING_DISPLAY)
from plaudit.functions.text import strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_contained(text: Column, pairs, default: Column) -> Column:
    """CASE WHEN contains(text, k1) THEN v1 WHEN ... in list order (first key wins)."""
    expr = None
    for key, value in pairs:
        cond = F.contains(text, F.lit(key))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(default)


def rating_text(c) -> Column:
    """Missing rating text reads as the no-rating marker."""
    return F.coalesce(_col(c), F.lit(NO_RATING))


def translate_rating(c) -> Column:
    """Display text of a rating; unknown text is returned unchanged."""
    t = rating_text(c)
    return _first_contained(t, RATING_DISPLAY, t)


def base_score(c) -> Column:
    """Base score 0-100 of a rating text, default 50."""
    return _first_contained(rating_text(c), RATING_BASE_SCORE, F.lit(DEFAULT_BASE_SCORE))


def price_text(c) -> Column:
    """Price with the currency sign and commas removed, ends stripped (Unicode blanks and newlines too)."""
    return strip(F.regexp_replace(F.coalesce(_col(c), F.lit("0")), "[¥,]", ""))


def is_paid(c) -> Column:
    """Paid iff the cleaned price is non-empty and not a free word (so 0.00 is paid)."""
    p = price_text(c)
    return (F.length(p) > 0) & ~F.lower(p).isin(*FREE_PRICE_WORDS)


def score_class(c) -> Column:
    """>75 high, >50 mid, else low."""
    s = _col(c)
    return F.when(s > 75, "high").when(s > 50, "mid").otherwise("low")
