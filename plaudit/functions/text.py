"""Text cleaning and tokenising as built-in Column expressions.

All patterns are Java regex and Unicode-aware where the reviewed code relied
on Python's Unicode ``\\w``/``\\s``/``strip``; see ``plaudit.constants``.
Lengths and substrings count code points, as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaudit.constants import (HAN, PAT_CTRL_WS, PAT_DISPLAY_KEEP, PAT_HASHTAG, PAT_LAZY_TAG, PAT_MENTION,
                               PAT_SPLIT, PAT_STRIP, PAT_TAG, PAT_TOPIC_KEEP, PAT_URL, SCORING_MAX_CHARS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python-style strip: Unicode whitespace and separators at both ends."""
    return F.regexp_replace(_col(c), PAT_STRIP, "")


def clean_for_scoring(c) -> Column:
    """T1 + T2: drop URLs, tags, @mentions, #tags (in that order), strip,
    cut to 512 code points; an empty result becomes one blank."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    for pat in (PAT_URL, PAT_TAG, PAT_MENTION, PAT_HASHTAG):
        t = F.regexp_replace(t, pat, "")
    t = F.substring(strip(t), 1, SCORING_MAX_CHARS)
    return F.when(F.length(t) == 0, F.lit(" ")).otherwise(t)


def clean_for_topics(c) -> Column:
    """Drop tags; each char outside Han and ASCII letters -> one blank; strip."""
    t = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), PAT_TAG, "")
    t = F.regexp_replace(t, PAT_TOPIC_KEEP, " ")
    return strip(t)


def clean_for_keywords(c) -> Column:
    """T4: drop lazy tags; CR/LF/TAB -> blank; keep Han, ASCII letters/digits,
    whitespace and .,!? only; strip."""
    t = F.regexp_replace(_col(c).cast("string"), PAT_LAZY_TAG, "")
    t = F.regexp_replace(t, PAT_CTRL_WS, " ")
    t = F.regexp_replace(t, PAT_DISPLAY_KEEP, "")
    return strip(t)


# A Han character followed by another becomes "<it><next> "; the last character
# of a run (preceded by Han, not followed by Han) becomes a blank. So a run
# ABCD turns into "AB BC CD " and a lone character stays itself.
HAN_BIGRAMS = f"([{HAN}])(?=([{HAN}]))|(?<=[{HAN}])[{HAN}](?![{HAN}])"


def tokens(c) -> Column:
    """T5: built-in tokeniser. Lower-case, split on whitespace; a run of Han
    characters yields its character bigrams (a single character stays whole).
    Blank tokens never appear. Pure regex/split, so it stays in codegen."""
    low = F.lower(_col(c))
    han = F.regexp_replace(F.regexp_replace(low, f"([{HAN}]+)", " $1 "), HAN_BIGRAMS, "$1$2 ")
    t = F.when(low.rlike(f"[{HAN}]"), han).otherwise(low)
    return F.array_remove(F.split(t, PAT_SPLIT), "")


def token_rows(df, c, out: str = "word", keep: list | None = None, stopwords=()):
    """T5 + J4 as rows: one row per token, stopwords removed with a hash-set
    ``isin`` (no per-token list scan). Keeps ``keep`` columns."""
    keep = list(keep or [])
    rows = df.select(*keep, F.explode(tokens(c)).alias(out))
    if stopwords:
        rows = rows.filter(~F.col(out).isin(list(stopwords)))
    return rows


def remove_stopwords(tok_array, stopwords: list[str]) -> Column:
    """J4 on an array column against a small fixed list. ``isin`` inside the
    lambda is optimised into a hash-set lookup (InSet). Duplicates survive
    (``array_except`` would drop them and break counts)."""
    words = list(stopwords)
    return F.filter(_col(tok_array), lambda x: ~x.isin(words))


def cut_summary(c, n: int, ellipsis: str = "...") -> Column:
    """Cut to n code points and mark the cut."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)
