"""Row-level numeric helpers: row mean, play-time stage, neutral defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.constants import NEUTRAL_ASPECT, PLAYTIME_BINS, PLAYTIME_LABELS, SCORE_COLUMNS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c) -> Column:
    """NaN -> null, so averages skip it as pandas does."""
    c = _col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def row_mean(cols=SCORE_COLUMNS) -> Column:
    """Mean over the given columns, skipping nulls and NaN; null when all are missing."""
    vals = [no_nan(c) for c in cols]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    return F.when(n > 0, total / n)


def playtime_minutes(c) -> Column:
    """Numeric play time; text that is not a number becomes null."""
    return _col(c).try_cast("double")


def playtime_stage_index(c) -> Column:
    """G4 as an index 0..3 over right-closed bins; outside or null -> null."""
    m = playtime_minutes(c)
    b = PLAYTIME_BINS
    expr = None
    for i in range(len(b) - 1):
        cond = (m > b[i]) & (m <= b[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def playtime_stage(c) -> Column:
    """Stage label of a play time in minutes."""
    idx = playtime_stage_index(c)
    labels = F.array(*[F.lit(x) for x in PLAYTIME_LABELS])
    return F.when(idx.isNotNull(), F.element_at(labels, idx + 1))


def with_default_scores(df: DataFrame, cols=SCORE_COLUMNS) -> DataFrame:
    """Neutral 0.5 wherever an aspect score is missing (adds absent columns)."""
    out = {}
    for c in cols:
        out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(NEUTRAL_ASPECT)) if c in df.columns
                  else F.lit(NEUTRAL_ASPECT))
    return df.withColumns(out)
