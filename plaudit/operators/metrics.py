"""Per-app review metrics.

Every metric is a single grouped aggregation keyed by app (partial aggregation
before the shuffle, so a hot app costs one row per map task), followed by a
row-local reshape (``explode`` of a fixed-size array). Skeletons (stages,
months) are generated per app with ``sequence``/``explode`` rather than
by cross-joining a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.constants import (CARD_MAX_CHARS, PLAYTIME_LABELS, RADAR_MAX, RADAR_NAMES, SCORE_COLUMNS,
                               STAGE_FILL)
from plaudit.functions.numeric import no_nan, playtime_stage_index, row_mean
from plaudit.functions.text import cut_summary


def by_polarity(df: DataFrame, kind: str) -> DataFrame:
    """B1: the positive or the negative reviews."""
    want = kind == "positive"
    return df.filter(F.col("voted_up") == F.lit(want))


def polarity_counts(reviews: DataFrame) -> DataFrame:
    """G1: positive / negative review counts per app."""
    return reviews.groupBy("appid").agg(
        F.count_if(F.col("voted_up") == F.lit(True)).alias("positive_count"),
        F.count_if(F.col("voted_up") == F.lit(False)).alias("negative_count"))


def _round1(c: Column) -> Column:
    return F.bround(c, 1)


def aspect_radar(reviews: DataFrame) -> DataFrame:
    """Mean of each aspect over positive reviews x100 (1 decimal); 0 when
    an app has no positive review. One row per (app, dimension), fixed order."""
    pos = F.col("voted_up") == F.lit(True)
    aggs = [F.avg(F.when(pos, no_nan(c))).alias(c) for c in SCORE_COLUMNS]
    per_app = reviews.groupBy("appid").agg(*aggs)
    dims = F.array(*[
        F.struct(F.lit(i).alias("dim_idx"), F.lit(name).alias("dimension"),
                 F.coalesce(_round1(F.col(c) * 100), F.lit(0.0)).alias("value"))
        for i, (c, name) in enumerate(zip(SCORE_COLUMNS, RADAR_NAMES))])
    return (per_app.select("appid", F.inline(dims))
            .withColumn("max", F.lit(RADAR_MAX)))


def playtime_sentiment(reviews: DataFrame) -> DataFrame:
    """Mean row sentiment (G3) per play-time stage (G4) and polarity,
    x100 to 1 decimal; an absent or all-null cell is 0.5 -> 50.0.
    Four rows per app with reviews."""
    stage = playtime_stage_index("playtime_at_review")
    rm = row_mean(SCORE_COLUMNS)
    pos = F.col("voted_up") == F.lit(True)
    neg = F.col("voted_up") == F.lit(False)
    aggs = []
    for i in range(len(PLAYTIME_LABELS)):
        aggs.append(F.avg(F.when((stage == i) & pos, rm)).alias(f"p{i}"))
        aggs.append(F.avg(F.when((stage == i) & neg, rm)).alias(f"n{i}"))
    per_app = reviews.groupBy("appid").agg(*aggs)

    def cell(name):
        return _round1(F.coalesce(F.col(name), F.lit(STAGE_FILL)) * 100)

    stages = F.array(*[
        F.struct(F.lit(i).alias("stage_idx"), F.lit(label).alias("stage"),
                 cell(f"p{i}").alias("positive"), cell(f"n{i}").alias("negative"))
        for i, label in enumerate(PLAYTIME_LABELS)])
    return per_app.select("appid", F.inline(stages))


def month_start(ts: Column) -> Column:
    """First day of the month as a DATE; zone-free for TIMESTAMP_NTZ and dates.
    Epoch seconds (numbers) are read as UTC."""
    return F.trunc(F.to_date(ts), "month")


def epoch_to_date(epoch: Column) -> Column:
    """Epoch seconds -> UTC calendar date without a session time zone."""
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))


def monthly_counts(reviews: DataFrame, ts_col: str = "ts", drop_epoch_zero: bool = False) -> DataFrame:
    """Per app and month, positive and negative counts, gap-filled.

    Each polarity is gap-filled inside its own first..last month; months lying
    in neither range are absent. ``ts_col`` may be a timestamp/date column or
    epoch seconds (a missing epoch is 0 -> 1970-01, as in the source).
    """
    ts = F.col(ts_col)
    dtype = dict(reviews.dtypes)[ts_col]
    if dtype in ("bigint", "int", "smallint", "double", "float") or dtype.startswith("decimal"):
        epoch = F.coalesce(ts, F.lit(0))
        day = epoch_to_date(epoch)
        keep = epoch != 0 if drop_epoch_zero else F.lit(True)
    else:
        day = F.to_date(ts)
        keep = F.lit(True)
    pos = F.col("voted_up") == F.lit(True)
    counts = (reviews.filter(keep)
              .select("appid", F.trunc(day, "month").alias("month"), pos.alias("pos"))
              .groupBy("appid", "month")
              .agg(F.count_if(F.col("pos")).alias("positive"),
                   F.count_if(~F.col("pos")).alias("negative")))
    return gap_fill_months(counts)


def gap_fill_months(counts: DataFrame) -> DataFrame:
    """G6 skeleton over (appid, month DATE, positive, negative) partial counts
    (several rows per month are summed, e.g. daily counts from a stream)."""
    counts = counts.groupBy("appid", "month").agg(F.sum("positive").alias("positive"),
                                                  F.sum("negative").alias("negative"))
    one_month = F.expr("INTERVAL 1 MONTH")

    def span(cond):
        lo = F.min(F.when(cond, F.col("month")))
        hi = F.max(F.when(cond, F.col("month")))
        return lo, hi

    plo, phi = span(F.col("positive") > 0)
    nlo, nhi = span(F.col("negative") > 0)
    bounds = counts.groupBy("appid").agg(plo.alias("plo"), phi.alias("phi"), nlo.alias("nlo"), nhi.alias("nhi"))
    empty = F.array().cast("array<date>")
    skeleton = bounds.select(
        "appid",
        F.explode(F.array_distinct(F.concat(
            F.coalesce(F.sequence("plo", "phi", one_month), empty),
            F.coalesce(F.sequence("nlo", "nhi", one_month), empty)))).alias("month"))
    out = skeleton.join(counts, ["appid", "month"], "left")
    return out.select(
        "appid",
        F.date_format("month", "yyyy-MM").alias("month"),
        F.coalesce("positive", F.lit(0)).cast("bigint").alias("positive"),
        F.coalesce("negative", F.lit(0)).cast("bigint").alias("negative"))


def hours_text(minutes: Column) -> Column:
    """Play time in hours with one decimal, as text; ties to even on the exact
    value minutes/60 (integer arithmetic, identical in every engine)."""
    m = minutes.cast("bigint")
    a = F.abs(m)
    q = F.floor(a / 6).cast("bigint")
    r = a - q * 6
    h10 = q + F.when((r > 3) | ((r == 3) & (q % 2 == 1)), 1).otherwise(0)
    sign = F.when((m < 0) & (h10 > 0), F.lit("-")).otherwise(F.lit(""))
    return F.when(m.isNotNull(), F.concat(sign, F.floor(h10 / 10).cast("bigint").cast("string"), F.lit("."),
                                          (h10 % 10).cast("string")))


def review_cards(reviews: DataFrame) -> DataFrame:
    """B2: card fields: first 100 characters plus '...' when longer, hours with
    one decimal, polarity label, votes."""
    return reviews.select(
        "review_id", "appid", "author_name",
        cut_summary(F.coalesce(F.col("content"), F.lit("")), CARD_MAX_CHARS).alias("card_text"),
        hours_text(F.col("playtime_at_review")).alias("hours"),
        F.when(F.col("voted_up"), F.lit("👍好评")).otherwise(F.lit("👎差评")).alias("badge"),
        F.col("votes_up").cast("bigint").alias("votes_up"))
