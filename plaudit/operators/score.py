"""Recommendation score for every app at once.

One partial/final aggregation over the reviews gives every per-app input; the
rest are joins of one-row-per-app tables, which AQE broadcasts at run time
when their measured size allows (no unchecked broadcast hint here).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.constants import (CRITICAL_FLAW_KEYWORDS, NEUTRAL_ASPECT, NEUTRAL_SCORE, NOTE_FLAW,
                               NOTE_MAX_SCORE, NOTE_OPT, NOTE_OPT_ABOVE, NOTE_REFUND, NOTE_REFUND_ABOVE,
                               NOTE_VALUE, NOTE_VALUE_ABOVE, OPT_PENALTY_WEIGHT, REFUND_MAX_MINUTES,
                               REFUND_PENALTY_WEIGHT, SUGGEST_ABOVE_50, SUGGEST_ABOVE_75, SUGGEST_ABOVE_90,
                               SUGGEST_BELOW_25, SUGGEST_NO_REVIEWS, SUGGEST_OTHER, VALUE_PENALTY_WEIGHT)
from plaudit.functions.numeric import no_nan, playtime_minutes
from plaudit.functions.rating import base_score, is_paid, score_class


def review_stats(reviews: DataFrame, key: str = "appid") -> DataFrame:
    """Per-app inputs of the penalties: one hash aggregation (map-side partial)."""
    neg = F.col("voted_up") == F.lit(False)
    return reviews.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.avg(no_nan("score_opt")).alias("opt_mean"),
        F.avg(no_nan("score_value")).alias("value_mean"),
        F.count_if(neg).alias("n_negative"),
        F.count_if(neg & (playtime_minutes("playtime_at_review") <= REFUND_MAX_MINUTES)).alias("n_refund"),
    )


def penalty_columns(price: Column) -> dict[str, Column]:
    """G7-G9 over ``review_stats`` columns. A missing mean counts as neutral 0.5."""
    opt = (F.lit(1.0) - F.coalesce("opt_mean", F.lit(NEUTRAL_ASPECT))) * OPT_PENALTY_WEIGHT
    value = F.when(is_paid(price),
                   (F.lit(1.0) - F.coalesce("value_mean", F.lit(NEUTRAL_ASPECT))) * VALUE_PENALTY_WEIGHT
                   ).otherwise(F.lit(0.0))
    refund = F.when(F.col("n_negative") > 0,
                    F.col("n_refund") / F.col("n_negative") * REFUND_PENALTY_WEIGHT).otherwise(F.lit(0.0))
    return {"opt_penalty": opt, "value_penalty": value, "refund_penalty": refund}


def penalties(reviews: DataFrame, app_info: DataFrame) -> DataFrame:
    """G7-G9 per app that has reviews; price from ``app_info`` (missing -> not paid)."""
    stats = review_stats(reviews)
    j = stats.join(app_info.select("appid", "price"), "appid", "left")
    return j.withColumns(penalty_columns(F.col("price"))).select(
        "appid", "n_reviews", "opt_penalty", "value_penalty", "refund_penalty")


def critical_flaws(topics: DataFrame, polarity: str | None = "positive", keywords: Sequence[str] = CRITICAL_FLAW_KEYWORDS) -> DataFrame:
    """App has a topic whose keywords+summary contain any of the flaw ``keywords``
    (case-sensitive substring). ``topics`` has appid, polarity, keywords, summary."""
    if polarity is not None:
        topics = topics.filter(F.col("polarity") == polarity)
    text = F.concat(F.coalesce("keywords", F.lit("")), F.coalesce("summary", F.lit("")))
    hit = F.lit(False)
    for kw in keywords:
        hit = hit | F.contains(text, F.lit(kw))
    return topics.groupBy("appid").agg(F.bool_or(hit).alias("flaw_detected"))


def suggestion(score: Column, opt: Column, value: Column, refund: Column, flaw: Column) -> Column:
    """Banded text, <25 overrides, then up to four notes when score < 75."""
    band = (F.when(score < 25, F.lit(SUGGEST_BELOW_25))
            .when(score > 90, F.lit(SUGGEST_ABOVE_90))
            .when(score > 75, F.lit(SUGGEST_ABOVE_75))
            .when(score > 50, F.lit(SUGGEST_ABOVE_50))
            .otherwise(F.lit(SUGGEST_OTHER)))
    low = score < NOTE_MAX_SCORE

    def note(cond, text):
        return F.when(low & cond, F.lit(text)).otherwise(F.lit(""))

    return F.concat(band,
                    note(opt > NOTE_OPT_ABOVE, NOTE_OPT),
                    note(value > NOTE_VALUE_ABOVE, NOTE_VALUE),
                    note(refund > NOTE_REFUND_ABOVE, NOTE_REFUND),
                    note(F.coalesce(flaw, F.lit(False)), NOTE_FLAW))


def score_inputs(reviews: DataFrame, app_info: DataFrame, app_summary: DataFrame) -> DataFrame:
    """Per app (in ``app_info`` or ``reviews``): penalties, base and final score.
    One row per app; everything G10/G11 needs except the flaw flag."""
    stats = review_stats(reviews)
    apps = (app_info.select("appid", "price")
            .join(stats, "appid", "full_outer")
            .join(app_summary.select("appid", "review_score_desc"), "appid", "left"))
    apps = apps.withColumns(penalty_columns(F.col("price")))
    base = base_score("review_score_desc")
    total = F.col("opt_penalty") + F.col("value_penalty") + F.col("refund_penalty")
    final = F.least(F.greatest(base.cast("double") - total, F.lit(0.0)), F.lit(100.0)).cast("int")
    return apps.withColumns({"base": base, "final_score": final,
                             "has_reviews": F.coalesce(F.col("n_reviews"), F.lit(0)) > 0})


def flaw_candidates(inputs: DataFrame) -> DataFrame:
    """Apps whose suggestion a flaw keyword can change (reviews, final < 75);
    topics are only needed for these."""
    return inputs.filter(F.col("has_reviews") & (F.col("final_score") < NOTE_MAX_SCORE)).select("appid")


def finish_score(inputs: DataFrame, flaws: DataFrame | None = None) -> DataFrame:
    """G10 + G11 output from ``score_inputs`` and optional ``critical_flaws``."""
    if flaws is not None:
        inputs = inputs.join(flaws.select("appid", "flaw_detected"), "appid", "left")
    else:
        inputs = inputs.withColumn("flaw_detected", F.lit(False))
    has = F.col("has_reviews")
    score = F.when(has, F.col("final_score")).otherwise(F.lit(NEUTRAL_SCORE))
    text = F.when(has, suggestion(F.col("final_score"), F.col("opt_penalty"), F.col("value_penalty"),
                                  F.col("refund_penalty"), F.col("flaw_detected"))
                  ).otherwise(F.lit(SUGGEST_NO_REVIEWS))
    return inputs.select(
        "appid",
        F.when(has, F.col("base")).otherwise(F.lit(None).cast("int")).alias("base_score"),
        score.alias("score"),
        score_class(score).alias("score_class"),
        text.alias("suggestion"),
    )


def recommend_score(reviews: DataFrame, app_info: DataFrame, app_summary: DataFrame,
                    flaws: DataFrame | None = None) -> DataFrame:
    """G10 + G11 for every app in ``app_info`` or ``reviews``.

    Apps without reviews get the neutral score and its fixed message.
    ``flaws`` is the output of ``critical_flaws`` (optional)."""
    return finish_score(score_inputs(reviews, app_info, app_summary), flaws)
