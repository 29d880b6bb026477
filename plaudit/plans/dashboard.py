"""Dashboard assembly (J5) and the per-app artefact documents.

Every piece is a one-row-per-app (or per app x kind) table, so the assembly
is a chain of left joins on appid that AQE turns into broadcast joins when
the measured sizes allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.functions.rating import translate_rating
from plaudit.operators import metrics as M
from plaudit.operators import score as SC
from plaudit.plans.topics_plan import review_topics
from plaudit.sources import tables as TB


def analyses(reviews: DataFrame, app_info: DataFrame, app_summary: DataFrame,
             polarity: str = "positive", scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All per-app analyses over one scored review table. ``scored``: the same rows where they are to be had without
    text, so that only the topics read (and join) it."""
    scored = reviews if scored is None else scored
    topics = review_topics(reviews)
    flaws = SC.critical_flaws(topics["topic_map"], polarity=polarity)
    return {
        "score": SC.recommend_score(scored, app_info, app_summary, flaws),
        "counts": M.polarity_counts(scored),
        "radar": M.aspect_radar(scored),
        "stages": M.playtime_sentiment(scored),
        "monthly": M.monthly_counts(scored, ts_col="ts"),
        "topic_map": topics["topic_map"],
        "words": topics["words"],
    }


def dashboard(app_info: DataFrame, app_summary: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """App x summary x counts x score, one row per app in ``app_info``."""
    summ = app_summary.select("appid", translate_rating("review_score_desc").alias("rating_display"))
    counts = parts["counts"]
    score = parts["score"].select("appid", "score", "score_class", "suggestion")
    j = (app_info.select("appid", "name", "price", "developer", "publisher", "release_date")
         .join(summ, "appid", "left").join(counts, "appid", "left").join(score, "appid", "left"))
    return j.select("appid", "name", "price", "developer", "publisher", "release_date",
                    F.coalesce("rating_display", F.lit("无评分")).alias("rating_display"),
                    F.coalesce("positive_count", F.lit(0)).cast("bigint").alias("positive_count"),
                    F.coalesce("negative_count", F.lit(0)).cast("bigint").alias("negative_count"),
                    "score", "score_class", "suggestion")


def artefacts(parts: dict[str, DataFrame]) -> DataFrame:
    """The six documents per reviewed app as rows (appid, kind, json); the topic
    documents of an app without topics are empty. Apps without reviews have a score only."""
    docs = [TB.artefact_score(parts["score"]), TB.artefact_radar(parts["radar"]),
            TB.artefact_playtime(parts["stages"]), TB.artefact_timeseries(parts["monthly"]),
            TB.artefact_topics(parts["topic_map"], parts["words"], "positive", parts["counts"]),
            TB.artefact_topics(parts["topic_map"], parts["words"], "negative", parts["counts"])]
    out = docs[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    return out
