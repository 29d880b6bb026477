"""Topic chains over the stand-in tables.

* reviews: one topic model per (app, polarity), given topics from
  ``v_review_topics`` (language; short reviews are outliers)
* documents: one corpus, topics = ``documents.source``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.constants import DOMAIN_STOPWORDS
from plaudit.operators import topics as TP
from plaudit.sources import standins as S

REVIEW_GROUP = ["appid", "polarity"]


def polarity(col: str = "voted_up"):
    return F.when(F.col(col), F.lit("positive")).otherwise(F.lit("negative"))


def review_topic_input(reviews: DataFrame) -> DataFrame:
    return S.v_review_topics(reviews).withColumn("polarity", polarity())


def review_topics(reviews: DataFrame, only_polarity: str | None = None,
                  materialize_as: str | None = "table") -> TP.TopicChain:
    """Topic chain per (app, polarity). Groups are independent, so asking for
    one polarity filters the reviews first and does half the work.
    ``materialize_as=None`` suits callers that read each intermediate once."""
    src = review_topic_input(reviews)
    if only_polarity is not None:
        src = src.filter(F.col("polarity") == only_polarity)
    return TP.describe_topics(src, REVIEW_GROUP, "review_id", "content", "topic_label", DOMAIN_STOPWORDS,
                              materialize_as=materialize_as)


def review_topic_map(reviews: DataFrame, only_polarity: str | None = None) -> DataFrame:
    return review_topics(reviews, only_polarity)["topic_map"]


def document_topics(spark, sf: str) -> TP.TopicChain:
    d = S.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("topic_label"))
    return TP.describe_topics(d, [], "doc_id", "text", "topic_label", DOMAIN_STOPWORDS)
