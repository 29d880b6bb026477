"""Incremental assignment of unseen texts to stored topics (M8 without a refit).

The stored model is the class TF-IDF table of the topics found so far (group, topic_id, word, weight, idf). A text's
vector over the model's words is compared with every topic it shares a word with; the nearest topic takes it if the
cosine reaches the threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.functions.text import clean_for_topics, token_rows
from plaudit.operators.topics import COSINE_DIGITS


def assign_topics(df: DataFrame, model: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str, threshold: float,
                  stopwords: Sequence[str] = ()) -> DataFrame:
    """(group, doc, topic_id, cosine) for every row of ``df``; -1 and cosine 0 for a text without a known word, -1 below ``threshold``.

    Ties go to the smallest topic. A word's topics come as one row (at most the number of topics long), so each (text, word)
    row is joined once; a task folds a text's terms before the shuffle."""
    g = list(group_cols)
    norms = model.where("topic_id != -1").groupBy(*g, "topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    entry = F.when(F.col("norm") > 0, F.struct(F.col("topic_id").cast("int").alias("topic_id"), (F.col("weight") / F.col("norm")).alias("x")))
    known = model.join(norms, [*g, "topic_id"], "left").groupBy(*g, "word").agg(F.max("idf").alias("idf"), F.collect_list(entry).alias("topics"))
    words = token_rows(df, clean_for_topics(F.col(text_col)), "word", [*g, doc_col], stopwords).groupBy(*g, doc_col, "word").agg(F.count(F.lit(1)).alias("tf"))
    joined = words.join(known, [*g, "word"])
    weight = F.col("tf") * F.col("idf")
    # the text's own norm is summed as topic -1
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("topic_id"), (weight * weight).alias("x"))), F.transform("topics", lambda t: F.struct(t["topic_id"].alias("topic_id"), (weight * t["x"]).alias("x"))))
    sums = joined.select(*g, doc_col, F.explode(parts).alias("p")).groupBy(*g, doc_col, "p.topic_id").agg(F.sum("p.x").alias("x"))
    own = sums.groupBy(*g, doc_col).agg(F.max(F.when(F.col("topic_id") == -1, F.sqrt("x"))).alias("own"), F.collect_list(F.when(F.col("topic_id") != -1, F.struct("topic_id", "x"))).alias("dots"))
    near = F.transform("dots", lambda d: F.struct(F.bround(d["x"] / F.col("own"), COSINE_DIGITS).alias("cosine"), (-d["topic_id"]).alias("t")))
    best = own.where("own > 0").select(*g, doc_col, F.array_max(near).alias("best"))
    out = df.select(*g, doc_col).join(best, [*g, doc_col], "left")
    cosine = F.coalesce("best.cosine", F.lit(0.0))
    return out.select(*g, doc_col, F.when(F.col("best").isNotNull() & (cosine >= threshold), -F.col("best.t")).otherwise(F.lit(-1)).cast("int").alias("topic_id"), cosine.alias("cosine"))
