"""Keyword frequency for the word cloud.

Per app and polarity: display-cleaned text (T4) split into words, words of
one character and stopwords dropped, counted and ranked; a caller that draws
them passes how many it wants. An optional tagger keeps only
nouns and adjectives, as the reviewed part-of-speech filter does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.constants import HAN, PAT_SPLIT
from plaudit.functions.text import HAN_BIGRAMS, clean_for_keywords
from plaudit.sources.tables import remove_stopword_rows

KEYWORD_PUNCT = r"[.,!?]"


def keyword_tokens(c) -> Column:
    """Words of display-cleaned text: split on blanks and .,!? ; case kept;
    Han runs give character bigrams."""
    t = F.regexp_replace(c, KEYWORD_PUNCT, " ")
    han = F.regexp_replace(F.regexp_replace(t, f"([{HAN}]+)", " $1 "), HAN_BIGRAMS, "$1$2 ")
    t = F.when(t.rlike(f"[{HAN}]"), han).otherwise(t)
    return F.array_remove(F.split(t, PAT_SPLIT), "")


def keyword_frequency(reviews: DataFrame, text_col: str = "content", group_cols: Sequence[str] = ("appid", "polarity"),
                      stopwords: Sequence[str] = (), top_n: int | None = None,
                      tagger: Callable[[Column], Column] | None = None, stop_rows: DataFrame | None = None) -> DataFrame:
    """(group, word, count, rank) of every word; with ``top_n`` of the most frequent ones only.

    ``stop_rows`` (one column ``word``, as ``load_stopwords`` gives it) leave after counting, by an anti-join.

    ``tagger`` maps cleaned text to array<struct<word:string, tag:string>>;
    when given, only tags starting with n or a are kept."""
    g = list(group_cols)
    r = reviews.filter(F.col(text_col).isNotNull()).select(*g, clean_for_keywords(F.col(text_col).cast("string"))
                                                          .alias("_t"))
    if tagger is None:
        words = r.select(*g, F.explode(keyword_tokens(F.col("_t"))).alias("word"))
    else:
        tagged = r.select(*g, F.explode(tagger(F.col("_t"))).alias("_wt"))
        words = tagged.filter(F.col("_wt.tag").startswith("n") | F.col("_wt.tag").startswith("a")) \
            .select(*g, F.col("_wt.word").alias("word"))
    words = words.select(*g, F.regexp_replace("word", r"^\s+|\s+$", "").alias("word"))
    words = words.filter(F.length("word") > 1)
    if stopwords:
        words = words.filter(~F.col("word").isin(list(stopwords)))
    counts = words.groupBy(*g, "word").agg(F.count(F.lit(1)).alias("count"))
    if stop_rows is not None:
        counts = remove_stopword_rows(counts, stop_rows)
    w = Window.partitionBy(*g).orderBy(F.col("count").desc(), F.col("word"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)
