"""Aspect scoring: five independent [0,1] scores per review.

Scorers are plug-ins:

* ``neutral_scores``   every aspect 0.5 (no model available)
* ``text_scores``      (1 + cosine(review text, hypothesis text)) / 2 over hashed TF-IDF vectors
  of the texts themselves; the hypotheses are an argument
* ``prototype_scores`` (1 + cosine(review vector, aspect prototype)) / 2 with
  built-in higher-order functions; prototypes are five vectors (one per
  aspect), inlined as literals so no join is needed
* ``model_scores``     any batch model through ``mapInPandas``: the model is
  built once per task by a factory, texts are cleaned (T1/T2) on the JVM side
  first and scored in batches; a failing batch falls back to 0.5, as the
  reviewed scorer does
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.constants import NEUTRAL_ASPECT, SCORE_COLUMNS
from plaudit.functions.numeric import with_default_scores
from plaudit.functions.text import clean_for_scoring, clean_for_topics, tokens
from plaudit.functions.vectors import HASH_BITS, inverse_frequencies, with_term_counts
from plaudit.session import materialize

SCORE_DIGITS = 6
MODEL_BATCH = 8


def neutral_scores(reviews: DataFrame) -> DataFrame:
    """Neutral scores in all five columns."""
    return with_default_scores(reviews.drop(*[c for c in SCORE_COLUMNS if c in reviews.columns]))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def scoring_tokens(text: Column) -> Column:
    """Words of a review as scored: cleaned and cut (T1, T2), letters and Han characters only."""
    return tokens(clean_for_topics(clean_for_scoring(text)))


def text_scores(reviews: DataFrame, hypotheses: Sequence[str], text_col: str = "content", key_col: str = "review_id",
                bits: int = HASH_BITS) -> DataFrame:
    """M1: for each review (1 + cosine) / 2 of its own TF-IDF vector to each hypothesis text's, one score column a hypothesis.

    Document frequencies count all reviews with a word. A review without a word gets 0.5 in every column, as does
    every review against a hypothesis without a known word. The vectors are stored once; the table of frequencies (at most
    2 ** bits rows, so it may be broadcast), then sums over the stored vectors that a task folds to one row a review before the shuffle.
    ``key_col`` must be unique; other columns stay."""
    if len(hypotheses) != len(SCORE_COLUMNS):
        raise ValueError("one hypothesis per aspect is required")
    spark = reviews.sparkSession
    base = reviews.drop(*[c for c in SCORE_COLUMNS if c in reviews.columns])
    vectors = materialize(with_term_counts(base.select(key_col, text_col), scoring_tokens(F.col(text_col)), bits=bits).select(key_col, "vector"))
    idf = inverse_frequencies(vectors)
    said = spark.createDataFrame([(i, h) for i, h in enumerate(hypotheses)], "aspect int, text string")
    said = with_term_counts(said, scoring_tokens(F.col("text")), bits=bits).select("aspect", F.explode("vector").alias("_t"))
    by = said.groupBy(F.col("_t.bucket").alias("bucket")).agg(*[F.sum(F.when(F.col("aspect") == i, F.col("_t.tf"))).alias(f"_h{i}") for i in range(len(hypotheses))])
    table = idf.join(by, "bucket", "left").select("bucket", "idf", *[(F.coalesce(f"_h{i}", F.lit(0)) * F.col("idf")).alias(f"_h{i}") for i in range(len(hypotheses))])
    norms = table.agg(*[F.sqrt(F.sum(F.col(f"_h{i}") * F.col(f"_h{i}"))) for i in range(len(hypotheses))]).first()
    terms = vectors.select(key_col, F.explode("vector").alias("_t")).select(key_col, F.col("_t.bucket").alias("bucket"), F.col("_t.tf").alias("tf"))
    weight = F.col("tf") * F.col("idf")
    sums = terms.join(F.broadcast(table), "bucket").groupBy(key_col).agg(
        F.sqrt(F.sum(weight * weight)).alias("_n"), *[F.sum(weight * F.col(f"_h{i}")).alias(f"_d{i}") for i in range(len(hypotheses))])
    score = lambda i: F.bround((F.lit(1.0) + F.col(f"_d{i}") / (F.col("_n") * F.lit(norms[i]))) / 2, SCORE_DIGITS) if norms[i] else F.lit(NEUTRAL_ASPECT)
    scored = sums.select(key_col, *[score(i).alias(c) for i, c in enumerate(SCORE_COLUMNS)])
    out = base.join(scored, key_col, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(NEUTRAL_ASPECT)) for c in SCORE_COLUMNS})


def prototype_vectors(vectors: DataFrame, label_col: str = "label", key_col: str = "vec_id",
                      vec_col: str = "embedding", labels: Sequence[int] = (0, 1, 2, 3, 4)) -> list[list[float]]:
    """One exemplar vector per aspect: the lowest-keyed vector carrying label k.

    The result is exactly ``len(labels)`` vectors (checked), so bringing it to
    the driver is bounded by the number of aspects, not by the data."""
    ex = (vectors.filter(F.col(label_col).isin(list(labels)))
          .groupBy(label_col).agg(F.min_by(F.col(vec_col), F.col(key_col)).alias("v")))
    rows = {r[label_col]: [float(x) for x in r["v"]] for r in ex.collect()}
    missing = [k for k in labels if k not in rows]
    if missing:
        raise ValueError(f"no prototype vector for labels {missing}")
    return [rows[k] for k in labels]


def prototype_scores(reviews: DataFrame, vectors: DataFrame, prototypes: Sequence[Sequence[float]],
                     key_col: str = "review_id", vec_key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(1 + cosine) / 2 of each review's vector to each aspect prototype,
    rounded to 6 decimals; a review without a vector (the scorer "failed")
    gets 0.5 in every column."""
    if len(prototypes) != len(SCORE_COLUMNS):
        raise ValueError("one prototype per aspect is required")
    v = vectors.select(F.col(vec_key).alias(key_col), F.col(vec_col).cast("array<double>").alias("_v"))
    r = reviews.drop(*[c for c in SCORE_COLUMNS if c in reviews.columns]).join(v, key_col, "left")
    vn = F.sqrt(_dot(F.col("_v"), F.col("_v")))
    cols = {}
    for c, proto in zip(SCORE_COLUMNS, prototypes):
        p = F.array(*[F.lit(float(x)) for x in proto])
        pn = math.sqrt(sum(float(x) * float(x) for x in proto))
        cos = _dot(F.col("_v"), p) / (vn * F.lit(pn))
        score = F.bround((F.lit(1.0) + cos) / 2, SCORE_DIGITS)
        cols[c] = F.when(F.col("_v").isNull() | (vn == 0) | F.lit(pn == 0), F.lit(NEUTRAL_ASPECT)).otherwise(score)
    return r.withColumns(cols).drop("_v")


def model_scores(reviews: DataFrame, scorer_factory: Callable[[], Callable[[list[str]], list[dict]]] | None,
                 text_col: str = "content", batch_size: int = MODEL_BATCH, strict: bool = False,
                 failed_col: str | None = None) -> DataFrame:
    """M1 with a batch model. ``scorer_factory()`` returns ``score(texts) ->
    list of {score_column: value}``; it is called once per task. Texts are
    cleaned and cut to 512 characters in the JVM before crossing to Python.
    A missing factory gives neutral scores. A model that can't load, or a batch that fails, gives neutral scores too, as in
    the reviewed scorer; ``failed_col`` marks those rows, and ``strict`` raises instead."""
    if scorer_factory is None:
        if strict:
            raise ValueError("no scorer given")
        out = neutral_scores(reviews)
        return out.withColumn(failed_col, F.lit(True)) if failed_col else out
    base = reviews.drop(*[c for c in SCORE_COLUMNS if c in reviews.columns])
    base = base.withColumn("_clean", clean_for_scoring(F.col(text_col)))
    out_schema = T.StructType(base.schema.fields + [T.StructField(c, T.DoubleType()) for c in SCORE_COLUMNS]
                              + ([T.StructField(failed_col, T.BooleanType())] if failed_col else []))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        try:
            score = scorer_factory()
        except Exception:  # noqa: BLE001 - a model that cannot load scores neutral
            if strict:
                raise
            score = None
        for pdf in batches:
            failed = [True] * len(pdf)
            result = {c: [NEUTRAL_ASPECT] * len(pdf) for c in SCORE_COLUMNS}
            if score is not None and len(pdf):
                texts = pdf["_clean"].tolist()
                for start in range(0, len(texts), batch_size):
                    chunk = texts[start:start + batch_size]
                    try:
                        rows = list(score(chunk))
                        got = {c: [float(row.get(c, 0.0)) for row in rows] for c in SCORE_COLUMNS}
                        if len(rows) != len(chunk):
                            raise ValueError("scorer returned a different number of rows")
                    except Exception:  # noqa: BLE001 - failing batch -> neutral, as the source does
                        if strict:
                            raise
                        continue
                    failed[start:start + len(chunk)] = [False] * len(chunk)
                    for c in SCORE_COLUMNS:
                        result[c][start:start + len(chunk)] = got[c]
            out = pdf.assign(**{c: pd.Series(result[c], index=pdf.index, dtype="float64") for c in SCORE_COLUMNS})
            yield out.assign(**{failed_col: pd.Series(failed, index=pdf.index, dtype="bool")}) if failed_col else out

    return base.mapInPandas(run, out_schema).drop("_clean")
