"""Document embedding (M2).

Default: a hashed bag of words weighted by IDF and L2-normalised with Spark
ML (HashingTF -> IDF -> Normalizer); the IDF fit is one distributed
aggregation. A sentence-embedding model can be plugged in (``callbacks``): it
is built once per task and fed Arrow batches. ``lowrank`` gives dense vectors of few dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.functions.text import clean_for_topics, tokens
from plaudit.operators.callbacks import embedding_udf

DEFAULT_DIMS = 256


def embed(df: DataFrame, doc_col: str, text_col: str, dims: int = DEFAULT_DIMS,
          provider_factory: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """Returns (doc_col, embedding array<float>)."""
    if provider_factory is not None:
        return _provider_embed(df, doc_col, text_col, provider_factory)
    toks = df.select(doc_col, tokens(clean_for_topics(F.col(text_col))).alias("_tok"))
    pipe = Pipeline(stages=[
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ])
    model = pipe.fit(toks)
    return model.transform(toks).select(doc_col, vector_to_array("_vec", "float32").alias("embedding"))


def _provider_embed(df: DataFrame, doc_col: str, text_col: str, factory) -> DataFrame:
    return df.select(doc_col, embedding_udf(factory)(clean_for_topics(F.col(text_col))).alias("embedding"))
