"""Model callbacks as iterator ``pandas_udf``s (U2, U4): the model is built once a task and fed Arrow batches.

A factory takes no argument and returns the model; it is sent to the tasks, so it must not hold the model itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def tokenizer_udf(factory: Callable[[], Callable[[str], list[str]]]):
    """A Column function text -> array<string> for ``tokenizer=`` arguments. A null text gives an empty array."""
    @F.pandas_udf("array<string>")
    def tokenize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for series in texts:
            yield pd.Series([[] if t is None else list(model(t)) for t in series], dtype=object)

    return tokenize


def embedding_udf(factory: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """U4: a Column function text -> array<float>; the model gets a batch of texts (null: empty) and returns one vector each."""
    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for series in texts:
            vectors = model([t or "" for t in series])
            if len(vectors) != len(series):
                raise ValueError(f"{len(vectors)} vectors for {len(series)} texts")
            yield pd.Series([[float(x) for x in v] for v in vectors], dtype=object)

    return encode


def tagger_udf(factory: Callable[[], Callable[[str], list[tuple[str, str]]]]):
    """A part-of-speech tagger text -> array<struct<word, tag>> for ``tagger=`` arguments."""
    @F.pandas_udf("array<struct<word:string,tag:string>>")
    def tag(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for series in texts:
            yield pd.Series([[] if t is None else [{"word": w, "tag": g} for w, g in model(t)] for t in series], dtype=object)

    return tag
