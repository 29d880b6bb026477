"""Hashed term vectors: md5 buckets, term counts inside the row, smoothed inverse document frequencies.

A text's vector is an array of (bucket, tf), made without a shuffle: its tokens' buckets are sorted and runs
counted, so the work is n log n in the text. Only the table of document frequencies is aggregated, and it has at
most 2 ** bits rows whatever the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a hashed vector: 2 ** 16.
HASH_BITS = 16


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that is evaluated once per row, though lambdas read it many times (a projection may be inlined into them)."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def bucket(word: Column, bits: int = HASH_BITS) -> Column:
    """The bucket of a word: the first 32 bits of its md5, modulo 2 ** bits."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % (1 << bits)).cast("int")


def with_term_counts(df: DataFrame, tokens: Column, out: str = "vector", bits: int = HASH_BITS) -> DataFrame:
    """Add ``out``: array of (bucket, tf) by bucket; no tokens give an empty array."""
    df = computed(df, "_sorted", F.array_sort(F.transform(tokens, lambda w: bucket(w, bits))))
    n = F.size("_sorted")
    at = lambda i: F.get(F.col("_sorted"), i)
    heads = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | (at(i) != at(i - 1))))
    df = computed(df, "_heads", heads)
    ends = F.concat(F.slice("_heads", 2, F.greatest(F.size("_heads"), F.lit(1))), F.array(n))
    runs = F.zip_with("_heads", ends, lambda a, b: F.when(a.isNotNull(), F.struct(at(a).alias("bucket"), (b - a).alias("tf"))))
    return computed(df, out, F.filter(runs, lambda r: r.isNotNull())).drop("_sorted", "_heads")


def inverse_frequencies(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(bucket, idf): ln((1 + N) / (1 + df)) + 1 over the rows with a token; at most 2 ** bits rows.

    N is counted when this is called: ``vectors`` should be stored, or cheap."""
    some = vectors.where(F.size(vector_col) > 0)
    n = some.count()
    df = some.select(F.explode(vector_col).alias("_t")).groupBy(F.col("_t.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("df"))
    return df.select("bucket", (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1.0).alias("idf"))


def walsh_coordinates(vector: Column, dims: int) -> Column:
    """``dims`` coordinates of a vector along the first Walsh patterns of single bits (sign of component i by bit k of i), scaled so
    that distances never grow where the length is a power of two."""
    def along(k: int) -> Column:
        signed = F.transform(vector, lambda x, i: F.when(i.bitwiseAND(F.lit(1 << k)) != 0, -x.cast("double")).otherwise(x.cast("double")))
        return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(vector).cast("double"))
    return F.array(*[along(k) for k in range(dims)])


def coded_tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word number, distinct words) of the tokens of lists; null tokens are left out."""
    sizes = np.diff(np.asarray(lists.offsets).astype(np.int64)) if len(lists) else np.zeros(0, np.int64)
    if lists.null_count:
        sizes = np.where(np.asarray(lists.is_valid()), sizes, 0)
    codes = lists.flatten().dictionary_encode()
    number = codes.indices.fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(lists)), sizes)
    there = number >= 0
    return row[there], number[there].astype(np.int64), codes.dictionary


def bucket_counts(df: DataFrame, key_cols: Sequence[str], tokens: Column, bits: int = HASH_BITS) -> DataFrame:
    """(keys, buckets array<int>, times array<int>) for every row: the buckets of its tokens, in order, and how many tokens each has.

    Counted in the task that reads the row; a word's bucket is looked up once a batch."""
    keys = list(key_cols)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, words = coded_tokens(batch.column("_tokens"))
            buckets = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % (1 << bits) for w in words.to_pylist()], np.int64)
            found, times = np.unique((row << bits) | buckets[number], return_counts=True)
            offsets = pa.array(np.searchsorted(found >> bits, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(
                pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (found & ((1 << bits) - 1), times))], schema.names)

    return df.select(*keys, tokens.alias("_tokens")).mapInArrow(run, schema)


def inverse_bucket_frequencies(counts: DataFrame, bits: int = HASH_BITS) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each bucket over the rows of ``bucket_counts`` that have a token: 2 ** bits numbers, summed by task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            rows += int((np.diff(np.asarray(lists.offsets)) > 0).sum())
            total += np.bincount(np.asarray(lists.flatten()), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], rows))], ["bucket", "n"])

    sums = counts.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n, out = 0, np.zeros(1 << bits, np.int64)
    if len(sums):
        at, have = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
        n, out[at[at >= 0]] = int(have[at < 0].sum()), have[at >= 0]
    return np.log(float(n + 1) / (out + 1)) + 1.0
