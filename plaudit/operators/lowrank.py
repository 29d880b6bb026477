"""Low-rank text vectors (M2): a distributed randomised SVD of the hashed TF-IDF matrix.

The matrix has one row a text and 2 ** bits columns, and is never dense: a row is its (bucket, weight) pairs. The
leading right singular vectors are found by subspace iteration on the Gram matrix: each pass multiplies every row
with the current basis and adds the outer products up, per task and then per bucket, so what travels and what the driver
holds is the basis, 2 ** bits rows of a few numbers, whatever the number of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.functions.text import clean_for_topics, tokens
from plaudit.functions.vectors import HASH_BITS, bucket_counts, computed, inverse_bucket_frequencies
from plaudit.session import materialize

#: Basis columns beyond the rank, and passes over the rows.
OVERSAMPLE, PASSES = 8, 5
#: Entries of the matrix that one multiplication takes.
CHUNK = 1 << 20


def tfidf_rows(df: DataFrame, key_cols: list[str], text_col: str, bits: int = HASH_BITS) -> DataFrame:
    """(keys, buckets array<int>, weights array<double>): unit TF-IDF rows; a text without words has an empty row.

    Rows never travel: words are counted by bucket in the task that reads the text, and the inverse frequencies (at most 2 ** bits numbers) are sent to the tasks."""
    clean = computed(df.select(*key_cols, text_col), "_clean", clean_for_topics(F.col(text_col)))
    counts = materialize(bucket_counts(clean, key_cols, tokens(F.col("_clean")), bits))
    shared = df.sparkSession.sparkContext.broadcast(inverse_bucket_frequencies(counts, bits))
    schema = T.StructType([*(counts.schema[c] for c in key_cols), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, times = batch.column("buckets"), batch.column("times")
            sizes = np.diff(np.asarray(buckets.offsets).astype(np.int64))
            w = np.asarray(times.flatten()) * shared.value[np.asarray(buckets.flatten())]
            row = np.repeat(np.arange(len(sizes)), sizes)
            w /= np.sqrt(np.bincount(row, w * w, minlength=len(sizes)))[row]
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key_cols), pa.ListArray.from_arrays(offsets, buckets.flatten()), pa.ListArray.from_arrays(offsets, pa.array(w))], schema.names)

    return counts.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(offsets, buckets, weights) of runs of rows with at most CHUNK entries together (a longer row is alone)."""
    cols = [batch.column(c) for c in ("buckets", "weights")]
    offs = np.asarray(cols[0].offsets).astype(np.int64)
    base, offs = offs[0], offs - offs[0]
    values = [np.asarray(c.values)[np.asarray(c.offsets)[0]:][:offs[-1]] for c in cols]
    row = 0
    while row < len(batch):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1)
        yield offs[row:end + 1] - offs[row], values[0][offs[row]:offs[end]], values[1][offs[row]:offs[end]]
        row = end


def _times(offs: np.ndarray, buckets: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows times the basis; an empty row gives zeros."""
    out = np.zeros((len(offs) - 1, basis.shape[1]))
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = np.add.reduceat(weights[:, None] * basis[buckets], offs[:-1][full], axis=0)
    return out


def gram_product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A' (A basis) over the rows of ``tfidf_rows``; one row a bucket comes back."""
    spark, width = rows.sparkSession, basis.shape[1]
    shared = spark.sparkContext.broadcast(basis)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(f"c{k}", T.DoubleType()) for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis_shape)
        for batch in batches:
            for offs, buckets, weights in _rows(batch):
                y = np.repeat(_times(offs, buckets, weights, shared.value), np.diff(offs), axis=0)
                for k in range(width):
                    total[:, k] += np.bincount(buckets, weights * y[:, k], minlength=len(total))
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, k]) for k in range(width))], schema.names)

    basis_shape = basis.shape
    sums = rows.select("buckets", "weights").mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)]).toArrow()
    out = np.zeros(basis.shape)
    if len(sums):
        out[sums.column("bucket").to_numpy()] = np.column_stack([sums.column(f"c{k}").to_numpy() for k in range(width)])
    shared.unpersist()
    return out


def singular_vectors(rows: DataFrame, rank: int, bits: int = HASH_BITS, passes: int = PASSES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(V [2 ** bits, rank], singular values): the leading right singular vectors. Each vector's largest entry is positive."""
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(1 << bits, rank + OVERSAMPLE)))[0]
    for _ in range(passes - 1):
        basis = np.linalg.qr(gram_product(rows, basis))[0]
    product = gram_product(rows, basis)
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    v = basis @ turn[:, order]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(rank)] < 0, -1.0, 1.0)
    return v, np.sqrt(np.maximum(values[order], 0))


def project(rows: DataFrame, v: np.ndarray, key_cols: list[str], unit: bool = False, out: str = "embedding") -> DataFrame:
    """(keys, embedding array<double>): each row times V, of unit length if asked; an empty row is zeros."""
    shared = rows.sparkSession.sparkContext.broadcast(v)
    schema = T.StructType([*(rows.schema[c] for c in key_cols), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([_times(*part, shared.value) for part in _rows(batch)] or [np.zeros((0, v_width))])
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            offs = pa.array(np.arange(len(x) + 1, dtype=np.int32) * v_width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key_cols), pa.ListArray.from_arrays(offs, pa.array(x.ravel()))], schema.names)

    v_width = v.shape[1]
    return rows.mapInArrow(run, schema)


def low_rank_embedding(df: DataFrame, key_cols: list[str], text_col: str, rank: int, bits: int = HASH_BITS, unit: bool = False, seed: int = 42) -> DataFrame:
    """M2: (keys, embedding) of every text: its TF-IDF row on the ``rank`` leading singular vectors of the whole corpus."""
    rows = materialize(tfidf_rows(df, key_cols, text_col, bits))
    v, _ = singular_vectors(rows, rank, bits, seed=seed)
    return project(rows, v, key_cols, unit)
