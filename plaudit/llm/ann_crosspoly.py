"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform
and assigns each to the nearest signed axis. A query probes, in every table, the axes
nearest to it; what stands there is ranked exactly. The rows of a bucket and the queries that
probe it are both split into blocks of bounded size, every block of the one meets every
block of the other, and a task sends on only the best rows, so neither a large bucket nor a
popular one meets in one task and no candidate pairs are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plaudit.llm.common import Kept

TABLES, PROBES, BLOCK_ROWS = 10, 16, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Inner products of turned unit vectors with all signed axes, [rows, 2 * width]."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    unit = np.zeros((len(x), width))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    unit[:, :x.shape[1]] = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        unit = hadamard(unit * rng.choice([-1.0, 1.0], width))
    return np.concatenate([unit, -unit], 1)


def best_rows(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k largest inner products, ties to smaller ids, never its own id; scores summed the same way for any block."""
    out_q, out_v, out_s = [], [], []
    for row in range(0, len(q), 256):
        rough = q[row:row + 256] @ v.T
        own = q_ids[row:row + 256, None] == v_ids[None]
        rough[own] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        near = rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        near &= ~own
        a, b = np.nonzero(near)
        score = (q[row + a] * v[b]).sum(1)
        order = np.lexsort((v_ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        stay = place < k
        out_q.append(q_ids[row + a[stay]])
        out_v.append(v_ids[b[stay]])
        out_s.append(score[stay])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


HASHED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("tbl", T.IntegerType()),
                       T.StructField("bucket", T.IntegerType()), T.StructField("vec", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _hashed(rows: DataFrame, tables: range, probes: int | None, seed: int) -> DataFrame:
    """A row per table (and probe) and vector; probes None: only the nearest axis; 0: all axes."""
    kind = np.float32 if rows.schema["embedding"].dataType.elementType == T.FloatType() else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding")
            dims = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                raw = np.array([r.tobytes() for r in x.astype(kind)], object)
                for table in tables:
                    near = axes(x, table, seed)
                    picked = near.argmax(1)[:, None] if probes is None else np.argsort(-near, 1, kind="stable")[:, :probes or near.shape[1]]
                    times = picked.shape[1]
                    for part in range(times):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), table, np.int32)),
                                                          pa.array(picked[:, part].astype(np.int32)), pa.array(raw, pa.binary())], HASHED.names)

    return rows.mapInArrow(run, HASHED)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("dim", "tbl", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))


def _search(index: DataFrame, queries: DataFrame, k: int, kind: type) -> DataFrame:
    """Best rows of each block of each probed bucket for each block of its queries. The table of blocks has a row per bucket that
    both sides have, 2 * width * tables per dimension: bounded, so broadcast."""
    key = ["dim", "tbl", "bucket"]
    sizes = F.broadcast(_blocks(index, "blocks").join(_blocks(queries, "parts"), key))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, key).withColumn("block", own("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    right = queries.join(sizes, key).withColumn("part", own("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")

    def rank(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, y = (np.frombuffer(b"".join(p["vec"]), kind).astype(np.float64).reshape(len(p), -1) for p in (v, q))
        a, b, s = best_rows(y, q["vec_id"].to_numpy(), x, v["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return left.groupBy(*key, "block", "part").cogroup(right.groupBy(*key, "block", "part")).applyInPandas(rank, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = 5, kept: Kept | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row of ``vectors`` (vec_id, embedding) that ``is_query`` marks.

    Nearness is the largest inner product in double precision, ties to the smaller id. Rows with a null id, or a
    vector that is null, empty, zero or holds null or non-finite components, take no part; vectors are compared with
    those of their own dimension. Rows that share an id are one candidate, with their best score, and never their own
    neighbours. A query for which fewer than k rows were found is searched in all buckets of one table, which is
    exact. Other columns are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    kept = kept or Kept(spark, "ann")
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)))
    kind = np.float32 if rows.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    index = kept.keep(_hashed(rows, range(tables), None, seed), "index")
    wanted = rows.where(is_query)
    first = kept.keep(_search(index, _hashed(wanted, range(tables), probes, seed), k, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    short = wanted.join(first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    rest = _search(index.where("tbl = 0"), _hashed(short, range(1), 0, seed), k, kind)
    found = first.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
