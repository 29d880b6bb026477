"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import Kept

#: Edges that a task reduces to a forest.
TASK_EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between components (by root) as few as hold the same components together: each joins two that were apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    stay = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            stay.append(k)
    return a[stay], b[stay]


def reduced(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a, b), ``n`` of them, that hold the same nodes together: each task sends on a spanning forest of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        if held:
            a, b = forest(*(np.concatenate(side) for side in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.select("a", "b").repartition(-(-n // TASK_EDGES) or 1).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, kept: Kept, name: str) -> DataFrame:
    """(node, root) with root the smallest node of the component, for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps; each round is written, so lineage stays short. The
    edge list never grows, and a node with very many neighbours is one aggregated minimum, not a group."""
    first = kept.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}edges")
    now = kept.keep(reduced(first, first.count()), f"{name}0")
    kept.drop(f"{name}edges")
    seen, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.unionByName(low.where("n != low").select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct()
        step += 1
        now = kept.keep(small, f"{name}{step}")
        kept.drop(f"{name}{step - 1}")
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == seen:
            break
        seen = sign
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
