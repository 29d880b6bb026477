"""Mixing sources to target weights by the cube method (balanced sampling).

Every document gets an inclusion number (its source's target over its source's
size): the whole part is taken for certain, the fraction is sampled. The flight
phase moves three fractions at a time along the null space of two constraints,
documents taken and words taken, until two fractions are left. It runs in blocks
of documents of one source, then again on what the blocks leave, until a source
is one block; only then the landing phase drops one constraint after the other.
So a source of any size is split over tasks and no task holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaudit.llm.common import WORD_PATTERN, Kept, bit_of, id_filter, id_picker, row_hash, small_batches

SMALL = 1e-9


def source_targets(sized: DataFrame, ratio: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """One row per source: its documents, size, weight and target.

    Sources by code point, null last, take ``weights`` in turn and share ``ratio`` of all
    sizes; no target is above ``cap`` times its source's size. Water filling in closed form:
    with the sources by cap reached first, the level is the largest of
    (total - first k caps) / (weights of the rest)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_units"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    total = Window.partitionBy()
    upto = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(total) * ratio - F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0.0))) / rest
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(total))
    return per.select("source", "source_size", "n_units", F.least(F.col("source_size") * F.lit(cap), F.col("level") * F.col("weight")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractions to 0 or 1, three at a time, keeping their sum and their sum of words; at most two stay fractional."""
    p, s, draws = pi.tolist(), size.tolist(), rng.random(len(pi) + 1).tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not SMALL < p[i] < 1 - SMALL:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        step = up if draws[i] * (up + down) < down else -down
        left = []
        for k, d in zip(active, u):
            p[k] += step * d
            if p[k] <= SMALL or p[k] >= 1 - SMALL:
                p[k] = float(round(p[k]))
            else:
                left.append(k)
        active = left
    return np.array(p)


def landing(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last fractions of a source: keep words balanced while two are left, then draw the last one."""
    p = pi.copy()
    while len(open_ := np.flatnonzero((p > SMALL) & (p < 1 - SMALL))) > 1:
        a, b = open_[:2]
        u = np.array([float(size[b]), -float(size[a])])
        room = [((1 - q) / d if d > 0 else q / -d, q / d if d > 0 else (1 - q) / -d) for q, d in zip(p[[a, b]], u)]
        up, down = min(r[0] for r in room), min(r[1] for r in room)
        step = up if rng.random() * (up + down) < down else -down
        p[[a, b]] += step * u
        p = np.where(p < SMALL, 0.0, np.where(p > 1 - SMALL, 1.0, p))
    for a in np.flatnonzero((p > SMALL) & (p < 1 - SMALL)):
        p[a] = float(rng.random() < p[a])
    return np.round(p)


def cube_mix(docs: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (3, 1, 2),
             block_rows: int = 4096, seed: int = 42, kept: Kept | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs`` (doc_id, text, source).

    ``size`` counts words (null text: 0); ``copies`` is how often the mix takes the document,
    a whole number up to ``cap`` (rounded up). A row without words is never taken (copies 0), so it
    needs no balancing. A null source is a source of its own; a null doc_id is an id, and rows that share
    id, source and size are rows like others, dealt over blocks by their number. An empty table gives an empty result. Other columns are not read. Draws are
    seeded by source and block and rows are taken in order of size and hashed id, so reruns agree."""
    spark = docs.sparkSession
    kept = kept or Kept(spark, "cube")
    sized = kept.keep(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")), "sized")
    targets = kept.keep(source_targets(sized, ratio, cap, weights), "targets").withColumnRenamed("source", "of")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # rows equal in source, id and size stand for each other: counted, then numbered, so that they are dealt over blocks
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("many"))
    units = units.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(block_rows).cast("long"))))
    units = units.withColumn("number", F.explode(F.sequence("first", F.least(F.col("first") + block_rows, F.col("many")) - 1))).drop("first", "many")
    units = units.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("share", share)
    units = units.withColumn("whole", F.floor(F.col("share") + SMALL))
    units = units.withColumn("pi", F.when((F.col("size") > 0) & (F.col("share") - F.col("whole") > SMALL), F.col("share") - F.col("whole")).otherwise(0.0))
    units = units.withColumn("place", F.xxhash64("doc_id", "size", "number", F.lit(seed))).drop("share", "number")
    schema = units.schema

    def run(last: bool):
        def balance(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            # large documents first: what stays open for the landing is small
            rows = rows.sort_values(["size", "place", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
            # the seed hashes the block's own rows, so it is the same in every run
            rng = np.random.default_rng([seed, int(key[1]), int(rows["place"].iloc[0]) & 0xFFFFFFFF, len(rows)])
            pi = flight(rows["pi"].to_numpy(float), rows["size"].to_numpy(float), rng)
            done = rows["blocks"].to_numpy() == 1
            if last and done.all():
                pi = landing(pi, rows["size"].to_numpy(float), rng)
            rows["pi"] = pi
            return rows[schema.names]
        return balance

    most = targets.agg(F.max("n_units")).first()[0] or 0
    fixed, open_ = [units.where("pi = 0")], units.where("pi > 0")
    per_block, level = block_rows, 0
    while True:
        blocks = F.ceil(F.col("n_units") / per_block).cast("long")
        last = most <= per_block
        dealt = open_.withColumn("blocks", F.greatest(blocks, F.lit(1))).withColumn("block", F.pmod(F.xxhash64("place", F.lit(level)), F.col("blocks")))
        moved = kept.keep(dealt.groupBy("source", "block").applyInPandas(run(last), schema), f"flight{level}")
        if last:
            fixed.append(moved)
            break
        fixed.append(moved.where("pi in (0, 1)"))
        open_ = moved.where("pi not in (0, 1)")
        # a block leaves two fractions at most
        per_block, level = per_block * block_rows // 2, level + 1
    out = fixed[0]
    for part in fixed[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, kept: Kept | None = None, **options) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as the mix takes it, with its columns.

    Rows are told apart by a hash of all columns, so ids may be null or shared and each row has its own number of copies;
    of rows equal in every column one stands for the copies of all. Draws go by that hash.

    Texts are not shuffled: for each number of copies a bitmap holds the keys of the rows that are taken so often, a second one the other
    keys that the first one holds by chance. A key in the first and not in the second is taken, one not in the first is not; only rows
    in both are joined with the plan. The bitmaps are of fixed size: with very many rows more of them are joined."""
    spark = docs.sparkSession
    kept = kept or Kept(spark, "mix")
    rows = docs.withColumn("__key", row_hash(*[F.col(c) for c in docs.columns]))
    plan = cube_mix(rows.select(F.col("__key").alias("doc_id"), "text", "source"), kept=kept, **options)
    plan = kept.keep(plan.groupBy(F.col("doc_id").alias("id")).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows")), "plan")
    several = plan.where("__rows > 1").select("id")
    levels = []
    for copies in range(1, (plan.where("__rows = 1").agg(F.max("__copies")).first()[0] or 1) + 1):
        some = plan.where("__rows = 1")
        taken = spark.sparkContext.broadcast(id_filter(some.where(F.col("__copies") >= copies).select("id").unionByName(several)))
        by_chance = id_picker(some.where(F.col("__copies") < copies).select("id"), "id", taken)
        levels.append((taken, spark.sparkContext.broadcast(id_filter(by_chance.unionByName(several)))))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, _ = _counted(batch, levels)
            yield batch.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_counted(batch, levels)[1]))

    small_batches(spark)
    asked = rows.mapInArrow(unsure, rows.schema)
    joined = asked.join(plan.where("__rows = 1 and __copies > 0").select(F.col("id").alias("__key"), "__copies"), "__key")
    shared = plan.where("__rows > 1 and __copies > 0").select(F.col("id").alias("__key"), "__copies")
    if not shared.isEmpty():
        joined = joined.unionByName(asked.join(shared, "__key").dropDuplicates(["__key"]))
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.mapInArrow(sure, rows.schema).select(*docs.columns).unionByName(joined.select(*docs.columns))


def _counted(batch: pa.RecordBatch, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """Copies of each row that the bitmaps settle (0 for others), and which rows they leave open."""
    at = bit_of(batch.column("__key").to_numpy(zero_copy_only=False))
    held = lambda bits: (bits.value[at >> 3] >> (at & 7)) & 1 == 1
    copies, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for taken, by_chance in levels:
        first, second = held(taken), held(by_chance)
        copies += first & ~second
        open_ |= first & second
    return np.where(open_, 0, copies), open_
