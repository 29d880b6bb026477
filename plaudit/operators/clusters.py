"""Topic discovery (M3): ``discover_topics`` finds dense places of low-rank text vectors (``lowrank``, ``density``);
``near_copy_topics`` groups near-duplicate texts by their MinHash bands.

Contract kept from the reviewed topic model: clusters smaller than
``min_topic_size`` are outliers (-1); the others get ids 0.. by size (desc);
empty input gives an empty result; fixed seed -> same labels.

Plan, per group (e.g. app x polarity), with no pairwise candidate lists:

1. word shingles -> MinHash signature (seeded ``xxhash64`` minima, one aggregation)
2. signature cut into bands; a document links to each of its band buckets
   (edges doc -> bucket, so a bucket shared by a third of all documents costs
   edges, not pairs)
3. connected components of the doc-bucket graph by iterative min-label
   propagation (two aggregations per round), lineage cut each round by a
   table written under the cluster's ``spark.checkpoint.dir``
4. component sizes -> topic ids, small components -> -1
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaudit.constants import MIN_TOPIC_SIZE
from plaudit.functions.text import clean_for_topics, tokens
from plaudit.functions.vectors import computed
from plaudit.operators.density import density_clusters
from plaudit.operators.lowrank import low_rank_embedding
from plaudit.session import materialize

SHINGLE = 3
BANDS = 8
ROWS_PER_BAND = 4
TOPIC_DIMS, TOPIC_EPS, TOPIC_LEAST = 3, 0.08, 0.2


def band_edges(df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str, shingle: int = SHINGLE,
               bands: int = BANDS, rows: int = ROWS_PER_BAND, seed: int = 42) -> DataFrame:
    """(group, doc, bucket) edges: one per band of the document's MinHash signature.

    The signature is ``bands * rows`` minima of seeded 64-bit hashes over the
    document's word shingles: one hash aggregation (the partial aggregate
    collapses each document inside its own task, so the shuffle carries one
    row per document). Each band's minima hash to one bucket id."""
    g = list(group_cols)
    toks = df.select(*g, doc_col, tokens(clean_for_topics(F.col(text_col))).alias("_tok"))
    grams = NGram(n=shingle, inputCol="_tok", outputCol="_sh").transform(toks)
    # texts shorter than one shingle: their tokens are the shingles; texts
    # without any token have no signature and end up as outliers
    sh = grams.select(*g, doc_col, F.explode(F.when(F.size("_sh") > 0, F.col("_sh")).otherwise(F.col("_tok")))
                      .alias("_s"))
    n = bands * rows
    mins = sh.groupBy(*g, doc_col).agg(*[F.min(F.xxhash64("_s", F.lit(seed * 1000 + i))).alias(f"_m{i}")
                                         for i in range(n)])
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"_m{b * rows + j}") for j in range(rows)]) for b in range(bands)])
    return mins.select(*g, doc_col, F.explode(keys).alias("bucket"))


def connected_components(edges: DataFrame, group_cols: Sequence[str], doc_col: str,
                         max_rounds: int | None = None) -> DataFrame:
    """Component label = smallest doc id reachable through shared buckets.

    Only buckets of two documents or more take part in the rounds; the others' documents are added at the end.
    Each round: bucket label = min over its docs; doc label = min over its
    buckets. Each round's labels are written to the shared checkpoint folder
    (``materialize``), so the plan stays one round deep and a lost executor
    costs at most one round. Runs to convergence (labels only decrease, so it
    ends within the graph's diameter); a given ``max_rounds`` that is reached
    before convergence raises rather than returning split components."""
    g = list(group_cols)
    edges = materialize(edges.select(*g, doc_col, "bucket").dropna(subset=[*g, doc_col]))
    alone = edges.select(*g, doc_col).distinct().withColumn("label", F.col(doc_col))
    # a bucket of one document links nothing: most of them
    shared = edges.groupBy(*g, "bucket").agg(F.min(doc_col).alias("_first"), F.max(doc_col).alias("_last")).where("_first != _last").select(*g, "bucket")
    edges = materialize(edges.join(shared, [*g, "bucket"], "left_semi"))
    labels = materialize(edges.select(*g, doc_col).distinct().withColumn("label", F.col(doc_col)))
    rounds = 0
    while True:
        rounds += 1
        bucket_min = edges.join(labels, [*g, doc_col]).groupBy(*g, "bucket").agg(F.min("label").alias("bl"))
        new = (edges.join(bucket_min, [*g, "bucket"]).groupBy(*g, doc_col).agg(F.min("bl").alias("nl"))
               .join(labels, [*g, doc_col])
               .select(*g, doc_col, F.least("label", "nl").alias("label"),
                       (F.col("nl") < F.col("label")).alias("_changed")))
        new = materialize(new)
        changed = new.filter("_changed").limit(1).count()
        labels = new.drop("_changed")
        if changed == 0:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
    return labels.unionByName(alone.join(labels, [*g, doc_col], "left_anti"))


def near_copy_topics(df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str,
                     min_topic_size: int = MIN_TOPIC_SIZE, seed: int = 42) -> DataFrame:
    """(group, doc, topic_id) by shared MinHash bands: topics of near copies."""
    g = list(group_cols)
    edges = band_edges(df, g, doc_col, text_col, seed=seed)
    labels = connected_components(edges, g, doc_col)
    sizes = labels.groupBy(*g, "label").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(*g).orderBy(F.col("size").desc(), F.col("label"))
    ranked = (sizes.filter(F.col("size") >= min_topic_size)
              .withColumn("topic_id", F.row_number().over(w) - 1).select(*g, "label", "topic_id"))
    out = labels.join(ranked, [*g, "label"], "left")
    docs = df.select(*g, doc_col)
    return docs.join(out.select(*g, doc_col, "topic_id"), [*g, doc_col], "left").select(
        *g, doc_col, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))


def discover_topics(df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str, min_topic_size: int = MIN_TOPIC_SIZE,
                    dims: int = TOPIC_DIMS, eps: float = TOPIC_EPS, least: float = TOPIC_LEAST, seed: int = 42) -> DataFrame:
    """M3: (group, doc, topic_id) for every input document, -1 for outliers.

    The texts of all groups are put on ``dims`` singular vectors of their TF-IDF matrix, at unit length; in each group the
    places with ``min_topic_size`` documents within ``eps`` are topics. A text without words, and one of whose (unit) TF-IDF vector
    less than the length ``least`` lies along these directions, is an outlier: they do not describe it."""
    g = list(group_cols)
    vectors = low_rank_embedding(df, [*g, doc_col], text_col, dims, seed=seed)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    vectors = computed(vectors, "length", length)
    described = F.when(F.col("length") >= least, F.transform("embedding", lambda x: x / F.col("length")))
    return density_clusters(vectors.select(*g, doc_col, described.alias("embedding")), doc_col, "embedding", dims, eps, min_topic_size, g, min_topic_size)
