"""The scored review table, stored for the analyses that follow (J5, A16): bucketed and sorted by app.

Every per-app analysis groups by appid and joins on it. Stored in buckets of the app, all of them read the table without an
exchange: Spark knows that equal apps are in one bucket. A hot app is one bucket's rows; partial aggregation folds them
inside the scan's task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plaudit.session import scratch_path

BUCKETS = 32


def store_reviews(reviews: DataFrame, name: str | None = None, buckets: int = BUCKETS) -> str:
    """Write the rows to a table under the shared checkpoint folder; returns its name in the session's catalogue. A table of that name is replaced."""
    name = name or f"plaudit_reviews_{uuid.uuid4().hex}"
    # one file a bucket: rows meet by app before they are written
    dealt = reviews.repartition(buckets, "appid").write.mode("overwrite").format("parquet").option("path", scratch_path(reviews.sparkSession, name))
    dealt.bucketBy(buckets, "appid").sortBy("appid").saveAsTable(name)
    return name


def stored_reviews(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
