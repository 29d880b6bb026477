"""Streaming versions of the incremental parts.

S1: reviews arrive as files; a watermarked daily tumbling window per
(app, polarity) is counted in update mode, and each micro-batch upserts the
changed days into a versioned daily table (``foreachBatch``). Months are
rolled up from that table by the batch gap-fill (G6). Daily keys, unlike a
month key, let the watermark evict old state.

S2: summary rows arrive as files; each micro-batch is merged with the stored
summary by the keyed upsert rule (A11).

Both sinks are idempotent by batch id: batch ``n`` writes version ``n`` of a ``KeyedTable`` from
the version before it, so a replayed batch counts once, and only the buckets that a batch
touches are written. State and offsets live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.operators.metrics import gap_fill_months
from plaudit.session import checkpoint_dir, materialize
from plaudit.sources.tables import SUMMARY_COLS, summary_defaults, upsert_summary
from plaudit.streaming.keyed import BUCKETS, KeyedTable

DAILY_KEYS = ["appid", "day"]


def latest_version(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest committed version of a keyed table (empty if none)."""
    return KeyedTable(spark, path, schema, KEYS[tuple(schema.names)]).read()


DAILY_SCHEMA = T.StructType([
    T.StructField("appid", T.IntegerType()),
    T.StructField("day", T.DateType()),
    T.StructField("positive", T.LongType()),
    T.StructField("negative", T.LongType()),
])


def event_time(df: DataFrame, ts_col: str) -> Column:
    """An instant whose UTC reading is the event time, for any input type
    (timestamp without zone, timestamp, epoch seconds). Day windows are
    aligned to UTC midnight, so days never depend on the session time zone."""
    dtype = dict(df.dtypes)[ts_col]
    c = F.col(ts_col)
    if dtype == "timestamp_ntz":
        epoch = (F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
                 + F.second(c))
        return F.timestamp_seconds(epoch)
    if dtype == "timestamp":
        return c
    return F.timestamp_seconds(F.coalesce(c, F.lit(0)))


def daily_counts_stream(reviews: DataFrame, ts_col: str = "ts", watermark: str = "30 days") -> DataFrame:
    """Watermarked daily window counts per app in one row per (app, day)."""
    pos = F.col("voted_up") == F.lit(True)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return (reviews.select("appid", event_time(reviews, ts_col).alias("_ts"), pos.alias("_pos"))
            .withWatermark("_ts", watermark)
            .groupBy("appid", F.window("_ts", "1 day").alias("w"))
            .agg(F.count_if(F.col("_pos")).alias("positive"), F.count_if(~F.col("_pos")).alias("negative"))
            .select(F.col("appid").cast("int").alias("appid"), day.alias("day"), "positive", "negative"))


def add_days(spark: SparkSession, table_path: str, ts_col: str, buckets: int = BUCKETS):
    """foreachBatch function: count the batch by day and add it to the table. No row is late, whatever the order of
    dates; a replayed batch starts from the version before it, so it counts once."""
    table = KeyedTable(spark, table_path, DAILY_SCHEMA, DAILY_KEYS, buckets)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*DAILY_KEYS).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))

    def run(batch: DataFrame, batch_id: int) -> None:
        pos = F.col("voted_up") == F.lit(True)
        day = F.date_from_unix_date(F.floor(F.unix_seconds(event_time(batch, ts_col)) / 86400).cast("int"))
        new = batch.select(F.col("appid").cast("int").alias("appid"), day.alias("day"), F.when(pos, 1).otherwise(0).alias("positive"),
                           F.when(~pos, 1).otherwise(0).alias("negative"))
        new = new.groupBy(*DAILY_KEYS).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
        table.merge(materialize(new), batch_id, add)

    return run


def upsert_days(spark: SparkSession, table_path: str, buckets: int = BUCKETS):
    """foreachBatch function: replace the changed (app, day) rows."""
    table = KeyedTable(spark, table_path, DAILY_SCHEMA, DAILY_KEYS, buckets)

    def replace(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*DAILY_KEYS), DAILY_KEYS, "left_anti").unionByName(new)

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(materialize(batch.select(*DAILY_SCHEMA.names)), batch_id, replace)

    return run


def start_monthly_counts(spark: SparkSession, source_path: str, schema: T.StructType, table_path: str,
                         name: str = "monthly_counts", ts_col: str = "ts", watermark: str | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None, buckets: int = BUCKETS):
    """Start the stream; returns the StreamingQuery. Every row counts, however late (``add_days``).

    With ``watermark``, windows are aggregated in stream state instead, and rows older than the latest event time
    minus ``watermark`` that arrive in a later micro-batch are dropped."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    if watermark is None:
        writer = stream.writeStream.foreachBatch(add_days(spark, table_path, ts_col, buckets))
    else:
        writer = daily_counts_stream(stream, ts_col, watermark).writeStream.outputMode("update").foreachBatch(upsert_days(spark, table_path, buckets))
    q = writer.option("checkpointLocation", ckpt)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def monthly_from_daily(spark: SparkSession, table_path: str) -> DataFrame:
    """Months rolled up from the latest daily table version (G6 gap fill)."""
    daily = latest_version(spark, table_path, DAILY_SCHEMA)
    return gap_fill_months(daily.select("appid", F.trunc("day", "month").alias("month"), "positive", "negative"))


SUMMARY_SCHEMA = T.StructType([
    T.StructField("appid", T.IntegerType()),
    T.StructField("last_updated", T.TimestampNTZType()),
    T.StructField("total_positive", T.LongType()),
    T.StructField("total_negative", T.LongType()),
    T.StructField("review_score_desc", T.StringType()),
])


SUMMARY_KEYS = ["appid"]
KEYS = {tuple(DAILY_SCHEMA.names): DAILY_KEYS, tuple(SUMMARY_SCHEMA.names): SUMMARY_KEYS}
#: The version that holds the rows a summary table starts from.
INITIAL = -1


def upsert_summaries(spark: SparkSession, table_path: str, initial: DataFrame | None = None, buckets: int = BUCKETS):
    """foreachBatch function for S2: the stored summaries (at first ``initial``, written once) upserted with the batch by A11."""
    table = KeyedTable(spark, table_path, SUMMARY_SCHEMA, SUMMARY_KEYS, buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        if initial is not None and not table.versions():
            table.merge(initial.select(*SUMMARY_COLS), INITIAL, lambda old, new: new)
        table.merge(materialize(summary_defaults(batch)), batch_id, upsert_summary)

    return run


def start_summary_upserts(spark: SparkSession, source_path: str, table_path: str, name: str = "summaries",
                          initial: DataFrame | None = None, available_now: bool = True,
                          max_files_per_trigger: int | None = None, buckets: int = BUCKETS):
    """Start the stream; returns the StreamingQuery."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    reader = spark.readStream.schema(SUMMARY_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    q = (stream.writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(upsert_summaries(spark, table_path, initial, buckets)))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
