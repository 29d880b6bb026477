"""Streaming versions against the batch results."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from plaudit.operators.metrics import monthly_counts
from plaudit.streaming import monthly as ST

SCHEMA = T.StructType([T.StructField("appid", T.IntegerType()), T.StructField("voted_up", T.BooleanType()),
                       T.StructField("ts", T.TimestampNTZType())])


def test_streaming_months_equal_batch(spark, tmp_dir):
    d = dt.datetime
    batches = [
        [(1, True, d(2024, 1, 3)), (1, False, d(2024, 1, 20)), (2, True, d(2024, 3, 1))],
        [(1, True, d(2024, 4, 2)), (1, True, d(2024, 1, 3))],
        [(2, False, d(2024, 5, 9))],
    ]
    table = os.path.join(tmp_dir, "daily")
    # one appended file per arrival; the stream reads them all
    all_rows = [r for b in batches for r in b]
    flat = os.path.join(tmp_dir, "flat")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(flat)
    q = ST.start_monthly_counts(spark, flat, SCHEMA, table, name=f"s1-{os.path.basename(tmp_dir)}")
    q.awaitTermination()
    got = sorted(tuple(r) for r in ST.monthly_from_daily(spark, table).collect())
    want = sorted(tuple(r) for r in monthly_counts(spark.createDataFrame(all_rows, SCHEMA)).collect())
    assert got == want


def test_streaming_summary_upsert(spark, tmp_dir):
    now = dt.datetime(2024, 6, 1, 12)
    init = spark.createDataFrame([(1, now - dt.timedelta(hours=8), 1, 1, "Mixed")], ST.SUMMARY_SCHEMA)
    src = os.path.join(tmp_dir, "summ")
    spark.createDataFrame([(1, now, 5, 0, None), (2, now, 1, 2, "Negative")], ST.SUMMARY_SCHEMA) \
        .write.mode("append").parquet(src)
    table = os.path.join(tmp_dir, "summary_table")
    q = ST.start_summary_upserts(spark, src, table, name=f"s2-{os.path.basename(tmp_dir)}", initial=init)
    q.awaitTermination()
    got = {r.appid: r for r in ST.latest_version(spark, table, ST.SUMMARY_SCHEMA).collect()}
    assert (got[1].total_positive, got[1].review_score_desc) == (5, "无评分")
    assert got[2].total_negative == 2


def test_summary_upserts_in_several_batches(spark, tmp_dir):
    now = dt.datetime(2024, 6, 1, 12)
    src, table = os.path.join(tmp_dir, "summ"), os.path.join(tmp_dir, "summary_table")
    for hours, positive in ((0, 1), (3, 4), (1, 2), (2, 3)):
        spark.createDataFrame([(1, now + dt.timedelta(hours=hours), positive, 0, "Mixed"), (10 + hours, now, 1, 1, "Mixed")], ST.SUMMARY_SCHEMA) \
            .coalesce(1).write.mode("append").parquet(src)
    ST.start_summary_upserts(spark, src, table, name=f"s2n-{os.path.basename(tmp_dir)}", max_files_per_trigger=1).awaitTermination()
    got = {r.appid: r.total_positive for r in ST.latest_version(spark, table, ST.SUMMARY_SCHEMA).collect()}
    assert got == {1: 4, 10: 1, 11: 1, 12: 1, 13: 1}  # the latest row wins, whatever the order of arrival


def test_streaming_drops_rows_behind_the_watermark(spark, tmp_dir):
    d = dt.datetime
    files = [
        [(1, True, d(2024, 1, 1))],
        [(1, True, d(2024, 6, 1))],     # watermark moves to 2024-05-02
        [(1, False, d(2024, 6, 2))],    # one batch in between, on time
        [(1, False, d(2024, 1, 5))],    # far behind the watermark: dropped
    ]
    src = os.path.join(tmp_dir, "src")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    table = os.path.join(tmp_dir, "daily")
    q = ST.start_monthly_counts(spark, src, SCHEMA, table, name=f"late-{os.path.basename(tmp_dir)}",
                                watermark="30 days", max_files_per_trigger=1)
    q.awaitTermination()
    got = {r.month: (r.positive, r.negative) for r in ST.monthly_from_daily(spark, table).collect()}
    assert got["2024-01"] == (1, 0)          # the late negative row is not counted
    assert got["2024-06"] == (1, 1)


def test_no_row_is_late_without_a_watermark(spark, tmp_dir):
    d = dt.datetime
    files = [[(1, True, d(2024, 6, 1))], [(1, False, d(2024, 1, 5)), (2, True, d(2023, 2, 1))], [(1, True, d(2024, 6, 1))], [(2, False, d(2020, 1, 1))]]
    src, table = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "daily")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    ST.start_monthly_counts(spark, src, SCHEMA, table, name=f"all-{os.path.basename(tmp_dir)}", max_files_per_trigger=1).awaitTermination()
    want = sorted(tuple(r) for r in monthly_counts(spark.createDataFrame([r for f in files for r in f], SCHEMA)).collect())
    assert sorted(tuple(r) for r in ST.monthly_from_daily(spark, table).collect()) == want


def test_a_damaged_manifest_raises(spark, tmp_dir):
    table = os.path.join(tmp_dir, "broken")
    os.makedirs(os.path.join(table, "manifest"))
    with open(os.path.join(table, "manifest", "v=3.json"), "w") as out:
        out.write("not a manifest")
    with pytest.raises(Exception):
        ST.latest_version(spark, table, ST.DAILY_SCHEMA)
