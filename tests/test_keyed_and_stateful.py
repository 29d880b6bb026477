"""The bucketed keyed table, timed refresh and page chains as streams, the stored review table, callbacks."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.operators import metrics as M
from plaudit.operators.callbacks import embedding_udf, tagger_udf, tokenizer_udf
from plaudit.operators.keywords import keyword_frequency
from plaudit.sources.pages import valid_page_prefix
from plaudit.sources.review_store import store_reviews, stored_reviews
from plaudit.sources.tables import plan_refresh
from plaudit.streaming import stateful as SF
from plaudit.streaming.keyed import KeyedTable

ROWS = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])


def add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))


def test_batches_write_what_they_touch(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    table = KeyedTable(spark, path, ROWS, ["k"], buckets=32)
    assert table.read().count() == 0
    table.merge(spark.range(20000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), 0, add)
    whole = table.bytes_of(0)
    for version in range(1, 5):
        touched = table.merge(spark.createDataFrame([(7, 10), (7, 5), (None, 1)], ROWS), version, add)
        assert len(touched) == 2 and table.bytes_of(version) < whole / 8
    got = {r.k: r.n for r in table.read().collect()}
    assert len(got) == 20001 and got[7] == 61 and got[None] == 4 and got[8] == 1
    assert table.versions() == [3, 4]  # older ones retired, their untouched buckets stay
    assert table.read(3).where("k = 7").first().n == 46
    assert sorted(os.listdir(f"{path}/data")) == ["v=0", "v=3", "v=4"]
    assert table.merge(spark.createDataFrame([], ROWS), 5, add) == [] and table.read().count() == 20001


def test_replay_after_a_crash_counts_once(spark, tmp_dir, monkeypatch):
    table = KeyedTable(spark, os.path.join(tmp_dir, "t"), ROWS, ["k"], buckets=4)
    batch = spark.createDataFrame([(i, 1) for i in range(50)], ROWS)
    table.merge(batch, 0, add)

    def crash(self, *args):
        raise RuntimeError("lost")

    for step in ("_commit", "_retire"):  # after the data and before the manifest; after the manifest
        with monkeypatch.context() as lost:
            lost.setattr(KeyedTable, step, crash)
            with pytest.raises(RuntimeError):
                table.merge(batch, 1, add)
        assert {r.n for r in table.read().collect()} == ({1} if step == "_commit" else {2})
    table.merge(batch, 1, add)  # the batch comes again
    assert {r.n for r in table.read().collect()} == {2} and table.versions() == [0, 1]


def test_transitions_of_one_app():
    h = 3_600_000
    out, ahead, last, following = SF.transitions([5 * h, 0, 20 * h], -1, 12 * h, 6 * h)
    assert (out, ahead, last, following) == ([(0, "HIT"), (5 * h, "HIT"), (11 * h, "FETCH")], [20 * h], -1, 20 * h)
    assert SF.transitions(ahead, last, 25 * h, 6 * h) == ([(20 * h, "HIT")], [], 20 * h, 26 * h)
    assert SF.transitions([0, 6 * h], -1, 6 * h, 6 * h)[0] == [(0, "HIT"), (6 * h, "HIT")]  # refreshed just in time


def test_refresh_stream_equals_plan_at_every_instant(spark, tmp_dir):
    rng = random.Random(5)
    start = dt.datetime(2024, 6, 1)
    rows = [(app, start + dt.timedelta(minutes=rng.randrange(0, 3000))) for app in range(6) for _ in range(rng.randint(1, 7))]
    schema = "appid long, last_updated timestamp_ntz"
    landed, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    rng.shuffle(rows)
    for part in (rows[:10], rows[10:], [(-1, dt.datetime(2030, 1, 1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    SF.run_to_table(SF.refresh_transitions(stream, delay="10 days"), out, f"refresh-{os.path.basename(tmp_dir)}").awaitTermination()
    got = sorted((r.appid, r.at, r.action) for r in spark.read.schema(SF.TRANSITIONS).parquet(out).collect())
    requests = spark.createDataFrame([(a, False) for a in range(7)], "appid long, force boolean")
    for hours in (1, 9, 20, 33, 47, 60):
        now = start + dt.timedelta(hours=hours)
        known = spark.createDataFrame([r for r in rows if r[1] <= now] or [(99, start)], schema).groupBy("appid").agg(F.max("last_updated").alias("last_updated"))
        want = {r.appid: r.action for r in plan_refresh(requests, known, known, now).collect()}
        for app in range(7):
            past = [action for a, at, action in got if a == app and at <= now]
            assert (past[-1] if past else "FETCH") == want[app], (app, hours)


def _page(n, ok=True, cursor=True, reviews=True):
    page = {"success": 1 if ok else 2, "query_summary": {}}
    if cursor:
        page["cursor"] = f"c{n}"
    if reviews:
        page["reviews"] = [{"review": f"p{n}", "voted_up": True}]
    return json.dumps(page)


def test_page_chains_in_any_order(spark, tmp_dir):
    rng = random.Random(6)
    rows = []
    for app in range(12):
        for pull in range(2):
            stop = rng.randrange(0, 14)
            for n in range(13):
                fine = n != stop or app % 4 == 3
                rows.append((app, pull, n, _page(n, ok=fine or app % 4 != 0, cursor=fine or app % 4 != 1, reviews=fine or app % 4 != 2)))
    rows.append((50, 0, 0, "not json"))
    rows.append((51, 0, 1, _page(1)))  # page 0 never comes: nothing is read
    schema = "appid long, pull long, page_no long, json string"
    shuffled = rows + rows[:20]  # some pages come twice
    rng.shuffle(shuffled)
    landed, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    for i in range(0, len(shuffled), 90):
        spark.createDataFrame(shuffled[i:i + 90], schema).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    SF.run_to_table(SF.page_chains(stream), out, f"chain-{os.path.basename(tmp_dir)}").awaitTermination()
    got = sorted((r.appid, r.pull, r.page_no) for r in spark.read.schema(SF.CHAIN).parquet(out).collect())
    batch = spark.createDataFrame([r for r in rows if r[0] != 51], schema).withColumn("appid", F.col("appid") * 10 + F.col("pull"))
    want = sorted((r.appid // 10, r.appid % 10, r.page_no) for r in valid_page_prefix(batch).collect())
    assert got == want and any(n == 9 for _, _, n in got) and not any(n > 9 for _, _, n in got)


def test_stored_reviews_need_no_exchange(spark):
    rows = spark.range(2000).select(F.col("id").alias("review_id"), (F.col("id") % 37).cast("int").alias("appid"), (F.col("id") % 3 == 0).alias("voted_up"), F.lit(0.5).alias("score_opt"))
    t = stored_reviews(spark, store_reviews(rows, buckets=8))
    both = M.polarity_counts(t).join(t.groupBy("appid").agg(F.avg("score_opt").alias("m")), "appid")
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, both.drop("m").collect())) == sorted(map(tuple, M.polarity_counts(rows).collect()))


def test_callbacks_are_built_once_a_task(spark):
    def tokenizer():
        built = []
        built.append(1)
        return lambda text: [*text.split(), str(len(built))]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "c"])], "id int, text string").coalesce(1)
    assert [r.w for r in df.select(tokenizer_udf(tokenizer)(F.col("text")).alias("w")).collect()] == [["a", "b", "1"], [], ["c", "1"]]
    assert [list(r.v) for r in df.select(embedding_udf(lambda: lambda ts: [[len(t), 1] for t in ts])(F.col("text")).alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="0 vectors for 3 texts"):
        df.select(embedding_udf(lambda: lambda ts: [])(F.col("text")).alias("v")).collect()
    reviews = spark.createDataFrame([(1, "cats run fast and cats sleep")], "appid int, content string")
    tagger = tagger_udf(lambda: lambda t: [(w, "n" if w == "cats" else "a" if w == "fast" else "v") for w in t.split()])
    got = {r.word: r["count"] for r in keyword_frequency(reviews, "content", ["appid"], tagger=tagger).collect()}
    assert got == {"cats": 2, "fast": 1}
