"""Table rules, sources and sinks."""

import datetime as dt
import os

from pyspark.sql import functions as F

from plaudit import constants as K
from plaudit.sources import pages as P
from plaudit.sources import tables as TB

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def test_empty_reviews_keep_schema(spark):
    df = P.empty_reviews(spark)
    assert df.count() == 0
    assert [f.name for f in df.schema] == [f.name for f in P.REVIEW_TABLE]


def test_write_reviews_replaces_only_present_apps(spark, tmp_dir):
    path = os.path.join(tmp_dir, "reviews")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "appid int, content string")
    TB.write_reviews(a, path)
    TB.write_reviews(spark.createDataFrame([(1, "z")], "appid int, content string"), path)
    got = sorted((r.appid, r.content) for r in TB.read_reviews(spark, path).collect())
    assert got == [(1, "z"), (2, "c")]
    assert TB.read_reviews(spark, path, [2]).count() == 1


def _summary(spark, rows):
    return spark.createDataFrame(rows, "appid int, last_updated timestamp_ntz, total_positive long, "
                                       "total_negative long, review_score_desc string")


def test_upsert_last_writer_wins_and_defaults(spark):
    old = _summary(spark, [(1, NOW, 5, 5, "Mixed"), (2, NOW, 1, 1, "Positive")])
    new = _summary(spark, [(1, NOW, None, None, None), (3, NOW - dt.timedelta(hours=1), 2, 0, "Negative")])
    got = {r.appid: r for r in TB.upsert_summary(old, new).collect()}
    assert (got[1].total_positive, got[1].total_negative, got[1].review_score_desc) == (0, 0, K.NO_RATING)
    assert got[2].review_score_desc == "Positive" and got[3].total_positive == 2


def test_freshness_strict_six_hours(spark):
    meta = _summary(spark, [(1, NOW - dt.timedelta(hours=6), 0, 0, "x"),
                            (2, NOW - dt.timedelta(hours=5, minutes=59), 0, 0, "x")])
    apps = spark.createDataFrame([(1,), (2,), (3,)], "appid int")
    got = {r.appid: r.is_fresh for r in TB.fresh_apps(apps, meta, NOW).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_plan_refresh_and_recompute(spark):
    meta = _summary(spark, [(1, NOW, 0, 0, "x"), (2, NOW, 0, 0, "x"), (3, NOW, 0, 0, "x")])
    req = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "appid int, force boolean")
    rev = spark.createDataFrame([(1,), (2,)], "appid int")
    plan = {r.appid: r.action for r in TB.plan_refresh(req, meta, rev, NOW).collect()}
    assert plan == {1: "HIT", 2: "FETCH", 3: "FETCH", 4: "FETCH"}
    apps = spark.createDataFrame([(1, False), (2, True), (3, False)], "appid int, fresh_fetch boolean")
    arts = spark.createDataFrame([(1, k) for k in K.ARTEFACT_KINDS] + [(3, "score")], "appid int, kind string")
    rec = {r.appid: r.recompute for r in TB.plan_recompute(apps, arts).collect()}
    assert rec == {1: False, 2: True, 3: True}


def test_load_stopwords(spark, tmp_dir):
    path = os.path.join(tmp_dir, "stop.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write("的\n若果 \n\n  \nthe\n")
    words = {r.word for r in TB.load_stopwords(spark, path, extra=["the", "game"]).collect()}
    assert words == {"的", "若果", "the", "game"}
    with_blank = {r.word for r in TB.load_stopwords(spark, path, extra=[], keep_blank=True).collect()}
    assert "" in with_blank
    rows = spark.createDataFrame([("的",), ("boss",)], "word string")
    assert [r.word for r in TB.remove_stopword_rows(rows, TB.load_stopwords(spark, path)).collect()] == ["boss"]


def test_artefact_round_trip_and_fallback(spark, tmp_dir):
    score = spark.createDataFrame([(1, 76, "好"), (2, 50, "x")], "appid int, score int, suggestion string")
    monthly = spark.createDataFrame([(1, "2024-02", 1, 0), (1, "2024-01", 2, 3)],
                                    "appid int, month string, positive long, negative long")
    radar = spark.createDataFrame([(1, i, n, 50.0) for i, n in enumerate(K.RADAR_NAMES)],
                                  "appid int, dim_idx int, dimension string, value double")
    stages = spark.createDataFrame([(1, i, s, 50.0, 40.0) for i, s in enumerate(K.PLAYTIME_LABELS)],
                                   "appid int, stage_idx int, stage string, positive double, negative double")
    tmap = spark.createDataFrame([(1, "positive", 0, "a、b", "\"x\"")],
                                 "appid int, polarity string, topic_id int, keywords string, summary string")
    words = spark.createDataFrame([(1, "positive", 0, 1, "a", 10)],
                                  "appid int, polarity string, topic_id int, rank int, word string, value int")
    arts = (TB.artefact_score(score).unionByName(TB.artefact_timeseries(monthly))
            .unionByName(TB.artefact_radar(radar)).unionByName(TB.artefact_playtime(stages))
            .unionByName(TB.artefact_topics(tmap, words, "positive")))
    path = os.path.join(tmp_dir, "arts")
    TB.export_artefacts(arts, path)
    back = TB.read_artefacts(spark, path)
    ts = back.filter((F.col("appid") == 1) & (F.col("kind") == "timeseries")).first().json
    assert ts == '{"dates":["2024-01","2024-02"],"positive_counts":[2,1],"negative_counts":[3,0]}'
    apps = spark.createDataFrame([(1,), (2,)], "appid int")
    got = {r.appid: r for r in TB.load_artefacts(apps, back).collect()}
    assert got[1].recommend_score == 76 and got[1].from_artefacts
    assert got[1].topic_map_json == '{"0":{"keywords":"a、b","summary":"\\"x\\""}}'
    assert (got[2].recommend_score, got[2].suggestion, got[2].radar_json) == (50, K.ARTEFACT_READ_FAILED, "{}")


def test_page_rules(spark):
    import json

    def page(success, cursor, reviews):
        d = {"success": success, "cursor": cursor, "query_summary": {"total_positive": 1, "total_negative": 2,
                                                                      "review_score_desc": "Mixed"}}
        if reviews is not None:
            d["reviews"] = reviews
        return json.dumps(d, ensure_ascii=False)

    r = {"author": {"steamid": "s"}, "review": "ok"}
    rows = [(1, i, page(1, f"c{i}", [r])) for i in range(12)]  # chain of 12 -> 10 kept
    rows += [(2, 0, page(1, "c", [r])), (2, 1, page(1, "c", [r])), (2, 2, page(2, "c", [r])), (2, 3, page(1, "c", [r]))]
    rows += [(3, 0, page(1, "c", [r])), (3, 1, page(1, None, [r])), (3, 2, page(1, "c", [r]))]
    rows += [(4, 0, page(1, "c", [r])), (4, 1, page(1, "c", None))]
    pages = spark.createDataFrame(rows, "appid long, page_no int, json string")
    got = {}
    for x in P.valid_page_prefix(pages).collect():
        got.setdefault(x.appid, []).append(x.page_no)
    assert sorted(got[1]) == list(range(10)) and sorted(got[2]) == [0, 1]
    assert sorted(got[3]) == [0, 1] and sorted(got[4]) == [0]
    one = P.flatten_reviews(pages.filter("appid = 4 and page_no = 0")).first()
    assert (one.author_name, one.author_avatar, one.voted_up, one.votes_up, one.timestamp_created) == ("s", "", False, 0, 0)
    assert P.extract_summary(pages).filter("appid = 2").count() == 3


def test_topic_documents_of_apps_without_topics_are_empty(spark):
    tmap = spark.createDataFrame([(1, "negative", 0, "a、b", "s")],
                                 "appid int, polarity string, topic_id int, keywords string, summary string")
    words = spark.createDataFrame([(1, "negative", 0, 1, "a", 10)],
                                  "appid int, polarity string, topic_id int, rank int, word string, value int")
    apps = spark.createDataFrame([(1,), (2,)], "appid int")
    got = {r.appid: r.json for r in TB.artefact_topics(tmap, words, "negative", apps).collect()}
    assert got == {1: '{"topic_map":{"0":{"keywords":"a、b","summary":"s"}},"word_data":[{"name":"a","value":10,"topic_id":0}]}',
                   2: '{"topic_map":{},"word_data":[]}'}


def test_union_of_pulls_with_different_columns(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "id int, only_a string")
    b = spark.createDataFrame([(2, 7)], "id int, only_b int")
    got = sorted(((r.id, r.only_a, r.only_b) for r in P.union_pulls(a, b).collect()), key=str)
    assert got == [(1, "x", None), (1, "x", None), (2, None, 7)]
