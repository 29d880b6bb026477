"""Hand-made edge rows."""

import datetime as dt

from plaudit import constants as K
from plaudit.functions import rating as R
from plaudit.functions import text as TX
from plaudit.functions.numeric import playtime_stage, row_mean, with_default_scores
from plaudit.operators import metrics as M
from plaudit.operators import score as SC


def test_playtime_bins_right_closed(spark):
    vals = ["-1", "0", "120", "121", "600", "601", "1200", "1201", "999999", "1000000", None, "abc"]
    df = spark.createDataFrame([(v,) for v in vals], "m string")
    got = [r.s for r in df.select(playtime_stage("m").alias("s")).collect()]
    L = K.PLAYTIME_LABELS
    assert got == [None, L[0], L[0], L[1], L[1], L[2], L[2], L[3], L[3], None, None, None]


def test_row_mean_skips_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"), 0.0, 0.5), (None, None, None, None, None)],
                               ",".join(f"{c} double" for c in K.SCORE_COLUMNS))
    got = [r.m for r in df.select(row_mean().alias("m")).collect()]
    assert got[0] == 0.5 and got[1] is None


def test_rating_first_contained_key(spark):
    texts = ["Overwhelmingly Negative", "差评如潮", "Very Positive (1,234)", "Mixed", "whatever", "", None, "No user reviews"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(R.base_score("t").alias("b"), R.translate_rating("t").alias("d")).collect()
    # 'Negative' precedes 'Overwhelmingly Negative': the value 5 is unreachable
    assert [r.b for r in rows] == [10, 10, 88, 60, 50, 50, 50, 50]
    assert [r.d for r in rows] == ["差评", "差评如潮", "特别好评", "褒贬不一", "whatever", "", "无评分", "无评分"]


def test_is_paid(spark):
    prices = ["¥ 1,298.00", "¥ 0.00", "Free", "免费", "0", "", None]
    df = spark.createDataFrame([(p,) for p in prices], "p string")
    assert [r.x for r in df.select(R.is_paid("p").alias("x")).collect()] == [True, True, False, False, False, False, False]


def test_clean_for_scoring_patterns(spark):
    rows = [("看这 @玩家abc #话题 http://a.b/c 好 <b>x</b>　",), ("<i\n>tag</i>",), (None,), ("",),
            ("http://only.url",), ("😀" * 600,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.c for r in df.select(TX.clean_for_scoring("t").alias("c")).collect()]
    assert got[0] == "看这    好 x"
    assert got[1] == "tag"
    assert got[2] == " " and got[3] == " " and got[4] == " "
    assert got[5] == "😀" * 512


def test_clean_for_topics_and_keywords(spark):
    df = spark.createDataFrame([("Hi <b>游戏</b> 2024! ok.",)], "t string")
    r = df.select(TX.clean_for_topics("t").alias("a"), TX.clean_for_keywords("t").alias("b")).first()
    assert r.a == "Hi 游戏       ok"
    assert r.b == "Hi 游戏 2024! ok."


def test_tokens_han_bigrams(spark):
    df = spark.createDataFrame([("Hello 世界和平 a 好",), ("",), ("ab中文cd",)], "t string")
    got = [r.x for r in df.select(TX.tokens("t").alias("x")).collect()]
    assert got == [["hello", "世界", "界和", "和平", "a", "好"], [], ["ab", "中文", "cd"]]


def test_card_text_and_hours(spark):
    df = spark.createDataFrame([(1, 1, "u", "x" * 100, True, 15, 3), (2, 1, "u", "y" * 101, False, 45, 0),
                                (3, 1, "u", "z", True, 9, 1)],
                               "review_id long, appid int, author_name string, content string, voted_up boolean, "
                               "playtime_at_review long, votes_up int")
    rows = {r.review_id: r for r in M.review_cards(df).collect()}
    assert rows[1].card_text == "x" * 100 and rows[2].card_text == "y" * 100 + "..."
    assert rows[1].hours == "0.2" and rows[2].hours == "0.8" and rows[3].hours == "0.2"


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "appid int, voted_up boolean, ts timestamp_ntz")


def test_months_disjoint_ranges(spark):
    d = dt.datetime
    r = _reviews(spark, [(1, True, d(2024, 1, 5)), (1, True, d(2024, 2, 5)), (1, False, d(2024, 6, 1))])
    got = sorted((x.month, x.positive, x.negative) for x in M.monthly_counts(r).collect())
    assert got == [("2024-01", 1, 0), ("2024-02", 1, 0), ("2024-06", 0, 1)]


def test_months_gap_inside_range(spark):
    d = dt.datetime
    r = _reviews(spark, [(1, True, d(2024, 1, 31)), (1, True, d(2024, 4, 1))])
    got = sorted((x.month, x.positive, x.negative) for x in M.monthly_counts(r).collect())
    assert got == [("2024-01", 1, 0), ("2024-02", 0, 0), ("2024-03", 0, 0), ("2024-04", 1, 0)]


def test_months_epoch_zero(spark):
    df = spark.createDataFrame([(1, False, 0), (1, False, None)], "appid int, voted_up boolean, t long")
    assert [(x.month, x.negative) for x in M.monthly_counts(df, "t").collect()] == [("1970-01", 2)]
    assert M.monthly_counts(df, "t", drop_epoch_zero=True).count() == 0


def test_playtime_sentiment_fill(spark):
    df = with_default_scores(spark.createDataFrame([(1, True, 60)], "appid int, voted_up boolean, playtime_at_review long"))
    rows = sorted(M.playtime_sentiment(df).collect(), key=lambda r: r.stage_idx)
    assert len(rows) == 4
    assert [r.positive for r in rows] == [50.0, 50.0, 50.0, 50.0]
    assert [r.negative for r in rows] == [50.0, 50.0, 50.0, 50.0]


def test_radar_no_positives_is_zero(spark):
    df = with_default_scores(spark.createDataFrame([(1, False)], "appid int, voted_up boolean"))
    assert [r.value for r in M.aspect_radar(df).collect()] == [0.0] * 5


def _score_inputs(spark, opt, value, n_neg, n_refund, price, rating):
    rows = []
    for i in range(n_neg):
        rows.append((1, False, 60 if i < n_refund else 500, opt, value))
    rows.append((1, True, 500, opt, value))
    reviews = spark.createDataFrame(rows, "appid int, voted_up boolean, playtime_at_review long, "
                                          "score_opt double, score_value double")
    info = spark.createDataFrame([(1, price)], "appid int, price string")
    summ = spark.createDataFrame([(1, rating)], "appid int, review_score_desc string")
    return reviews, info, summ


def test_worked_example(spark):
    # base 88, opt mean 0.2 -> 12, paid, value mean 0.1 -> 9, refund 5/10 -> 5: score 62
    reviews, info, summ = _score_inputs(spark, 0.2, 0.1, 10, 5, "¥ 68.00", "Very Positive")
    r = SC.recommend_score(reviews, info, summ).first()
    assert r.score == 62
    assert r.suggestion == K.SUGGEST_ABOVE_50 + K.NOTE_OPT + K.NOTE_VALUE


def test_score_cutoffs_and_clip(spark):
    cases = {98: K.SUGGEST_ABOVE_90, 82: K.SUGGEST_ABOVE_75, 60: K.SUGGEST_ABOVE_50, 50: K.SUGGEST_OTHER,
             10: K.SUGGEST_BELOW_25}
    for rating_score, text in cases.items():
        rating = next(k for k, v in K.RATING_BASE_SCORE if v == rating_score)
        reviews, info, summ = _score_inputs(spark, 1.0, 1.0, 1, 0, "免费", rating)
        r = SC.recommend_score(reviews, info, summ).first()
        assert r.score == rating_score and r.suggestion == text


def test_score_truncates(spark):
    # 98 - (1 - 0.8) * 15 = 95.0 ; 98 - (1-0.81)*15 = 95.15 -> 95
    reviews, info, summ = _score_inputs(spark, 0.81, 1.0, 1, 0, "免费", "好评如潮")
    assert SC.recommend_score(reviews, info, summ).first().score == 95


def test_app_without_reviews(spark):
    reviews = spark.createDataFrame([], "appid int, voted_up boolean, playtime_at_review long, "
                                        "score_opt double, score_value double")
    info = spark.createDataFrame([(7, "免费")], "appid int, price string")
    summ = spark.createDataFrame([], "appid int, review_score_desc string")
    r = SC.recommend_score(reviews, info, summ).first()
    assert (r.appid, r.score, r.suggestion) == (7, 50, K.SUGGEST_NO_REVIEWS)


def test_critical_flaws_case_sensitive(spark):
    t = spark.createDataFrame([(1, "positive", "画面、BUG", "fine"), (2, "positive", "闪退", ""),
                               (3, "negative", "bug", "")], "appid int, polarity string, keywords string, summary string")
    got = {r.appid: r.flaw_detected for r in SC.critical_flaws(t).collect()}
    assert got == {1: False, 2: True}
