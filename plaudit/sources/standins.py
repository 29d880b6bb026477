"""Stand-in review tables derived from the driver's test tables.

The production inputs (landed review pages, app details, summaries) are not
in the test data; these views derive equivalent tables from it with plain
joins and expressions, so all work grows with the given tables.

* ``v_review_events`` review rows without text: one per event
* ``v_reviews``    the same with the text of the document that shares the event's key, if there is one
* ``v_app_raw``    raw app-details records from ``part``
* ``v_app_info``   normalised app info (A6 applied to ``v_app_raw``)
* ``v_app_summary`` per-app summary rows counted from ``v_reviews``
* ``v_profiles``   player profiles from ``customer``
* ``v_review_topics`` a given topic assignment per review

Each has a twin CTE in ``plaudit.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.constants import SCORE_COLUMNS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# FIXED VALUES: stand-in parameters
SUMMARY_BASE_TIME = _dt.datetime(2024, 6, 1, 12, 0, 0)
SUMMARY_RATINGS = [
    "Overwhelmingly Positive", "Very Positive (1,234)", "Mostly Positive", "Positive", "Mixed",
    "Mostly Negative", "Negative", "Overwhelmingly Negative", "No user reviews", "差评如潮", None,
]
# score column k is ((doc_id * mult + add) % 129) / 128: exact binary fractions
SCORE_MULT_ADD = [(7, 3), (11, 5), (13, 7), (17, 11), (19, 13)]
REVIEW_APPS, REVIEW_MONTHS, REVIEW_MONTH_STEP = 20, 83, 7
OUTLIER_MAX_CHARS = 200  # reviews shorter than this are outliers (-1) in the given topics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def review_scores(key: Column) -> list[Column]:
    return [((key * m + a) % 129 / F.lit(128.0)).alias(c)
            for c, (m, a) in zip(SCORE_COLUMNS, SCORE_MULT_ADD)]


def v_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows without text, one per event: what the metrics read, with no join.

    The app is ``user_id`` modulo 20; the date is the event's, put back by whole months' worth of days per author, so that
    reviews of one app spread over years with empty months between."""
    e = table(spark, sf_dir, "events")
    back = F.make_dt_interval((F.col("user_id") * REVIEW_MONTH_STEP % REVIEW_MONTHS * 31).cast("int"))
    return e.select(
        F.col("event_id").alias("review_id"),
        (F.col("user_id") % REVIEW_APPS).cast("int").alias("appid"),
        F.col("user_id").cast("string").alias("author_name"),
        F.col("event_type").isin("purchase", "click", "view").alias("voted_up"),
        F.floor(F.col("value") * 20).cast("bigint").alias("playtime_at_review"),
        F.get_json_object("props", "$.k").cast("int").alias("votes_up"),
        (F.col("ts").cast("timestamp_ntz") - back).alias("ts"),
        *review_scores(F.col("event_id")),
    )


def v_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_review_events`` with the text, language and length of the document of the same key; null where there is none."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("content"), "lang", "n_chars")
    return v_review_events(spark, sf_dir).join(d, "review_id", "left")


def v_app_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw app-details records (the shape of the store's app-details JSON)."""
    p = table(spark, sf_dir, "part")
    appid = F.col("p_partkey").cast("int")
    formatted = (F.when(appid == 3, F.lit("¥ 0.00"))
                 .when(appid == 4, F.lit(""))
                 .when(appid == 5, F.lit("Free"))
                 .otherwise(F.concat(F.lit("¥ "), F.format_number(F.col("p_retailprice") * 2, 2))))
    is_free = F.when(appid.isin(3, 4, 5), F.lit(False)).otherwise(F.col("p_type") == "PROMO")
    empty = F.array().cast("array<string>")
    return p.select(
        appid.alias("appid"),
        F.col("p_name").alias("name"),
        is_free.alias("is_free"),
        F.when(F.col("p_size").between(31, 33), F.lit(None).cast("struct<final_formatted:string>"))
        .otherwise(F.struct(formatted.alias("final_formatted"))).alias("price_overview"),
        F.when(F.col("p_size") < 10, empty).otherwise(F.array("p_brand")).alias("developers"),
        F.when(F.col("p_size") > 45, F.lit(None).cast("array<string>"))
        .otherwise(F.array("p_brand", "p_type")).alias("publishers"),
        F.when(F.col("p_size") > 40, F.lit(None).cast("struct<date:string>"))
        .otherwise(F.struct(F.concat(F.lit("2024-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"))
                            .alias("date"))).alias("release_date"),
        F.when(F.col("p_size").between(20, 25), F.lit(None)).otherwise(F.col("p_name")).alias("short_description"),
        F.when(F.col("p_size").between(26, 30), F.lit(None))
        .otherwise(F.concat(F.lit("header_"), appid.cast("string"), F.lit(".jpg"))).alias("header_image"),
        F.concat(F.lit("thumb_"), appid.cast("string"), F.lit(".jpg")).alias("tiny_image"),
    )


def v_app_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plaudit.sources.pages import normalise_app_info
    return normalise_app_info(v_app_raw(spark, sf_dir))


def v_app_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-app summary rows; ``last_updated`` is a fixed base minus appid hours."""
    counts = v_review_events(spark, sf_dir).groupBy("appid").agg(
        F.count_if(F.col("voted_up")).alias("total_positive"),
        F.count_if(~F.col("voted_up")).alias("total_negative"))
    ratings = F.array(*[F.lit(x).cast("string") for x in SUMMARY_RATINGS])
    return counts.select(
        "appid",
        (F.lit(SUMMARY_BASE_TIME).cast("timestamp_ntz")
         - F.make_dt_interval(F.lit(0), F.col("appid"))).alias("last_updated"),
        "total_positive", "total_negative",
        F.element_at(ratings, (F.col("appid") % len(SUMMARY_RATINGS) + 1).cast("int")).alias("review_score_desc"),
    )


def v_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # accounts in debt have no public profile (the look-up fails)
    return (c.filter(F.col("c_acctbal") >= 0)
            .select(F.col("c_custkey").cast("string").alias("steamid"),
                    F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None)).otherwise(F.col("c_name"))
                    .alias("personaname"),
                    F.when(F.col("c_nationkey") < 5, F.lit(None))
                    .otherwise(F.concat(F.lit("avatar_"), F.col("c_custkey").cast("string"), F.lit(".png")))
                    .alias("avatarfull")))


def v_review_topics(reviews: DataFrame) -> DataFrame:
    """Given topic assignment of the reviews with text: the review's language; short reviews are outliers (-1).

    Raw labels are strings; ``topic_info`` re-ranks them into ids by size."""
    return reviews.where(F.col("content").isNotNull()).select(
        "review_id", "appid", "voted_up", "content",
        F.when(F.col("n_chars") < OUTLIER_MAX_CHARS, F.lit("-1")).otherwise(F.col("lang")).alias("topic_label"))


# ---- landed review pages (A1-A4) ----------------------------------------------
# One page per conversation turn: appid = conv_id, page_no = turn, each line of
# the turn's text is one review. System turns are failed pages; long assistant
# turns lack the ``reviews`` key; short turns carry no next cursor.
PAGE_EPOCH_BASE = 1_700_000_000
PAGE_NO_REVIEWS_MIN_CHARS = 1500
PAGE_LAST_MAX_CHARS = 60


def v_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    lines = F.split(F.col("text"), "\n")
    review = lambda line, i: F.struct(
        F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("steamid"),
                 F.when(F.col("role") == "user", F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("av_"), F.col("conv_id").cast("string"))).alias("avatar"),
                 F.length(line).cast("bigint").alias("playtime_at_review")).alias("author"),
        line.alias("review"),
        (F.length(line) % 2 == 0).alias("voted_up"),
        (F.col("turn") + i).cast("bigint").alias("votes_up"),
        (F.lit(PAGE_EPOCH_BASE) + F.col("conv_id") * 86400 + F.col("turn") * 3600 + i).cast("bigint")
        .alias("timestamp_created"))
    reviews = F.when((F.col("role") == "assistant") & (F.length("text") > PAGE_NO_REVIEWS_MIN_CHARS), F.lit(None)) \
        .otherwise(F.transform(lines, lambda x, i: review(x, i)))
    page = F.struct(
        F.when(F.col("role") == "system", F.lit(2)).otherwise(F.lit(1)).alias("success"),
        F.when(F.length("text") < PAGE_LAST_MAX_CHARS, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), (F.col("turn") + 1).cast("string"))).alias("cursor"),
        F.struct((F.col("turn") * 10).cast("bigint").alias("total_positive"),
                 F.length("text").cast("bigint").alias("total_negative"),
                 F.col("role").alias("review_score_desc")).alias("query_summary"),
        reviews.alias("reviews"))
    return c.select(F.col("conv_id").alias("appid"), F.col("turn").alias("page_no"), F.to_json(page).alias("json"))


def v_app_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary metadata records: failed look-ups (status 404) for large parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("int").alias("appid"),
                    F.when(F.col("p_size") > 40, F.lit(404)).otherwise(F.lit(200)).alias("status"),
                    F.col("p_brand").alias("meta_developer"),
                    F.col("p_retailprice").alias("meta_price"))


def v_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms: every distinct part name and every word of one."""
    p = table(spark, sf_dir, "part").select("p_name")
    whole = p.select(F.col("p_name").alias("term"))
    words = p.select(F.explode(F.split("p_name", " ")).alias("term"))
    return whole.unionByName(words).distinct()


CLOCK_END = "2030-01-01 00:00:00"


def v_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache refreshes: an author's sign-ups as (appid, last_updated), whole seconds."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("user_id").alias("appid"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("last_updated"))


def v_search_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms that are parts of names: whole names in capitals, pieces across words, one to three characters, and terms without a hit."""
    p = table(spark, sf_dir, "part").select("p_name")
    term = F.explode(F.array(F.upper("p_name"), F.substring("p_name", 2, 4), F.substring("p_name", 3, 7), F.substring("p_name", 1, 1), F.substring("p_name", 4, 2),
                             F.substring("p_name", 2, 3), F.concat(F.substring("p_name", 3, 5), F.lit("zq")), F.lit(""))).alias("term")
    return p.select(term).distinct()
