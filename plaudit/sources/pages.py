"""Landed store records -> typed tables.

Pages and detail records arrive as JSON text (or already-typed structs);
parsing uses explicit schemas with ``from_json`` so nothing is inferred per
file, and defaults are applied with ``coalesce`` (the JSON reader cannot tell
a missing key from a null one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.constants import (ANONYMOUS_AUTHOR, DEFAULT_AVATAR, FREE_PRICE, MAX_PAGES, NO_DESCRIPTION,
                               PAT_SPLIT, PROFILE_NO_NAME, PROFILE_UNKNOWN, SAMPLE_PER_POLARITY, UNKNOWN)

AUTHOR = T.StructType([
    T.StructField("steamid", T.StringType()),
    T.StructField("avatar", T.StringType()),
    T.StructField("playtime_at_review", T.LongType()),
])
REVIEW = T.StructType([
    T.StructField("author", AUTHOR),
    T.StructField("review", T.StringType()),
    T.StructField("voted_up", T.BooleanType()),
    T.StructField("votes_up", T.LongType()),
    T.StructField("timestamp_created", T.LongType()),
])
SUMMARY = T.StructType([
    T.StructField("total_positive", T.LongType()),
    T.StructField("total_negative", T.LongType()),
    T.StructField("review_score_desc", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("success", T.IntegerType()),
    T.StructField("cursor", T.StringType()),
    T.StructField("query_summary", SUMMARY),
    T.StructField("reviews", T.ArrayType(REVIEW)),
])
SUMMARY_PAGE = T.StructType([PAGE["success"], PAGE["query_summary"]])

# A2: the typed, empty review table keeps this schema
REVIEW_TABLE = T.StructType([
    T.StructField("appid", T.LongType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("author_avatar", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("voted_up", T.BooleanType()),
    T.StructField("playtime_at_review", T.LongType()),
    T.StructField("votes_up", T.LongType()),
    T.StructField("timestamp_created", T.LongType()),
])


def parse_pages(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse landed page JSON into the ``PAGE`` struct (column ``page``)."""
    return pages.withColumn("page", F.from_json(F.col(json_col), PAGE))


def _review_row(r: Column, appid: Column) -> list[Column]:
    a = r["author"]
    return [
        appid.cast("bigint").alias("appid"),
        F.coalesce(a["steamid"], F.lit(ANONYMOUS_AUTHOR)).alias("author_name"),
        F.coalesce(a["avatar"], F.lit("")).alias("author_avatar"),
        F.coalesce(r["review"], F.lit("")).alias("content"),
        F.coalesce(r["voted_up"], F.lit(False)).alias("voted_up"),
        F.coalesce(a["playtime_at_review"], F.lit(0)).cast("bigint").alias("playtime_at_review"),
        F.coalesce(r["votes_up"], F.lit(0)).cast("bigint").alias("votes_up"),
        F.coalesce(r["timestamp_created"], F.lit(0)).cast("bigint").alias("timestamp_created"),
    ]


def flatten_reviews(pages: DataFrame, json_col: str = "json", keep: list[str] | None = None) -> DataFrame:
    """A1: one row per element of ``reviews`` with the source defaults; attaches appid.

    ``pages`` has ``appid`` and the page JSON text; ``keep`` names extra page
    columns to carry along (e.g. page number). The element position is kept
    as ``review_pos`` so rows stay addressable without positional joins."""
    keep = keep or []
    p = parse_pages(pages, json_col)
    exploded = p.select("appid", *keep, F.posexplode(F.col("page.reviews")).alias("review_pos", "r"))
    return exploded.select(*_review_row(F.col("r"), F.col("appid")), *keep, "review_pos")


def empty_reviews(spark) -> DataFrame:
    """A2: an empty review table that still has the full schema."""
    return spark.createDataFrame([], REVIEW_TABLE)


def extract_summary(pages: DataFrame, json_col: str = "json", keep: list[str] | None = None) -> DataFrame:
    """A3: the page's ``query_summary`` only when ``success == 1``."""
    keep = keep or []
    # only the two small fields are parsed; the reviews array is skipped
    p = pages.withColumn("page", F.from_json(F.col(json_col), SUMMARY_PAGE)).filter(F.col("page.success") == 1)
    s = F.col("page.query_summary")
    return p.select("appid", *keep,
                    s["total_positive"].alias("total_positive"),
                    s["total_negative"].alias("total_negative"),
                    s["review_score_desc"].alias("review_score_desc"))


def valid_page_prefix(pages: DataFrame, json_col: str = "json", page_col: str = "page_no",
                      max_pages: int = MAX_PAGES) -> DataFrame:
    """A4: the pages a cursor walk would read, per app, flattened to reviews.

    In ``page_col`` order and at most ``max_pages``: stop *before* the first page
    that failed (success != 1) or has no ``reviews``; stop *after* the first page
    without a next cursor. Rows of earlier pages are kept, with no dedup.
    A running count over the app's pages replaces the sequential loop."""
    p = parse_pages(pages, json_col)
    w = Window.partitionBy("appid").orderBy(page_col)
    # first the page budget: a group-limited top-k, so an app with very many
    # landed pages still sends at most max_pages rows per map task
    first = p.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_pages)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bad = ((F.coalesce(F.col("page.success"), F.lit(0)) != 1) | F.col("page.reviews").isNull()).cast("int")
    no_cursor = (F.col("page.cursor").isNull() | (F.col("page.cursor") == "")).cast("int")
    marked = first.select(
        "appid", page_col, "page",
        F.sum(bad).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_bad_upto"),
        F.coalesce(F.sum(no_cursor).over(before), F.lit(0)).alias("_end_before"))
    ok = marked.filter((F.col("_bad_upto") == 0) & (F.col("_end_before") == 0))
    exploded = ok.select("appid", page_col, F.posexplode("page.reviews").alias("review_pos", "r"))
    return exploded.select(*_review_row(F.col("r"), F.col("appid")), page_col, "review_pos")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), PAT_SPLIT), lambda x: F.length(x) > 0))


def resolve_app(terms: DataFrame, apps: DataFrame, term_col: str = "term") -> DataFrame:
    """A5: first app whose name contains every word of the search term.

    Candidates come from one equi-join on the term's *rarest* word (fewest
    apps carry it), then the other words are checked by array containment;
    so a common word never pairs a term with every app that uses it. First
    hit by (name length, appid); terms without a hit return a null appid."""
    t = terms.select(term_col).distinct()
    a = apps.select("appid", "name", _words(F.col("name")).alias("_nw"))
    app_freq = a.select(F.explode("_nw").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    tw = t.select(term_col, _words(F.col(term_col)).alias("_tw"))
    per_word = tw.select(term_col, "_tw", F.explode("_tw").alias("word")).join(app_freq, "word")
    # a term with a word no app carries has no hit (inner join drops it here)
    n_known = per_word.groupBy(term_col).agg(F.count(F.lit(1)).alias("_k"),
                                             F.min_by("word", F.struct("_df", "word")).alias("word"),
                                             F.first("_tw").alias("_tw"))
    rare = n_known.filter(F.col("_k") == F.size("_tw"))
    cand = rare.join(a.select("appid", "name", "_nw", F.explode("_nw").alias("word")), "word")
    hits = cand.filter(F.size(F.array_except("_tw", "_nw")) == 0)
    w = Window.partitionBy(term_col).orderBy(F.length("name"), "appid")
    best = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return t.join(best.select(term_col, "appid", "name"), term_col, "left")


def normalise_app_info(raw: DataFrame) -> DataFrame:
    """Store app details -> display info with the source defaults."""
    def joined(c):
        arr = F.col(c)
        return F.when(F.coalesce(F.size(arr), F.lit(-1)) > 0, F.array_join(arr, ", ")).otherwise(F.lit(UNKNOWN))

    return raw.select(
        "appid", "name",
        F.coalesce(F.col("release_date.date"), F.lit(UNKNOWN)).alias("release_date"),
        F.when(F.col("is_free") == F.lit(False),
               F.coalesce(F.col("price_overview.final_formatted"), F.lit(FREE_PRICE)))
        .otherwise(F.lit(FREE_PRICE)).alias("price"),
        joined("developers").alias("developer"),
        joined("publishers").alias("publisher"),
        F.coalesce("short_description", F.lit(NO_DESCRIPTION)).alias("short_description"),
        F.coalesce("header_image", "tiny_image").alias("header_image"),
    )


def enrich_app_metadata(apps: DataFrame, meta: DataFrame) -> DataFrame:
    """Secondary metadata by app; a failed look-up (status != 200) is empty."""
    ok = meta.filter(F.col("status") == 200).drop("status")
    return apps.join(ok, "appid", "left")


def enrich_profiles(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """Nickname and avatar per review author.

    Found profile: missing name -> anonymous user, missing avatar -> default;
    failed look-up -> unknown user + default avatar."""
    prof = profiles.select(F.col("steamid").alias("author_name"), "personaname", "avatarfull",
                           F.lit(True).alias("_found"))
    j = reviews.join(prof, "author_name", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return j.withColumns({
        "nickname": F.when(found, F.coalesce("personaname", F.lit(PROFILE_NO_NAME))).otherwise(F.lit(PROFILE_UNKNOWN)),
        "avatar": F.when(found, F.coalesce("avatarfull", F.lit(DEFAULT_AVATAR))).otherwise(F.lit(DEFAULT_AVATAR)),
    }).drop("personaname", "avatarfull", "_found")


def sample_by_polarity(reviews: DataFrame, n: int = SAMPLE_PER_POLARITY, order_col: str = "votes_up",
                       id_col: str = "review_id") -> DataFrame:
    """Per app, the ``n`` most helpful positive and ``n`` most helpful negative
    reviews (bag union of both pulls). ``row_number <= n`` plans as a
    group-limited window, so each map task keeps only its local top n."""
    w = Window.partitionBy("appid", "voted_up").orderBy(F.col(order_col).desc_nulls_last(), F.col(id_col))
    return (reviews.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))


def union_pulls(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """A9 (union part): bag union by name, a column missing on one side is null."""
    return positive.unionByName(negative, allowMissingColumns=True)


__all__ = ["PAGE", "REVIEW_TABLE", "parse_pages", "flatten_reviews", "empty_reviews", "extract_summary",
           "valid_page_prefix", "resolve_app", "normalise_app_info", "enrich_app_metadata",
           "enrich_profiles", "sample_by_polarity", "union_pulls"]
