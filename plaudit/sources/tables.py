"""Table rules: partitioned review tables, keyed upsert, freshness, refresh and
recompute plans, stopword source, artefact sink/source (A10-A17).

All rules are relational: ``now`` and ``force`` are inputs, never read from
the clock inside a transformation, so replays give the same answer.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaudit.constants import (ARTEFACT_KINDS, ARTEFACT_READ_FAILED, CACHE_HOURS, DOMAIN_STOPWORDS, NEUTRAL_SCORE,
                               NO_RATING, PAT_STRIP, RADAR_MAX)

# ---- A10: review table --------------------------------------------------------


def write_reviews(df: DataFrame, path: str) -> None:
    """Replace the stored rows of exactly the apps present in ``df``.

    Partitioned by appid with dynamic partition overwrite: other apps' files
    are untouched, and a failed job leaves the previous files in place. Rows are
    rebalanced by app first, so small apps are one file and AQE splits a hot one."""
    (df.hint("rebalance", F.col("appid")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("appid").parquet(path))


def read_reviews(spark: SparkSession, path: str, appids: list[int] | None = None) -> DataFrame:
    """Read stored reviews; a filter on appid prunes partitions at the scan."""
    df = spark.read.parquet(path)
    if appids is not None:
        df = df.filter(F.col("appid").isin(appids))
    return df


# ---- A11: keyed upsert of summary rows ------------------------------------------------

SUMMARY_COLS = ["appid", "last_updated", "total_positive", "total_negative", "review_score_desc"]


def summary_defaults(new: DataFrame) -> DataFrame:
    """Missing counts are 0, a missing rating is the no-rating marker."""
    return new.select(
        "appid", "last_updated",
        F.coalesce(F.col("total_positive").cast("bigint"), F.lit(0).cast("bigint")).alias("total_positive"),
        F.coalesce(F.col("total_negative").cast("bigint"), F.lit(0).cast("bigint")).alias("total_negative"),
        F.coalesce("review_score_desc", F.lit(NO_RATING)).alias("review_score_desc"))


def upsert_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last writer wins per appid: the latest ``last_updated``; on a tie
    the new batch wins."""
    o = old.select(*SUMMARY_COLS).withColumn("_prio", F.lit(0))
    n = summary_defaults(new).withColumn("_prio", F.lit(1))
    u = o.unionByName(n)
    w = Window.partitionBy("appid").orderBy(F.col("last_updated").desc_nulls_last(), F.col("_prio").desc())
    return u.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_prio")


# ---- A12-A14: freshness and plans ----------------------------------------------------------


def _now_col(now) -> F.Column:
    if isinstance(now, (_dt.datetime, _dt.date)):
        return F.lit(now).cast("timestamp_ntz")
    return F.col(now) if isinstance(now, str) else now


def fresh_apps(apps: DataFrame, meta: DataFrame, now, hours: int = CACHE_HOURS) -> DataFrame:
    """``now - last_updated < hours`` (strict); an app without a row is stale."""
    m = meta.select("appid", "last_updated")
    j = apps.select("appid").join(m, "appid", "left")
    age_ok = _now_col(now) < F.col("last_updated").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return j.select("appid", "last_updated", F.coalesce(age_ok, F.lit(False)).alias("is_fresh"))


def plan_refresh(requests: DataFrame, meta: DataFrame, reviews: DataFrame, now,
                 hours: int = CACHE_HOURS) -> DataFrame:
    """HIT when not forced, fresh, and stored rows exist; otherwise FETCH.
    ``requests`` has appid and ``force``."""
    fresh = fresh_apps(requests, meta, now, hours)
    stored = reviews.select("appid").distinct().withColumn("_has_rows", F.lit(True))
    j = (requests.select("appid", F.coalesce(F.col("force"), F.lit(False)).alias("force"))
         .join(fresh, "appid", "left").join(stored, "appid", "left"))
    hit = ~F.col("force") & F.col("is_fresh") & F.coalesce(F.col("_has_rows"), F.lit(False))
    return j.select("appid", "force", "is_fresh", F.coalesce(F.col("_has_rows"), F.lit(False)).alias("has_rows"),
                    F.when(hit, F.lit("HIT")).otherwise(F.lit("FETCH")).alias("action"))


def plan_recompute(apps: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Run all analyses when freshly fetched or any of the six artefact
    kinds is missing. ``apps`` has appid and ``fresh_fetch``; ``artefacts`` has
    appid and ``kind``."""
    kinds = (artefacts.filter(F.col("kind").isin(ARTEFACT_KINDS))
             .groupBy("appid").agg(F.count_distinct("kind").alias("n_kinds")))
    j = apps.select("appid", F.coalesce(F.col("fresh_fetch"), F.lit(False)).alias("fresh_fetch")).join(
        kinds, "appid", "left")
    n = F.coalesce(F.col("n_kinds"), F.lit(0))
    return j.select("appid", "fresh_fetch", n.alias("n_kinds"),
                    (F.col("fresh_fetch") | (n < len(ARTEFACT_KINDS))).alias("recompute"))


# ---- A15: stopword source ----------------------------------------------------------------


def load_stopwords(spark: SparkSession, path: str | None = None, extra=DOMAIN_STOPWORDS,
                   keep_blank: bool = False) -> DataFrame:
    """One word per line, ends stripped (Unicode-aware), blanks dropped
    (``keep_blank`` keeps one blank entry, as the word-cloud loader does),
    united with ``extra``, deduplicated. Returns a one-column DataFrame ``word``."""
    parts = []
    if path:
        lines = spark.read.text(path).select(F.regexp_replace("value", PAT_STRIP, "").alias("word"))
        if not keep_blank:
            lines = lines.filter(F.length("word") > 0)
        parts.append(lines)
    if extra:
        parts.append(spark.createDataFrame([(w,) for w in extra], "word string"))
    if not parts:
        return spark.createDataFrame([], "word string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def remove_stopword_rows(rows: DataFrame, stop: DataFrame, col: str = "word") -> DataFrame:
    """J4 against a stopword table: an anti-join, broadcast where the planner's byte threshold allows it."""
    return rows.join(stop.select(F.col("word").alias(col)).distinct(), col, "left_anti")


# ---- A16 / A17: artefacts ----------------------------------------------------------------


def artefact_score(score: DataFrame) -> DataFrame:
    return score.select("appid", F.lit("score").alias("kind"),
                        F.to_json(F.struct(F.col("score"), F.col("suggestion"))).alias("json"))


def artefact_radar(radar: DataFrame) -> DataFrame:
    g = radar.groupBy("appid").agg(F.array_sort(F.collect_list(F.struct("dim_idx", "dimension", "value"))).alias("d"))
    indicator = F.transform("d", lambda x: F.struct(x["dimension"].alias("name"), F.lit(RADAR_MAX).alias("max")))
    return g.select("appid", F.lit("radar").alias("kind"),
                    F.to_json(F.struct(indicator.alias("indicator"),
                                       F.transform("d", lambda x: x["value"]).alias("value"))).alias("json"))


def artefact_playtime(stages: DataFrame) -> DataFrame:
    g = stages.groupBy("appid").agg(F.array_sort(F.collect_list(F.struct("stage_idx", "stage", "positive",
                                                                            "negative"))).alias("s"))
    return g.select("appid", F.lit("playtime_sentiment").alias("kind"), F.to_json(F.struct(
        F.transform("s", lambda x: x["stage"]).alias("labels"),
        F.transform("s", lambda x: x["positive"]).alias("positive_scores"),
        F.transform("s", lambda x: x["negative"]).alias("negative_scores"))).alias("json"))


def artefact_timeseries(monthly: DataFrame) -> DataFrame:
    """Months sorted inside the document (``array_sort``), not by a global sort."""
    g = monthly.groupBy("appid").agg(F.array_sort(F.collect_list(F.struct("month", "positive", "negative"))).alias("m"))
    return g.select("appid", F.lit("timeseries").alias("kind"), F.to_json(F.struct(
        F.transform("m", lambda x: x["month"]).alias("dates"),
        F.transform("m", lambda x: x["positive"]).alias("positive_counts"),
        F.transform("m", lambda x: x["negative"]).alias("negative_counts"))).alias("json"))


def artefact_topics(tmap: DataFrame, words: DataFrame, polarity: str, apps: DataFrame | None = None) -> DataFrame:
    """``{topic_map: {id: {keywords, summary}}, word_data: [{name, value, topic_id}]}``.

    With ``apps`` (one row per appid) every app gets a document; it is empty for an app without topics."""
    kind = "pos_topics" if polarity == "positive" else "neg_topics"
    tm = (tmap.filter(F.col("polarity") == polarity).groupBy("appid")
          .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
              F.col("topic_id").cast("string").alias("k"),
              F.struct("keywords", "summary").alias("v"))))).alias("topic_map")))
    wd = (words.filter(F.col("polarity") == polarity).groupBy("appid")
          .agg(F.array_sort(F.collect_list(F.struct("topic_id", "rank", "word", "value"))).alias("w")))
    j = tm.join(wd, "appid", "full_outer")
    if apps is not None:
        j = apps.select("appid").join(j, "appid", "left")
    word_data = F.transform(F.coalesce("w", F.array().cast(wd.schema["w"].dataType)), lambda x: F.struct(
        x["word"].alias("name"), x["value"].alias("value"), x["topic_id"].alias("topic_id")))
    return j.select("appid", F.lit(kind).alias("kind"), F.to_json(F.struct(
        F.coalesce("topic_map", F.create_map().cast(tm.schema["topic_map"].dataType)).alias("topic_map"),
        word_data.alias("word_data"))).alias("json"))


def export_artefacts(artefacts: DataFrame, path: str) -> None:
    """A16 sink: one JSON document per (appid, kind), partitioned by kind;
    non-ASCII text is written as is."""
    artefacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_artefacts(apps: DataFrame, artefacts: DataFrame, polarity: str = "positive") -> DataFrame:
    """A16 read + A17 fallback: one row per app with the five documents the
    view needs; if any is missing the whole bundle is the fallback (score 50,
    the read-failure text, empty documents)."""
    topics_kind = "pos_topics" if polarity == "positive" else "neg_topics"
    need = ["score", topics_kind, "radar", "playtime_sentiment", "timeseries"]
    a = artefacts.filter(F.col("kind").isin(need))
    piv = a.groupBy("appid").pivot("kind", need).agg(F.first("json"))
    j = apps.select("appid").join(piv, "appid", "left")
    complete = None
    for k in need:
        c = F.col(k).isNotNull()
        complete = c if complete is None else (complete & c)
    sc = F.from_json(F.col("score"), "score int, suggestion string")
    tp = F.col(topics_kind)
    return j.select(
        "appid",
        F.when(complete, sc["score"]).otherwise(F.lit(NEUTRAL_SCORE)).alias("recommend_score"),
        F.when(complete, sc["suggestion"]).otherwise(F.lit(ARTEFACT_READ_FAILED)).alias("suggestion"),
        F.when(complete, F.get_json_object(tp, "$.word_data")).otherwise(F.lit("[]")).alias("word_data_json"),
        F.when(complete, F.get_json_object(tp, "$.topic_map")).otherwise(F.lit("{}")).alias("topic_map_json"),
        F.when(complete, F.col("radar")).otherwise(F.lit("{}")).alias("radar_json"),
        F.when(complete, F.col("playtime_sentiment")).otherwise(F.lit("{}")).alias("playtime_sentiment_json"),
        F.when(complete, F.col("timeseries")).otherwise(F.lit("{}")).alias("time_series_json"),
        complete.alias("from_artefacts"))


__all__ = ["write_reviews", "read_reviews", "upsert_summary", "fresh_apps", "plan_refresh", "plan_recompute",
           "load_stopwords", "remove_stopword_rows", "artefact_score", "artefact_radar", "artefact_playtime",
           "artefact_timeseries", "artefact_topics", "export_artefacts", "read_artefacts", "load_artefacts"]
