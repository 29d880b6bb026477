"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (through the stand-in views) over the
whole tables; the matching DuckDB SQL lives in ``plaudit.plans.oracle``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.constants import DOMAIN_STOPWORDS
from plaudit.functions import rating as R
from plaudit.functions import text as TX
from plaudit.functions.numeric import playtime_stage, row_mean
from plaudit.operators import metrics as M
from plaudit.operators import score as SC
from plaudit import constants as K
from plaudit.sources import pages as P
from plaudit.sources import tables as TB
from plaudit.sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# parameters of the discovery queries; their SQL twins use the same
EMBED_RANK = 8
DENSITY_DIMS, DENSITY_EPS, DENSITY_POINTS = 3, 0.06, 6
ASSIGN_COSINE = 0.03
SHORT_PAGES, CALLBACK_DIMS = 3, 16
FEW_BUCKETS = 8  # of the streams' keyed tables: a few thousand apps
FLAW_WORDS = ["heti", "nja"]
HAN_RANGE = "\u4e00-\u9fa5"


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- 7.2 step 1: the flagship -------------------------------------------------

def _score(spark, sf, polarity):
    from plaudit.plans.topics_plan import review_topic_map
    inputs = SC.score_inputs(S.v_review_events(spark, sf), S.v_app_info(spark, sf), S.v_app_summary(spark, sf))
    # text and topics only for apps whose suggestion a flaw keyword can change
    candidates = S.v_reviews(spark, sf).join(SC.flaw_candidates(inputs), "appid", "left_semi")
    flaws = SC.critical_flaws(review_topic_map(candidates, only_polarity=polarity), polarity=polarity)
    return SC.finish_score(inputs, flaws)


@register("recommend_score")
def q_recommend_score(spark, sf):
    return _score(spark, sf, "positive")


@register("penalties")
def q_penalties(spark, sf):
    df = SC.penalties(S.v_review_events(spark, sf), S.v_app_info(spark, sf))
    return df.select("appid", "n_reviews",
                     *[F.bround(c, 6).alias(c) for c in ("opt_penalty", "value_penalty", "refund_penalty")])


@register("base_score")
def q_base_score(spark, sf):
    s = S.v_app_summary(spark, sf)
    return s.select("appid", "review_score_desc", R.base_score("review_score_desc").alias("base_score"))


@register("translate_rating")
def q_translate_rating(spark, sf):
    s = S.v_app_summary(spark, sf)
    return s.select("appid", "review_score_desc", R.translate_rating("review_score_desc").alias("rating_display"))


@register("is_paid")
def q_is_paid(spark, sf):
    i = S.v_app_info(spark, sf)
    return i.select("appid", "price", R.is_paid("price").alias("is_paid"))


# ---- 7.2 step 2: metrics --------------------------------------------------------

@register("polarity_counts")
def q_polarity_counts(spark, sf):
    return M.polarity_counts(S.v_review_events(spark, sf))


@register("by_polarity")
def q_by_polarity(spark, sf):
    r = M.by_polarity(S.v_review_events(spark, sf), "negative")
    return r.select("review_id", "appid", "voted_up", "votes_up")


@register("aspect_radar")
def q_aspect_radar(spark, sf):
    return M.aspect_radar(S.v_review_events(spark, sf))


@register("playtime_stage")
def q_playtime_stage(spark, sf):
    r = S.v_review_events(spark, sf)
    return (r.select("appid", playtime_stage("playtime_at_review").alias("stage"))
            .groupBy("appid", "stage").agg(F.count(F.lit(1)).alias("n_reviews")))


@register("row_mean")
def q_row_mean(spark, sf):
    r = S.v_review_events(spark, sf)
    return r.select("review_id", F.bround(row_mean() * 1000, 6).alias("mean_x1000"))


@register("playtime_sentiment")
def q_playtime_sentiment(spark, sf):
    return M.playtime_sentiment(S.v_review_events(spark, sf))


@register("monthly_counts")
def q_monthly_counts(spark, sf):
    return M.monthly_counts(S.v_review_events(spark, sf), ts_col="ts")


@register("monthly_counts_gaps")
def q_monthly_counts_gaps(spark, sf):
    # the epoch-seconds input path (as landed pages carry it); ~50 reviews per
    # app over 80 months leave most months empty, so gap rows dominate
    r = S.v_review_events(spark, sf)
    epoch = (F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600
             + F.minute("ts") * 60 + F.second("ts"))
    m = M.monthly_counts(r.withColumn("timestamp_created", epoch), ts_col="timestamp_created")
    return m.withColumn("is_gap", (F.col("positive") + F.col("negative")) == 0)


@register("review_cards")
def q_review_cards(spark, sf):
    return M.review_cards(S.v_reviews(spark, sf))


# ---- 7.2 step 3: ingest and table rules -------------------------------------

@register("normalise_app_info")
def q_normalise_app_info(spark, sf):
    return S.v_app_info(spark, sf)


@register("enrich_profiles")
def q_enrich_profiles(spark, sf):
    r = S.v_review_events(spark, sf).select("review_id", "appid", "author_name")
    return P.enrich_profiles(r, S.v_profiles(spark, sf))


@register("sample_by_polarity")
def q_sample_by_polarity(spark, sf):
    r = S.v_review_events(spark, sf)
    return P.sample_by_polarity(r).select("review_id", "appid", "voted_up", "votes_up")


# ---- 7.2 step 4: text --------------------------------------------------------

def _texts(spark, sf):
    """Documents and raw web pages as one text column (pages carry tags and URLs)."""
    d = S.table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = S.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                           F.col("html").alias("text"))
    return d.unionByName(p)


@register("clean_for_scoring")
def q_clean_for_scoring(spark, sf):
    return _texts(spark, sf).select("kind", "id", TX.clean_for_scoring("text").alias("clean"))


@register("clean_for_topics")
def q_clean_for_topics(spark, sf):
    return _texts(spark, sf).select("kind", "id", TX.clean_for_topics("text").alias("clean"))


@register("clean_for_keywords")
def q_clean_for_keywords(spark, sf):
    return _texts(spark, sf).select("kind", "id", TX.clean_for_keywords("text").alias("clean"))


@register("tokens")
def q_tokens(spark, sf):
    t = _texts(spark, sf).select("kind", "id", TX.tokens(TX.clean_for_topics("text")).alias("toks"))
    return t.select("kind", "id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@register("tokens_filtered")
def q_tokens_filtered(spark, sf):
    t = _texts(spark, sf).select("kind", "id", TX.remove_stopwords(TX.tokens(TX.clean_for_topics("text")),
                                                                  DOMAIN_STOPWORDS).alias("toks"))
    return t.select("kind", "id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


# ---- 7.2 step 5: topics -------------------------------------------------------

def _rt(spark, sf, materialize_as="table"):
    from plaudit.plans.topics_plan import review_topics
    return review_topics(S.v_reviews(spark, sf), materialize_as=materialize_as)


@register("topic_info")
def q_topic_info(spark, sf):
    return _rt(spark, sf, None)["info"].filter(F.col("topic_id") != -1)


@register("class_tfidf")
def q_class_tfidf(spark, sf):
    from plaudit.plans.topics_plan import document_topics
    t = document_topics(spark, sf)["tfidf"]
    return t.select("topic_id", "word", "tf", F.bround("weight", 9).alias("weight"))


@register("topic_words")
def q_topic_words(spark, sf):
    # words read term counts and TF-IDF once: nothing worth materialising
    w = _rt(spark, sf, None)["words"]
    return w.select("appid", "polarity", "topic_id", "rank", "word", "value", F.bround("weight", 9).alias("weight"))


@register("topic_keywords")
def q_topic_keywords(spark, sf):
    return _rt(spark, sf, None)["keywords"]


@register("representative_docs")
def q_representative_docs(spark, sf):
    r = _rt(spark, sf)["representative"]
    return r.select("appid", "polarity", "topic_id", "rank", "review_id", "cosine")


@register("topic_summary")
def q_topic_summary(spark, sf):
    return _rt(spark, sf)["summary"]


@register("topic_map")
def q_topic_map(spark, sf):
    return _rt(spark, sf)["topic_map"]


@register("word_tooltips")
def q_word_tooltips(spark, sf):
    return _rt(spark, sf)["tooltips"]


@register("critical_flaws")
def q_critical_flaws(spark, sf):
    return SC.critical_flaws(_rt(spark, sf)["topic_map"], polarity=None)


@register("critical_flaws_custom")
def q_critical_flaws_custom(spark, sf):
    """G12 with keywords of one's own: some apps' topics have them."""
    return SC.critical_flaws(_rt(spark, sf)["topic_map"], polarity="negative", keywords=FLAW_WORDS)


@register("recommend_score_negative")
def q_recommend_score_negative(spark, sf):
    """The score with flaws looked for in the topics of negative reviews."""
    return _score(spark, sf, "negative")


@register("dashboard_negative")
def q_dashboard_negative(spark, sf):
    return _dashboard(spark, sf, "negative")


@register("topic_words_callback")
def q_topic_words_callback(spark, sf):
    """Topic words with a tokeniser given as a callback, equal to the built-in one's."""
    from plaudit.operators.callbacks import tokenizer_udf
    from plaudit.operators.topics import describe_topics
    from plaudit.plans.topics_plan import REVIEW_GROUP, review_topic_input
    src = review_topic_input(S.v_reviews(spark, sf))
    words = describe_topics(src, REVIEW_GROUP, "review_id", "content", "topic_label", DOMAIN_STOPWORDS, tokenizer=tokenizer_udf(_plain_tokenizer))["words"]
    return words.select("appid", "polarity", "topic_id", "rank", "word", "value", F.bround("weight", 9).alias("weight"))


def _plain_tokenizer():
    def words(text: str) -> list[str]:
        out = []
        for run in re.split(f"([{HAN_RANGE}]+)|\\s+", text.lower()):
            if run and re.fullmatch(f"[{HAN_RANGE}]+", run) and len(run) > 1:
                out += [run[i:i + 2] for i in range(len(run) - 1)]
            elif run:
                out.append(run)
        return out
    return words


@register("embed_callback")
def q_embed_callback(spark, sf):
    """U4: an embedding given as a callback (counts of words by md5), its entries."""
    from plaudit.operators.embed import embed
    e = embed(S.table(spark, sf, "documents"), "doc_id", "text", provider_factory=_counting_model)
    return e.select("doc_id", F.posexplode("embedding").alias("component", "x")).select("doc_id", "component", F.col("x").cast("bigint").alias("x"))


def _counting_model():
    from collections import Counter
    from hashlib import md5

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = Counter(int(md5(w.encode()).hexdigest()[:8], 16) % CALLBACK_DIMS for w in text.lower().split())
            out.append([counts[i] for i in range(CALLBACK_DIMS)])
        return out
    return encode


@register("tokens_stopped")
def q_tokens_stopped(spark, sf):
    """A stopword file united with the domain words, taken out of the documents' words by an anti-join."""
    from plaudit.functions.text import token_rows
    stop = TB.load_stopwords(spark, _stopword_file(spark, sf))
    rows = token_rows(S.table(spark, sf, "documents"), TX.clean_for_topics("text"), "word", ["doc_id"])
    return TB.remove_stopword_rows(rows, stop).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def _stopword_file(spark, sf):
    """A landed stopword file: every word of the benchmark texts a line, with repeats, blanks around and empty lines."""
    import uuid

    from plaudit.session import scratch_path
    path = scratch_path(spark, f"stopwords-{uuid.uuid4().hex}")
    words = S.table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("value"))
    words.select(F.concat(F.lit(" \t"), "value", F.lit("\u3000 ")).alias("value")).write.text(path)
    return path


# ---- 7.2 step 3 (continued): pages and table rules --------------------------

@register("flatten_reviews")
def q_flatten_reviews(spark, sf):
    return P.flatten_reviews(S.v_review_pages(spark, sf), keep=["page_no"])


@register("extract_summary")
def q_extract_summary(spark, sf):
    return P.extract_summary(S.v_review_pages(spark, sf), keep=["page_no"])


@register("valid_page_prefix")
def q_valid_page_prefix(spark, sf):
    return P.valid_page_prefix(S.v_review_pages(spark, sf))


@register("valid_page_prefix_short")
def q_valid_page_prefix_short(spark, sf):
    """A4 with a page budget that ends chains."""
    return P.valid_page_prefix(S.v_review_pages(spark, sf), max_pages=SHORT_PAGES)


@register("search_app")
def q_search_app(spark, sf):
    """A5: apps by any part of their name."""
    from plaudit.sources.search import build_index, search_apps
    return search_apps(S.v_search_fragments(spark, sf), build_index(S.v_app_info(spark, sf)))


@register("segment_words")
def q_segment_words(spark, sf):
    """T5 without blanks: conversation lines with their blanks removed, segmented by a lexicon learned from them alone (no SQL form)."""
    from plaudit.operators.segment import learn_lexicon, segmenter, spread
    joined = S.table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit(" "), F.lit("")).alias("joined"))
    words = segmenter(spark, learn_lexicon(joined, F.col("joined")))(F.col("joined"))
    joined = spread(joined, joined.agg(F.sum(F.length("joined"))).first()[0] or 0)
    return joined.select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@register("resolve_app")
def q_resolve_app(spark, sf):
    return P.resolve_app(S.v_search_terms(spark, sf), S.v_app_info(spark, sf))


@register("enrich_app_metadata")
def q_enrich_app_metadata(spark, sf):
    return P.enrich_app_metadata(S.v_app_info(spark, sf).select("appid", "name", "price"), S.v_app_meta(spark, sf))


def _requests(spark, sf):
    info = S.v_app_info(spark, sf)
    return info.select("appid", F.col("name").startswith("red ").alias("force"))


@register("fresh_apps")
def q_fresh_apps(spark, sf):
    return TB.fresh_apps(S.v_app_info(spark, sf), S.v_app_summary(spark, sf), S.SUMMARY_BASE_TIME)


def _refresh(spark, sf):
    return TB.plan_refresh(_requests(spark, sf), S.v_app_summary(spark, sf), S.v_review_events(spark, sf),
                           S.SUMMARY_BASE_TIME)


@register("plan_refresh")
def q_plan_refresh(spark, sf):
    return _refresh(spark, sf)


def _artefact_kinds(spark, sf):
    """Artefacts on disk: all six kinds per summarised app, except the stage
    document of apps with more negative than positive reviews."""
    s = S.v_app_summary(spark, sf)
    kinds = F.array(*[F.lit(k) for k in K.ARTEFACT_KINDS])
    a = s.select("appid", "total_positive", "total_negative", F.explode(kinds).alias("kind"))
    return a.filter(~((F.col("kind") == "playtime_sentiment") & (F.col("total_negative") > F.col("total_positive"))))


@register("plan_recompute")
def q_plan_recompute(spark, sf):
    apps = _refresh(spark, sf).select("appid", (F.col("action") == "FETCH").alias("fresh_fetch"))
    return TB.plan_recompute(apps, _artefact_kinds(spark, sf).select("appid", "kind"))


def _new_summaries(spark, sf):
    """Summary rows a refresh would fetch: apps planned FETCH, counts recounted,
    rating text as the store now returns it (translated)."""
    old = S.v_app_summary(spark, sf)
    fetched = _refresh(spark, sf).filter(F.col("action") == "FETCH").select("appid")
    counts = M.polarity_counts(S.v_review_events(spark, sf))
    rating = old.select("appid", R.translate_rating("review_score_desc").alias("review_score_desc"))
    return (fetched.join(counts, "appid", "left").join(rating, "appid", "left")
            .select("appid", F.lit(S.SUMMARY_BASE_TIME).cast("timestamp_ntz").alias("last_updated"),
                    F.col("positive_count").alias("total_positive"), F.col("negative_count").alias("total_negative"),
                    "review_score_desc"))


@register("upsert_summary")
def q_upsert_summary(spark, sf):
    return TB.upsert_summary(S.v_app_summary(spark, sf), _new_summaries(spark, sf))


# ---- keyword cloud and aspect scoring ----------------------------------------

@register("keyword_frequency")
def q_keyword_frequency(spark, sf):
    from plaudit.operators.keywords import keyword_frequency
    from plaudit.plans.topics_plan import polarity
    # the cloud's stopwords are the file's alone
    stop = TB.load_stopwords(spark, _stopword_file(spark, sf), extra=(), keep_blank=True)
    r = S.v_reviews(spark, sf).withColumn("polarity", polarity())
    return keyword_frequency(r, "content", ["appid", "polarity"], stop_rows=stop)


@register("aspect_scores")
def q_aspect_scores(spark, sf):
    """M1 on the reviews' own texts, against five benchmark texts as hypotheses."""
    from plaudit.operators.aspects import text_scores
    said = S.table(spark, sf, "benchmark").orderBy("item_id").limit(len(K.SCORE_COLUMNS)).collect()  # five rows
    r = S.v_reviews(spark, sf).select("review_id", "appid", "content")
    return text_scores(r, [x["text"] for x in sorted(said, key=lambda x: x["item_id"])]).drop("content")


@register("vector_scores")
def q_vector_scores(spark, sf):
    from plaudit.operators.aspects import prototype_scores, prototype_vectors
    emb = S.table(spark, sf, "embeddings")
    return prototype_scores(emb.select(F.col("vec_id").alias("review_id")), emb, prototype_vectors(emb))


# ---- 7.2 step 6: embedding and topic discovery -------------------------------

@register("embed")
def q_embed(spark, sf):
    """M2: the entries of every document's low-rank vector (no SQL form; compared with a dense SVD in the tests)."""
    from plaudit.operators.lowrank import low_rank_embedding
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    e = low_rank_embedding(d, ["doc_id"], "text", EMBED_RANK)
    return e.select("doc_id", F.posexplode("embedding").alias("component", "x")).select("doc_id", "component", F.bround("x", 6).alias("x"))


@register("hashed_terms")
def q_hashed_terms(spark, sf):
    """The sparse rows that M2 factors: hashed TF-IDF of every document at unit length."""
    from plaudit.operators.lowrank import tfidf_rows
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    rows = tfidf_rows(d, ["doc_id"], "text").select("doc_id", F.explode(F.arrays_zip("buckets", "weights")).alias("e"))
    return rows.select("doc_id", F.col("e.buckets").alias("bucket"), F.bround("e.weights", 9).alias("weight"))


@register("discover_topics")
def q_discover_topics(spark, sf):
    from plaudit.operators.clusters import discover_topics
    d = S.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return discover_topics(d, ["lang"], "doc_id", "text")


@register("near_copy_topics")
def q_near_copy_topics(spark, sf):
    from plaudit.operators.clusters import near_copy_topics
    d = S.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return near_copy_topics(d, ["lang"], "doc_id", "text")


def _vector_topics(spark, sf):
    """M3 over the given vectors, on three Walsh coordinates."""
    from plaudit.functions.vectors import walsh_coordinates
    from plaudit.operators.density import density_clusters
    emb = S.table(spark, sf, "embeddings").select("vec_id", walsh_coordinates(F.col("embedding"), DENSITY_DIMS).alias("at"))
    return density_clusters(emb, "vec_id", "at", DENSITY_DIMS, DENSITY_EPS, DENSITY_POINTS, min_size=DENSITY_POINTS)


@register("density_topics")
def q_density_topics(spark, sf):
    return _vector_topics(spark, sf)


def _discovered(spark, sf):
    """Documents with a vector get its topic; the others are assigned to the stored topics by their text."""
    from plaudit.operators.assign import assign_topics
    from plaudit.operators.topics import describe_topics
    from plaudit.session import materialize
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    found = materialize(d.join(_vector_topics(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumn("topic_label", F.col("topic_id").cast("string")).drop("topic_id"))
    stored = describe_topics(found, [], "doc_id", "text", "topic_label", DOMAIN_STOPWORDS)
    unseen = d.join(found.select("doc_id"), "doc_id", "left_anti")
    placed = assign_topics(unseen, stored["tfidf"], [], "doc_id", "text", ASSIGN_COSINE, DOMAIN_STOPWORDS)
    return found, stored, unseen, placed


@register("assigned_topics")
def q_assigned_topics(spark, sf):
    """Incremental M8: unseen documents on the stored topics, without a refit."""
    _, _, _, placed = _discovered(spark, sf)
    return placed


@register("discovered_topic_map")
def q_discovered_topic_map(spark, sf):
    """M3 to M8: topics discovered, unseen documents assigned, then described together."""
    from plaudit.operators.topics import describe_topics
    found, stored, unseen, placed = _discovered(spark, sf)
    names = stored["info"].select("topic_id", "topic_label")
    late = unseen.join(placed.select("doc_id", "topic_id"), "doc_id").join(names, "topic_id", "left").select(
        "doc_id", "text", F.coalesce("topic_label", F.lit("-1")).alias("topic_label"))
    return describe_topics(found.unionByName(late), [], "doc_id", "text", "topic_label", DOMAIN_STOPWORDS)["topic_map"]


# ---- 7.2 step 7: dashboard and artefacts ----------------------------------------

def _parts(spark, sf, polarity="positive"):
    from plaudit.plans.dashboard import analyses
    return analyses(S.v_reviews(spark, sf), S.v_app_info(spark, sf), S.v_app_summary(spark, sf), polarity, S.v_review_events(spark, sf))


def _dashboard(spark, sf, polarity):
    from plaudit.plans.dashboard import dashboard
    # the dashboard reads only the score and the counts: no full analysis bundle
    parts = {"score": _score(spark, sf, polarity), "counts": M.polarity_counts(S.v_review_events(spark, sf))}
    return dashboard(S.v_app_info(spark, sf), S.v_app_summary(spark, sf), parts)


@register("dashboard")
def q_dashboard(spark, sf):
    return _dashboard(spark, sf, "positive")


@register("export_timeseries_json")
def q_export_timeseries_json(spark, sf):
    return TB.artefact_timeseries(M.monthly_counts(S.v_review_events(spark, sf), ts_col="ts"))


@register("export_radar_json")
def q_export_radar_json(spark, sf):
    return TB.artefact_radar(M.aspect_radar(S.v_review_events(spark, sf)))


@register("export_playtime_json")
def q_export_playtime_json(spark, sf):
    return TB.artefact_playtime(M.playtime_sentiment(S.v_review_events(spark, sf)))


@register("export_score_json")
def q_export_score_json(spark, sf):
    return TB.artefact_score(q_recommend_score(spark, sf))


@register("export_artefacts")
def q_export_artefacts(spark, sf):
    from plaudit.plans.dashboard import artefacts
    return artefacts(_parts(spark, sf))


def _load_artefacts(spark, sf, polarity):
    """A16 sink, source and A17 in one: documents are written, read back and joined to the apps."""
    import uuid

    from plaudit.session import scratch_path
    path = scratch_path(spark, f"artefacts-{uuid.uuid4().hex}")
    TB.export_artefacts(q_export_artefacts(spark, sf), path)
    return TB.load_artefacts(S.v_app_info(spark, sf), TB.read_artefacts(spark, path), polarity)


@register("load_artefacts_positive")
def q_load_artefacts_positive(spark, sf):
    return _load_artefacts(spark, sf, "positive")


@register("load_artefacts_negative")
def q_load_artefacts_negative(spark, sf):
    return _load_artefacts(spark, sf, "negative")


@register("stored_reviews")
def q_stored_reviews(spark, sf):
    """A10: the review table is written by app, the negative reviews' apps are replaced by
    their negative reviews alone, and what is then stored is read back."""
    import uuid

    from plaudit.session import scratch_path
    path = scratch_path(spark, f"reviews-{uuid.uuid4().hex}")
    r = S.v_review_events(spark, sf).select("review_id", "appid", "voted_up", "votes_up")
    TB.write_reviews(r, path)
    TB.write_reviews(r.filter(~F.col("voted_up") & (F.col("appid") % 2 == 0)), path)
    return TB.read_reviews(spark, path)


@register("stored_review_metrics")
def q_stored_review_metrics(spark, sf):
    """The scored reviews are stored in buckets of the app; analyses read and join them without an exchange."""
    from plaudit.sources.review_store import store_reviews, stored_reviews
    t = stored_reviews(spark, store_reviews(S.v_review_events(spark, sf)))
    months = t.groupBy("appid").agg(F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("months"))
    hours = t.groupBy("appid").agg(F.sum("playtime_at_review").alias("minutes"), F.count(F.lit(1)).alias("n_reviews"))
    return M.polarity_counts(t).join(months, "appid").join(hours, "appid")


@register("union_pulls")
def q_union_pulls(spark, sf):
    """Two pulls with different columns; a column missing on one side is null."""
    r = S.v_review_events(spark, sf)
    positive = M.by_polarity(r, "positive").select("review_id", "appid", "votes_up")
    negative = M.by_polarity(r, "negative").select("review_id", "playtime_at_review", "appid")
    return P.union_pulls(positive, negative)


# ---- streaming (S1) over the given tables ---------------------------------------

@register("stream_monthly_counts")
def q_stream_monthly_counts(spark, sf):
    """S1 end to end: the review rows land as files in the shared folder, the
    stream counts days (availableNow, one file a micro-batch) into a versioned daily table,
    and months are rolled up from it; equal to ``monthly_counts``."""
    import uuid

    from plaudit.session import scratch_path
    from plaudit.streaming.monthly import monthly_from_daily, start_monthly_counts
    run = uuid.uuid4().hex
    landed = scratch_path(spark, f"landed-{run}")
    S.v_review_events(spark, sf).select("appid", "voted_up", "ts").repartition(4).write.parquet(landed)
    schema = spark.read.parquet(landed).schema
    table = scratch_path(spark, f"daily-{run}")
    start_monthly_counts(spark, landed, schema, table, name=f"monthly-{run}", max_files_per_trigger=1, buckets=FEW_BUCKETS).awaitTermination()
    return monthly_from_daily(spark, table)


@register("stream_refresh")
def q_stream_refresh(spark, sf):
    """A12, A13 as a stream: when each app (here: an author) becomes fresh and stale, from refreshes that arrive in any order.

    The last landed file is the clock: a row far ahead of all others."""
    import uuid

    from plaudit.session import scratch_path
    from plaudit.streaming.stateful import TRANSITIONS, refresh_transitions, run_to_table
    run = uuid.uuid4().hex
    landed, out = scratch_path(spark, f"refreshes-{run}"), scratch_path(spark, f"transitions-{run}")
    rows = S.v_refreshes(spark, sf)
    rows.repartition(3).write.parquet(landed)
    spark.sql(f"SELECT CAST(-1 AS BIGINT) AS appid, TIMESTAMP_NTZ '{S.CLOCK_END}' AS last_updated").write.mode("append").parquet(landed)
    # one micro-batch of all refreshes and the clock: the watermark passes them after it
    stream = spark.readStream.schema(rows.schema).parquet(landed)
    run_to_table(refresh_transitions(stream, delay="0 seconds"), out, f"refresh-{run}").awaitTermination()
    return spark.read.schema(TRANSITIONS).parquet(out).select("appid", F.col("at").cast("timestamp_ntz").alias("at"), "action")


@register("stream_page_chain")
def q_stream_page_chain(spark, sf):
    """A4 as a stream: pages arrive out of order, one file a micro-batch; equal to ``valid_page_prefix``."""
    import uuid

    from plaudit.session import scratch_path
    from plaudit.streaming.stateful import CHAIN, page_chains, run_to_table
    run = uuid.uuid4().hex
    landed, out = scratch_path(spark, f"pages-{run}"), scratch_path(spark, f"chains-{run}")
    rows = S.v_review_pages(spark, sf).withColumn("pull", F.lit(1).cast("bigint"))
    rows.repartition(3, F.xxhash64("page_no", "appid")).write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    run_to_table(page_chains(stream), out, f"chain-{run}").awaitTermination()
    return P.flatten_reviews(spark.read.schema(CHAIN).parquet(out).drop("pull"), keep=["page_no"])


@register("stream_summary_upserts")
def q_stream_summary_upserts(spark, sf):
    """S2 end to end: refreshed summary rows land as files; the stream upserts them, one file
    a micro-batch, into a versioned table that starts from the stored summaries."""
    import uuid

    from plaudit.session import scratch_path
    from plaudit.streaming.monthly import SUMMARY_SCHEMA, latest_version, start_summary_upserts
    run = uuid.uuid4().hex
    landed = scratch_path(spark, f"summaries-{run}")
    new = _new_summaries(spark, sf)
    new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA]).repartition(4).write.parquet(landed)
    table = scratch_path(spark, f"summary-table-{run}")
    initial = S.v_app_summary(spark, sf)
    start_summary_upserts(spark, landed, table, name=f"summaries-{run}", initial=initial,
                          max_files_per_trigger=1, buckets=FEW_BUCKETS).awaitTermination()
    return latest_version(spark, table, SUMMARY_SCHEMA)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
