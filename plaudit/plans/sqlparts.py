"""SQL fragments for the independent DuckDB oracle.

Built from the same fixed values as the Spark code (``plaudit.constants``) so
the two sides cannot drift on data, while the logic is written separately.
"""

from __future__ import annotations

from plaudit import constants as K
from plaudit.sources import standins as S


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def first_contained(expr: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN contains({expr}, {q(k)}) THEN {v if isinstance(v, int) else q(v)}" for k, v in pairs)
    return f"(CASE {whens} ELSE {default} END)"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


RATING = f"coalesce(review_score_desc, {q(K.NO_RATING)})"
BASE_SCORE = first_contained(RATING, K.RATING_BASE_SCORE, str(K.DEFAULT_BASE_SCORE))
DISPLAY_RATING = first_contained(RATING, K.RATING_DISPLAY, RATING)


def is_paid(price_expr: str) -> str:
    p = f"regexp_replace(regexp_replace(coalesce({price_expr}, '0'), '[¥,]', '', 'g'), {q(K.PAT_STRIP)}, '', 'g')"
    words = ", ".join(q(w) for w in K.FREE_PRICE_WORDS)
    return f"(length({p}) > 0 AND lower({p}) NOT IN ({words}))"


def scores_sql(alias: str = "e") -> str:
    return ",\n       ".join(
        f"(({alias}.event_id*{m} + {a}) % 129) / cast(128 as double) AS {c}"
        for c, (m, a) in zip(K.SCORE_COLUMNS, S.SCORE_MULT_ADD))


V_REVIEWS = f"""v_reviews AS (
  SELECT e.event_id AS review_id,
         cast(e.user_id % {S.REVIEW_APPS} AS int) AS appid,
         cast(e.user_id AS varchar) AS author_name,
         d.text AS content,
         e.event_type IN ('purchase', 'click', 'view') AS voted_up,
         cast(floor(e.value * 20) AS bigint) AS playtime_at_review,
         cast(json_extract_string(e.props, '$.k') AS int) AS votes_up,
         e.ts - to_days(cast(e.user_id * {S.REVIEW_MONTH_STEP} % {S.REVIEW_MONTHS} * 31 AS int)) AS ts,
         {scores_sql('e')},
         d.lang, d.n_chars
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id)"""

_FORMATTED = ("CASE WHEN p_partkey = 3 THEN '¥ 0.00' WHEN p_partkey = 4 THEN '' WHEN p_partkey = 5 THEN 'Free' "
              "ELSE '¥ ' || format('{:,.2f}', p_retailprice * 2) END")

V_APP_RAW = f"""v_app_raw AS (
  SELECT cast(p_partkey AS int) AS appid,
         p_name AS name,
         CASE WHEN p_partkey IN (3, 4, 5) THEN false ELSE p_type = 'PROMO' END AS is_free,
         CASE WHEN p_size BETWEEN 31 AND 33 THEN NULL ELSE {_FORMATTED} END AS final_formatted,
         CASE WHEN p_size < 10 THEN []::varchar[] ELSE [p_brand] END AS developers,
         CASE WHEN p_size > 45 THEN NULL ELSE [p_brand, p_type] END AS publishers,
         CASE WHEN p_size > 40 THEN NULL ELSE '2024-' || lpad(cast(p_size % 12 + 1 AS varchar), 2, '0') END AS release_date,
         CASE WHEN p_size BETWEEN 20 AND 25 THEN NULL ELSE p_name END AS short_description,
         CASE WHEN p_size BETWEEN 26 AND 30 THEN NULL ELSE 'header_' || cast(p_partkey AS varchar) || '.jpg' END AS header_image,
         'thumb_' || cast(p_partkey AS varchar) || '.jpg' AS tiny_image
  FROM part)"""

V_APP_INFO = f"""v_app_info AS (
  SELECT appid, name,
         coalesce(release_date, {q(K.UNKNOWN)}) AS release_date,
         CASE WHEN is_free = false THEN coalesce(final_formatted, {q(K.FREE_PRICE)}) ELSE {q(K.FREE_PRICE)} END AS price,
         CASE WHEN len(coalesce(developers, [])) > 0 THEN array_to_string(developers, ', ') ELSE {q(K.UNKNOWN)} END AS developer,
         CASE WHEN len(coalesce(publishers, [])) > 0 THEN array_to_string(publishers, ', ') ELSE {q(K.UNKNOWN)} END AS publisher,
         coalesce(short_description, {q(K.NO_DESCRIPTION)}) AS short_description,
         coalesce(header_image, tiny_image) AS header_image
  FROM v_app_raw)"""

_BASE = S.SUMMARY_BASE_TIME.strftime("%Y-%m-%d %H:%M:%S")
V_APP_SUMMARY = f"""v_app_summary AS (
  SELECT appid,
         TIMESTAMP '{_BASE}' - to_hours(appid) AS last_updated,
         count_if(voted_up) AS total_positive,
         count_if(NOT voted_up) AS total_negative,
         {str_list(S.SUMMARY_RATINGS)}[appid % {len(S.SUMMARY_RATINGS)} + 1] AS review_score_desc
  FROM v_reviews GROUP BY appid)"""

V_PROFILES = f"""v_profiles AS (
  SELECT cast(c_custkey AS varchar) AS steamid,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_name END AS personaname,
         CASE WHEN c_nationkey < 5 THEN NULL ELSE 'avatar_' || cast(c_custkey AS varchar) || '.png' END AS avatarfull
  FROM customer WHERE c_acctbal >= 0)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- text (T1-T5, J4) -------------------------------------------------------

def rx(p: str) -> str:
    return q(p)


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, {rx(K.PAT_STRIP)}, '', 'g')"


def clean_scoring_sql(e: str) -> str:
    t = f"coalesce(cast({e} AS varchar), '')"
    for p in (K.PAT_URL, K.PAT_TAG, K.PAT_MENTION, K.PAT_HASHTAG):
        t = f"regexp_replace({t}, {rx(p)}, '', 'g')"
    t = f"substr({strip_sql(t)}, 1, {K.SCORING_MAX_CHARS})"
    return f"(CASE WHEN length({t}) = 0 THEN ' ' ELSE {t} END)"


def clean_topics_sql(e: str) -> str:
    t = f"regexp_replace(coalesce(cast({e} AS varchar), ''), {rx(K.PAT_TAG)}, '', 'g')"
    t = f"regexp_replace({t}, {rx(K.PAT_TOPIC_KEEP)}, ' ', 'g')"
    return strip_sql(t)


def clean_keywords_sql(e: str) -> str:
    t = f"regexp_replace(cast({e} AS varchar), {rx(K.PAT_LAZY_TAG)}, '', 'g')"
    t = f"regexp_replace({t}, {rx(K.PAT_CTRL_WS)}, ' ', 'g')"
    t = f"regexp_replace({t}, {rx(K.PAT_DISPLAY_KEEP)}, '', 'g')"
    return strip_sql(t)


def tokens_sql(e: str) -> str:
    han = K.HAN
    t = f"regexp_replace(lower({e}), '([{han}]+)', ' \\1 ', 'g')"
    parts = f"list_filter(string_split_regex({t}, {rx(K.PAT_SPLIT)}), lambda x: length(x) > 0)"
    expand = (f"lambda tk: CASE WHEN regexp_full_match(tk, '[{han}]+') AND length(tk) > 1 "
              f"THEN list_transform(range(1, length(tk)), lambda i: substr(tk, i, 2)) ELSE [tk] END")
    return f"flatten(list_transform({parts}, {expand}))"


def remove_stop_sql(arr: str, stopwords) -> str:
    return f"list_filter({arr}, lambda x: NOT list_contains({str_list(stopwords)}, x))"


# ---- topic chain (G13, M4-M8, J3) --------------------------------------------

def topic_ctes(src: str, group: list[str], doc: str, text: str, label: str, stopwords) -> list[str]:
    """CTEs info, docs, terms, tfidf, words, keywords, rep, summary, tmap, tips over CTE ``src``."""
    g = ", ".join(group)
    gc = (g + ", ") if group else ""
    part = f"PARTITION BY {g}" if group else ""

    def using(*extra):
        return "USING (" + ", ".join([*group, *extra]) + ")"

    return [
        f"""sizes AS (SELECT {gc}{label}, count(*) AS size FROM {src} GROUP BY ALL)""",
        f"""info AS (SELECT {gc}{label}, size,
         CASE WHEN {label} = '-1' THEN -1 ELSE row_number() OVER (PARTITION BY {gc}{label} = '-1'
              ORDER BY size DESC, {label}) - 1 END AS topic_id FROM sizes)""",
        f"""docs AS (SELECT {gc}s.{doc} AS {doc}, i.topic_id, {clean_topics_sql('s.' + text)} AS doc_text
         FROM {src} s JOIN info i {using(label)})""",
        f"""toks AS (SELECT *, {remove_stop_sql(tokens_sql('doc_text'), stopwords)} AS tokens FROM docs)""",
        f"""terms AS (SELECT {gc}topic_id, {doc}, word, count(*) AS tf
         FROM (SELECT {gc}topic_id, {doc}, unnest(tokens) AS word FROM toks) GROUP BY ALL)""",
        f"""tw AS (SELECT {gc}topic_id, word, cast(sum(tf) AS bigint) AS tf FROM terms GROUP BY ALL)""",
        f"""tt AS (SELECT {gc}topic_id, cast(sum(tf) AS bigint) AS topic_tokens FROM tw GROUP BY ALL)""",
        f"""tta AS (SELECT *, cast(floor(avg(topic_tokens) OVER ({part})) AS bigint) AS "A" FROM tt)""",
        f"""twf AS (SELECT *, cast(sum(tf) OVER (PARTITION BY {gc}word) AS bigint) AS f FROM tw)""",
        f"""tfidf AS (SELECT {gc}topic_id, word, tf, tf / topic_tokens * ln(cast(1 AS double) + "A" / f) AS weight,
                ln(cast(1 AS double) + "A" / f) AS idf
         FROM twf JOIN tta {using('topic_id')})""",
        f"""words AS (SELECT {gc}topic_id, rank, word, weight,
                greatest(cast(trunc(weight * 1000) AS int), 1) AS value
         FROM (SELECT *, row_number() OVER (PARTITION BY {gc}topic_id ORDER BY weight DESC, word) AS rank
               FROM tfidf WHERE topic_id <> -1 AND weight > 0) WHERE rank <= {K.TOPIC_WORDS_N})""",
        f"""keywords AS (SELECT {gc}topic_id, string_agg(word, {q(K.KEYWORD_SEP)} ORDER BY rank) AS keywords
         FROM words WHERE rank <= {K.TOPIC_KEYWORDS_N} AND length(trim(word)) > 0 GROUP BY ALL)""",
        f"""idf AS (SELECT DISTINCT {gc}word, idf FROM tfidf)""",
        f"""dt AS (SELECT t.*, t.tf * i.idf AS dw FROM terms t JOIN idf i {using('word')} WHERE t.topic_id <> -1)""",
        f"""dnorm AS (SELECT {gc}topic_id, {doc}, sqrt(sum(dw * dw)) AS dnorm FROM dt GROUP BY ALL)""",
        f"""tnorm AS (SELECT {gc}topic_id, sqrt(sum(weight * weight)) AS tnorm FROM tfidf WHERE topic_id <> -1 GROUP BY ALL)""",
        f"""dot AS (SELECT {gc}topic_id, {doc}, sum(dw * weight) AS dot FROM dt JOIN tfidf {using('topic_id', 'word')} GROUP BY ALL)""",
        f"""cand AS (SELECT d.*, round_even(coalesce(CASE WHEN dnorm > 0 AND tnorm > 0 THEN dot / (dnorm * tnorm)
                                                ELSE cast(0 AS double) END, cast(0 AS double)), 9) AS cosine
         FROM (SELECT * FROM docs WHERE topic_id <> -1) d
         LEFT JOIN dnorm {using('topic_id', doc)} LEFT JOIN dot {using('topic_id', doc)} LEFT JOIN tnorm {using('topic_id')})""",
        f"""rep AS (SELECT {gc}topic_id, rank, {doc}, doc_text, cosine FROM (
           SELECT *, row_number() OVER (PARTITION BY {gc}topic_id ORDER BY cosine DESC, {doc}) AS rank FROM cand)
         WHERE rank <= {K.TOPIC_DOCS_N})""",
        f"""summ AS (SELECT {gc}topic_id,
                string_agg('"' || {cut_sql(clean_topics_sql('doc_text'), K.SUMMARY_CUT)} || '"', {q(K.SUMMARY_SEP)} ORDER BY rank) AS summary
         FROM rep GROUP BY ALL)""",
        f"""tmap AS (SELECT {gc}topic_id, keywords, coalesce(summary, {q(K.NO_SUMMARY)}) AS summary
         FROM keywords LEFT JOIN summ {using('topic_id')})""",
        f"""tips AS (SELECT {gc}topic_id, word, value,
                CASE WHEN keywords IS NOT NULL THEN word || chr(10) || '主题: ' || keywords || chr(10) || '摘要: ' || summary
                     ELSE word || ' ' || {q(K.NO_TOPIC_TOOLTIP)} END AS tooltip
         FROM words LEFT JOIN tmap {using('topic_id')})""",
    ]


def cut_sql(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END)"


REVIEW_TOPIC_SRC = f"""rt AS (SELECT review_id, appid, CASE WHEN voted_up THEN 'positive' ELSE 'negative' END AS polarity,
         content, CASE WHEN n_chars < {S.OUTLIER_MAX_CHARS} THEN '-1' ELSE lang END AS topic_label FROM v_reviews WHERE content IS NOT NULL)"""


def flaws_sql(src: str = "tmap", polarity: str | None = "positive", keywords=K.CRITICAL_FLAW_KEYWORDS) -> str:
    text = "(coalesce(keywords, '') || coalesce(summary, ''))"
    hit = " OR ".join(f"contains({text}, {q(k)})" for k in keywords)
    where = f"WHERE polarity = {q(polarity)}" if polarity else ""
    return f"flaws AS (SELECT appid, bool_or({hit}) AS flaw_detected FROM {src} {where} GROUP BY appid)"
