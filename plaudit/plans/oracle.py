"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB against the driver's pre-registered views and
inlines the stand-in views as CTEs. Column names match the Spark side.
"""

from __future__ import annotations

from plaudit import constants as K
from plaudit.functions.vectors import HASH_BITS
from plaudit.operators.density import STEPS
from plaudit.plans.catalog import ASSIGN_COSINE, CALLBACK_DIMS, DENSITY_EPS, DENSITY_POINTS, FLAW_WORDS, SHORT_PAGES
from plaudit.plans.sqlparts import (BASE_SCORE, DISPLAY_RATING, REVIEW_TOPIC_SRC, V_APP_INFO, V_APP_RAW,
                                    V_APP_SUMMARY, V_PROFILES, V_REVIEWS, clean_keywords_sql, clean_scoring_sql,
                                    clean_topics_sql, flaws_sql, is_paid, q, remove_stop_sql, strip_sql, tokens_sql,
                                    topic_ctes, with_ctes)

ORACLE: dict[str, str] = {}


def nonan(c: str) -> str:
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


STATS = f"""stats AS (
  SELECT appid, count(*) AS n_reviews,
         avg({nonan('score_opt')}) AS opt_mean,
         avg({nonan('score_value')}) AS value_mean,
         count_if(voted_up = false) AS n_negative,
         count_if(voted_up = false AND try_cast(playtime_at_review AS double) <= {K.REFUND_MAX_MINUTES}) AS n_refund
  FROM v_reviews GROUP BY appid)"""


def penalty_sql(price: str = "price") -> str:
    return f"""(cast(1 AS double) - coalesce(opt_mean, {K.NEUTRAL_ASPECT})) * {K.OPT_PENALTY_WEIGHT} AS opt_penalty,
         CASE WHEN {is_paid(price)} THEN (cast(1 AS double) - coalesce(value_mean, {K.NEUTRAL_ASPECT})) * {K.VALUE_PENALTY_WEIGHT}
              ELSE cast(0 AS double) END AS value_penalty,
         CASE WHEN n_negative > 0 THEN n_refund / n_negative * {K.REFUND_PENALTY_WEIGHT} ELSE cast(0 AS double) END AS refund_penalty"""


def suggestion_sql(score: str, flaw: str) -> str:
    def note(cond, text):
        return f"CASE WHEN {score} < {K.NOTE_MAX_SCORE} AND {cond} THEN {q(text)} ELSE '' END"
    band = (f"CASE WHEN {score} < 25 THEN {q(K.SUGGEST_BELOW_25)} WHEN {score} > 90 THEN {q(K.SUGGEST_ABOVE_90)} "
            f"WHEN {score} > 75 THEN {q(K.SUGGEST_ABOVE_75)} WHEN {score} > 50 THEN {q(K.SUGGEST_ABOVE_50)} "
            f"ELSE {q(K.SUGGEST_OTHER)} END")
    return (f"({band}) || ({note('opt_penalty > ' + str(K.NOTE_OPT_ABOVE), K.NOTE_OPT)})"
            f" || ({note('value_penalty > ' + str(K.NOTE_VALUE_ABOVE), K.NOTE_VALUE)})"
            f" || ({note('refund_penalty > ' + str(K.NOTE_REFUND_ABOVE), K.NOTE_REFUND)})"
            f" || ({note('coalesce(' + flaw + ', false)', K.NOTE_FLAW)})")


def score_class_sql(c: str) -> str:
    return f"CASE WHEN {c} > 75 THEN 'high' WHEN {c} > 50 THEN 'mid' ELSE 'low' END"


def recommend_score_sql(flaw_cte: str | None = None, parts: bool = False):
    ctes = [V_REVIEWS, V_APP_RAW, V_APP_INFO, V_APP_SUMMARY, STATS]
    flaw_join = "LEFT JOIN flaws f ON f.appid = a.appid" if flaw_cte else ""
    flaw_col = "f.flaw_detected" if flaw_cte else "false"
    if flaw_cte:
        ctes.append(flaw_cte)
    ctes.append(f"""apps AS (
  SELECT coalesce(i.appid, s.appid) AS appid, i.price, s.n_reviews, s.opt_mean, s.value_mean,
         s.n_negative, s.n_refund
  FROM v_app_info i FULL OUTER JOIN stats s ON i.appid = s.appid)""")
    ctes.append(f"""pen AS (
  SELECT a.appid, a.n_reviews, m.review_score_desc, {flaw_col} AS flaw_detected,
         {penalty_sql('a.price')}
  FROM apps a LEFT JOIN v_app_summary m ON m.appid = a.appid {flaw_join})""")
    ctes.append(f"""fin AS (
  SELECT *, {BASE_SCORE} AS base,
         cast(trunc(least(greatest(cast({BASE_SCORE} AS double) - (opt_penalty + value_penalty + refund_penalty), 0.0), 100.0)) AS int) AS final_score,
         coalesce(n_reviews, 0) > 0 AS has_reviews
  FROM pen)""")
    body = f"""SELECT appid,
       CASE WHEN has_reviews THEN base ELSE NULL END AS base_score,
       CASE WHEN has_reviews THEN final_score ELSE {K.NEUTRAL_SCORE} END AS score,
       {score_class_sql(f'CASE WHEN has_reviews THEN final_score ELSE {K.NEUTRAL_SCORE} END')} AS score_class,
       CASE WHEN has_reviews THEN {suggestion_sql('final_score', 'flaw_detected')} ELSE {q(K.SUGGEST_NO_REVIEWS)} END AS suggestion
FROM fin"""
    if parts:
        return ctes, body
    return with_ctes(*ctes, body=body)


REVIEW_TOPICS = [V_REVIEWS, REVIEW_TOPIC_SRC,
                 *topic_ctes("rt", ["appid", "polarity"], "review_id", "content", "topic_label", K.DOMAIN_STOPWORDS)]


def recommend_score_with_flaws_sql(polarity: str = "positive") -> str:
    sql = recommend_score_sql(flaw_cte="__FLAWS__")
    # the topic chain CTEs go in front of the score CTEs (v_reviews defined once)
    topic = ",\n".join(REVIEW_TOPICS[1:] + [flaws_sql("tmap", polarity)])
    return sql.replace(",\n__FLAWS__", "").replace(V_REVIEWS + ",\n", V_REVIEWS + ",\n" + topic + ",\n", 1)


ORACLE["recommend_score"] = recommend_score_with_flaws_sql()
ORACLE["recommend_score_negative"] = recommend_score_with_flaws_sql("negative")

ORACLE["penalties"] = with_ctes(V_REVIEWS, V_APP_RAW, V_APP_INFO, STATS, body=f"""
SELECT appid, n_reviews, round_even(opt_penalty, 6) AS opt_penalty, round_even(value_penalty, 6) AS value_penalty,
       round_even(refund_penalty, 6) AS refund_penalty
FROM (SELECT s.appid, s.n_reviews, {penalty_sql('i.price')}
      FROM stats s LEFT JOIN v_app_info i ON i.appid = s.appid)""")

ORACLE["base_score"] = with_ctes(V_REVIEWS, V_APP_SUMMARY, body=f"""
SELECT appid, review_score_desc, {BASE_SCORE} AS base_score FROM v_app_summary""")

ORACLE["translate_rating"] = with_ctes(V_REVIEWS, V_APP_SUMMARY, body=f"""
SELECT appid, review_score_desc, {DISPLAY_RATING} AS rating_display FROM v_app_summary""")

ORACLE["is_paid"] = with_ctes(V_APP_RAW, V_APP_INFO, body=f"""
SELECT appid, price, {is_paid('price')} AS is_paid FROM v_app_info""")

ORACLE["polarity_counts"] = with_ctes(V_REVIEWS, body="""
SELECT appid, count_if(voted_up = true) AS positive_count, count_if(voted_up = false) AS negative_count
FROM v_reviews GROUP BY appid""")

ORACLE["by_polarity"] = with_ctes(V_REVIEWS, body="""
SELECT review_id, appid, voted_up, votes_up FROM v_reviews WHERE voted_up = false""")

_radar_cols = ",\n       ".join(f"avg(CASE WHEN voted_up = true THEN {nonan(c)} END) AS {c}" for c in K.SCORE_COLUMNS)
_radar_rows = "\nUNION ALL ".join(
    f"SELECT appid, {i} AS dim_idx, {q(name)} AS dimension, coalesce(round_even({c} * 100, 1), 0.0) AS value, "
    f"{K.RADAR_MAX} AS max FROM per_app"
    for i, (c, name) in enumerate(zip(K.SCORE_COLUMNS, K.RADAR_NAMES)))
ORACLE["aspect_radar"] = with_ctes(V_REVIEWS, f"""per_app AS (
  SELECT appid, {_radar_cols}
  FROM v_reviews GROUP BY appid)""", body=_radar_rows)


def stage_idx_sql(c: str) -> str:
    b = K.PLAYTIME_BINS
    m = f"try_cast({c} AS double)"
    whens = " ".join(f"WHEN {m} > {b[i]} AND {m} <= {b[i + 1]} THEN {i}" for i in range(len(b) - 1))
    return f"(CASE {whens} ELSE NULL END)"


def stage_label_sql(c: str) -> str:
    labels = "[" + ", ".join(q(x) for x in K.PLAYTIME_LABELS) + "]"
    return f"{labels}[{stage_idx_sql(c)} + 1]"


ORACLE["playtime_stage"] = with_ctes(V_REVIEWS, body=f"""
SELECT appid, stage, count(*) AS n_reviews
FROM (SELECT appid, {stage_label_sql('playtime_at_review')} AS stage FROM v_reviews)
GROUP BY appid, stage""")


def row_mean_sql(cols=K.SCORE_COLUMNS) -> str:
    vals = [nonan(c) for c in cols]
    total = " + ".join(f"coalesce({v}, 0.0)" for v in vals)
    n = " + ".join(f"(CASE WHEN {v} IS NOT NULL THEN 1 ELSE 0 END)" for v in vals)
    return f"(CASE WHEN ({n}) > 0 THEN (cast(0 AS double) + {total}) / ({n}) END)"


ORACLE["row_mean"] = with_ctes(V_REVIEWS, body=f"""
SELECT review_id, round_even({row_mean_sql()} * 1000, 6) AS mean_x1000 FROM v_reviews""")

_ps_aggs = ",\n       ".join(
    f"avg(CASE WHEN st = {i} AND voted_up = true THEN rm END) AS p{i}, "
    f"avg(CASE WHEN st = {i} AND voted_up = false THEN rm END) AS n{i}"
    for i in range(len(K.PLAYTIME_LABELS)))
_ps_rows = "\nUNION ALL ".join(
    f"SELECT appid, {i} AS stage_idx, {q(label)} AS stage, round_even(coalesce(p{i}, {K.STAGE_FILL}) * 100, 1) AS positive, "
    f"round_even(coalesce(n{i}, {K.STAGE_FILL}) * 100, 1) AS negative FROM per_app"
    for i, label in enumerate(K.PLAYTIME_LABELS))
ORACLE["playtime_sentiment"] = with_ctes(V_REVIEWS, f"""base AS (
  SELECT appid, voted_up, {stage_idx_sql('playtime_at_review')} AS st, {row_mean_sql()} AS rm FROM v_reviews)""",
                                         f"""per_app AS (SELECT appid, {_ps_aggs} FROM base GROUP BY appid)""",
                                         body=_ps_rows)


def monthly_sql(month_expr: str, extra_cols: str = "") -> str:
    return with_ctes(V_REVIEWS, f"""m AS (SELECT appid, {month_expr} AS month, voted_up FROM v_reviews)""",
                     """counts AS (SELECT appid, month, count_if(voted_up) AS positive, count_if(NOT voted_up) AS negative
               FROM m GROUP BY appid, month)""",
                     """bounds AS (SELECT appid,
       min(CASE WHEN positive > 0 THEN month END) AS plo, max(CASE WHEN positive > 0 THEN month END) AS phi,
       min(CASE WHEN negative > 0 THEN month END) AS nlo, max(CASE WHEN negative > 0 THEN month END) AS nhi
  FROM counts GROUP BY appid)""",
                     """skel AS (
  SELECT appid, cast(unnest(generate_series(plo, phi, INTERVAL 1 MONTH)) AS date) AS month FROM bounds WHERE plo IS NOT NULL
  UNION
  SELECT appid, cast(unnest(generate_series(nlo, nhi, INTERVAL 1 MONTH)) AS date) AS month FROM bounds WHERE nlo IS NOT NULL)""",
                     body=f"""SELECT s.appid, strftime(s.month, '%Y-%m') AS month,
       cast(coalesce(c.positive, 0) AS bigint) AS positive, cast(coalesce(c.negative, 0) AS bigint) AS negative{extra_cols}
FROM skel s LEFT JOIN counts c ON c.appid = s.appid AND c.month = s.month""")


ORACLE["monthly_counts"] = monthly_sql("cast(date_trunc('month', ts) AS date)")
ORACLE["monthly_counts_gaps"] = monthly_sql(
    "cast(date_trunc('month', to_timestamp(cast(epoch(ts) AS bigint)) AT TIME ZONE 'UTC') AS date)",
    ",\n       coalesce(c.positive, 0) + coalesce(c.negative, 0) = 0 AS is_gap")


def hours_sql(c: str) -> str:
    m = f"cast({c} AS bigint)"
    a = f"abs({m})"
    qq = f"(floor({a} / 6))"
    r = f"({a} - {qq} * 6)"
    h10 = f"(cast({qq} AS bigint) + CASE WHEN {r} > 3 OR ({r} = 3 AND cast({qq} AS bigint) % 2 = 1) THEN 1 ELSE 0 END)"
    return (f"CASE WHEN {m} IS NULL THEN NULL ELSE (CASE WHEN {m} < 0 AND {h10} > 0 THEN '-' ELSE '' END) || "
            f"cast(cast(floor({h10} / 10) AS bigint) AS varchar) || '.' || cast({h10} % 10 AS varchar) END")


def cut_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


ORACLE["review_cards"] = with_ctes(V_REVIEWS, body=f"""
SELECT review_id, appid, author_name, {cut_sql("coalesce(content, '')", K.CARD_MAX_CHARS)} AS card_text,
       {hours_sql('playtime_at_review')} AS hours,
       CASE WHEN voted_up THEN '👍好评' ELSE '👎差评' END AS badge,
       cast(votes_up AS bigint) AS votes_up
FROM v_reviews""")

ORACLE["normalise_app_info"] = with_ctes(V_APP_RAW, V_APP_INFO, body="SELECT * FROM v_app_info")

ORACLE["enrich_profiles"] = with_ctes(V_REVIEWS, V_PROFILES, body=f"""
SELECT r.author_name, r.review_id, r.appid,
       CASE WHEN p.steamid IS NOT NULL THEN coalesce(p.personaname, {q(K.PROFILE_NO_NAME)}) ELSE {q(K.PROFILE_UNKNOWN)} END AS nickname,
       CASE WHEN p.steamid IS NOT NULL THEN coalesce(p.avatarfull, {q(K.DEFAULT_AVATAR)}) ELSE {q(K.DEFAULT_AVATAR)} END AS avatar
FROM v_reviews r LEFT JOIN v_profiles p ON p.steamid = r.author_name""")

ORACLE["sample_by_polarity"] = with_ctes(V_REVIEWS, body=f"""
SELECT review_id, appid, voted_up, votes_up FROM (
  SELECT *, row_number() OVER (PARTITION BY appid, voted_up ORDER BY votes_up DESC NULLS LAST, review_id) AS rn
  FROM v_reviews) WHERE rn <= {K.SAMPLE_PER_POLARITY}""")


TEXTS = """texts AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page' AS kind, page_id AS id, html AS text FROM pages)"""

ORACLE["clean_for_scoring"] = with_ctes(TEXTS, body=f"SELECT kind, id, {clean_scoring_sql('text')} AS clean FROM texts")
ORACLE["clean_for_topics"] = with_ctes(TEXTS, body=f"SELECT kind, id, {clean_topics_sql('text')} AS clean FROM texts")
ORACLE["clean_for_keywords"] = with_ctes(TEXTS, body=f"SELECT kind, id, {clean_keywords_sql('text')} AS clean FROM texts")
ORACLE["tokens"] = with_ctes(TEXTS, f"t AS (SELECT kind, id, {tokens_sql(clean_topics_sql('text'))} AS toks FROM texts)",
                             body="SELECT kind, id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t")
ORACLE["tokens_filtered"] = with_ctes(
    TEXTS, f"t AS (SELECT kind, id, {remove_stop_sql(tokens_sql(clean_topics_sql('text')), K.DOMAIN_STOPWORDS)} AS toks FROM texts)",
    body="SELECT kind, id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t")

ORACLE["topic_info"] = with_ctes(*REVIEW_TOPICS, body="SELECT appid, polarity, topic_label, size, topic_id FROM info WHERE topic_id <> -1")
ORACLE["topic_words"] = with_ctes(*REVIEW_TOPICS, body="""
SELECT appid, polarity, topic_id, rank, word, value, round_even(weight, 9) AS weight FROM words""")
ORACLE["topic_keywords"] = with_ctes(*REVIEW_TOPICS, body="SELECT * FROM keywords")
ORACLE["representative_docs"] = with_ctes(*REVIEW_TOPICS, body="""
SELECT appid, polarity, topic_id, rank, review_id, cosine FROM rep""")
ORACLE["topic_summary"] = with_ctes(*REVIEW_TOPICS, body="SELECT * FROM summ")
ORACLE["topic_map"] = with_ctes(*REVIEW_TOPICS, body="SELECT * FROM tmap")
ORACLE["word_tooltips"] = with_ctes(*REVIEW_TOPICS, body="SELECT * FROM tips")
ORACLE["critical_flaws"] = with_ctes(*REVIEW_TOPICS, flaws_sql("tmap", None), body="SELECT * FROM flaws")

DOC_TOPIC_SRC = "dsrc AS (SELECT doc_id, text, source AS topic_label FROM documents)"
ORACLE["class_tfidf"] = with_ctes(DOC_TOPIC_SRC, *topic_ctes("dsrc", [], "doc_id", "text", "topic_label", K.DOMAIN_STOPWORDS),
                                  body="SELECT topic_id, word, tf, round_even(weight, 9) AS weight FROM tfidf")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# ---- ingest and table rules (A1, A3-A5, A7, A11-A14) ---------------------------------

from plaudit.plans.sqlparts import str_list as _str_list  # noqa: E402
from plaudit.constants import PAT_SPLIT as _SPLIT  # noqa: E402
from plaudit.sources import standins as _S  # noqa: E402

_PAGES = f"""pages_src AS (
  SELECT conv_id AS appid, turn AS page_no, role, text,
         role = 'system' OR (role = 'assistant' AND length(text) > {_S.PAGE_NO_REVIEWS_MIN_CHARS}) AS bad,
         length(text) < {_S.PAGE_LAST_MAX_CHARS} AS no_cursor
  FROM conversations)"""


def _flat(src: str) -> str:
    return f"""SELECT cast(appid AS bigint) AS appid,
       cast(appid AS varchar) || '-' || cast(page_no AS varchar) AS author_name,
       CASE WHEN role = 'user' THEN '' ELSE 'av_' || cast(appid AS varchar) END AS author_avatar,
       line AS content,
       length(line) % 2 = 0 AS voted_up,
       cast(length(line) AS bigint) AS playtime_at_review,
       cast(page_no + pos AS bigint) AS votes_up,
       cast({_S.PAGE_EPOCH_BASE} + appid * 86400 + page_no * 3600 + pos AS bigint) AS timestamp_created,
       page_no, cast(pos AS int) AS review_pos
FROM (SELECT appid, page_no, role, unnest(l) AS line, unnest(range(len(l))) AS pos
      FROM (SELECT *, string_split(text, chr(10)) AS l FROM {src}
            WHERE NOT (role = 'assistant' AND length(text) > {_S.PAGE_NO_REVIEWS_MIN_CHARS})))"""


ORACLE["flatten_reviews"] = with_ctes(_PAGES, body=_flat("pages_src"))

ORACLE["extract_summary"] = with_ctes(_PAGES, body="""
SELECT appid, page_no, cast(page_no * 10 AS bigint) AS total_positive, cast(length(text) AS bigint) AS total_negative,
       role AS review_score_desc
FROM pages_src WHERE role <> 'system'""")

ORACLE["valid_page_prefix"] = with_ctes(_PAGES, f"""valid AS (
  SELECT * FROM (
    SELECT *, row_number() OVER w AS rk,
           sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad_upto,
           coalesce(sum(CASE WHEN no_cursor THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS end_before
    FROM pages_src WINDOW w AS (PARTITION BY appid ORDER BY page_no))
  WHERE rk <= {K.MAX_PAGES} AND bad_upto = 0 AND end_before = 0)""", body=_flat("valid"))


def _words(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), {q(_SPLIT)}), lambda x: length(x) > 0)"


ORACLE["resolve_app"] = with_ctes(V_APP_RAW, V_APP_INFO, """terms AS (
  SELECT DISTINCT term FROM (SELECT p_name AS term FROM part
                             UNION ALL SELECT unnest(string_split(p_name, ' ')) AS term FROM part))""",
                                  f"""tw AS (SELECT term, word, count(*) OVER (PARTITION BY term) AS n_words
         FROM (SELECT DISTINCT term, unnest({_words('term')}) AS word FROM terms))""",
                                  f"""aw AS (SELECT DISTINCT appid, name, unnest({_words('name')}) AS word FROM v_app_info)""",
                                  """hits AS (SELECT term, appid, name FROM tw JOIN aw USING (word)
         GROUP BY term, appid, name, n_words HAVING count(*) = n_words)""",
                                  """best AS (SELECT term, appid, name FROM (
           SELECT *, row_number() OVER (PARTITION BY term ORDER BY length(name), appid) AS rn FROM hits) WHERE rn = 1)""",
                                  body="SELECT t.term, b.appid, b.name FROM terms t LEFT JOIN best b USING (term)")

ORACLE["enrich_app_metadata"] = with_ctes(V_APP_RAW, V_APP_INFO, f"""meta AS (
  SELECT cast(p_partkey AS int) AS appid, CASE WHEN p_size > 40 THEN 404 ELSE 200 END AS status,
         p_brand AS meta_developer, p_retailprice AS meta_price
  FROM part)""", body="""
SELECT i.appid, i.name, i.price, m.meta_developer, m.meta_price
FROM v_app_info i LEFT JOIN (SELECT * FROM meta WHERE status = 200) m USING (appid)""")

_NOW = _S.SUMMARY_BASE_TIME.strftime("%Y-%m-%d %H:%M:%S")
_FRESH = f"""fresh AS (
  SELECT i.appid, m.last_updated,
         coalesce(TIMESTAMP '{_NOW}' < m.last_updated + INTERVAL {K.CACHE_HOURS} HOUR, false) AS is_fresh
  FROM v_app_info i LEFT JOIN v_app_summary m USING (appid))"""
_REFRESH = """refresh AS (
  SELECT r.appid, r.force, f.is_fresh, s.appid IS NOT NULL AS has_rows,
         CASE WHEN NOT r.force AND f.is_fresh AND s.appid IS NOT NULL THEN 'HIT' ELSE 'FETCH' END AS action
  FROM (SELECT appid, coalesce(starts_with(name, 'red '), false) AS force FROM v_app_info) r
  LEFT JOIN fresh f USING (appid)
  LEFT JOIN (SELECT DISTINCT appid FROM v_reviews) s USING (appid))"""
_TABLE_BASE = [V_REVIEWS, V_APP_RAW, V_APP_INFO, V_APP_SUMMARY, _FRESH, _REFRESH]

ORACLE["fresh_apps"] = with_ctes(*_TABLE_BASE[:5], body="SELECT * FROM fresh")
ORACLE["plan_refresh"] = with_ctes(*_TABLE_BASE, body="SELECT * FROM refresh")
ORACLE["plan_recompute"] = with_ctes(*_TABLE_BASE, f"""arts AS (
  SELECT appid, kind FROM (SELECT appid, total_positive, total_negative, unnest({_str_list(K.ARTEFACT_KINDS)}) AS kind
                           FROM v_app_summary)
  WHERE NOT (kind = 'playtime_sentiment' AND total_negative > total_positive))""", body=f"""
SELECT r.appid, r.action = 'FETCH' AS fresh_fetch, coalesce(k.n_kinds, 0) AS n_kinds,
       (r.action = 'FETCH') OR coalesce(k.n_kinds, 0) < {len(K.ARTEFACT_KINDS)} AS recompute
FROM refresh r LEFT JOIN (SELECT appid, count(DISTINCT kind) AS n_kinds FROM arts GROUP BY appid) k USING (appid)""")

ORACLE["upsert_summary"] = with_ctes(*_TABLE_BASE, f"""new AS (
  SELECT f.appid, TIMESTAMP '{_NOW}' AS last_updated,
         coalesce(c.total_positive, 0) AS total_positive, coalesce(c.total_negative, 0) AS total_negative,
         coalesce({DISPLAY_RATING.replace('review_score_desc', 'o.review_score_desc')}, {q(K.NO_RATING)}) AS review_score_desc
  FROM (SELECT appid FROM refresh WHERE action = 'FETCH') f
  LEFT JOIN (SELECT appid, count_if(voted_up = true) AS total_positive, count_if(voted_up = false) AS total_negative
             FROM v_reviews GROUP BY appid) c USING (appid)
  LEFT JOIN v_app_summary o USING (appid))""", body="""
SELECT appid, last_updated, total_positive, total_negative, review_score_desc FROM (
  SELECT *, row_number() OVER (PARTITION BY appid ORDER BY last_updated DESC NULLS LAST, prio DESC) AS rn
  FROM (SELECT appid, last_updated, total_positive, total_negative, review_score_desc, 0 AS prio FROM v_app_summary
        UNION ALL SELECT appid, last_updated, total_positive, total_negative, review_score_desc, 1 AS prio FROM new))
WHERE rn = 1""")


# ---- keyword cloud (G14) and aspect scoring (M1) --------------------------------------

def _kw_tokens_sql(e: str) -> str:
    # the oracle spells Han bigrams with list functions (RE2 has no look-around)
    han = K.HAN
    t = f"regexp_replace({e}, '[.,!?]', ' ', 'g')"
    parts = f"list_filter(string_split_regex({t}, {q(_SPLIT)}), lambda x: length(x) > 0)"
    pieces = f"list_filter(string_split_regex(regexp_replace(tk, '([{han}]+)', ' \\1 ', 'g'), {q(_SPLIT)}), lambda x: length(x) > 0)"
    expand = (f"lambda tk: flatten(list_transform({pieces}, lambda u: CASE WHEN regexp_full_match(u, '[{han}]+') AND length(u) > 1 "
              f"THEN list_transform(range(1, length(u)), lambda i: substr(u, i, 2)) ELSE [u] END))")
    return f"flatten(list_transform({parts}, {expand}))"


STOP_FILE = f"stop AS (SELECT DISTINCT {strip_sql('word')} AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS word FROM benchmark))"
ORACLE["keyword_frequency"] = with_ctes(V_REVIEWS, STOP_FILE, f"""w AS (
  SELECT appid, polarity, regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS word FROM (
    SELECT appid, CASE WHEN voted_up THEN 'positive' ELSE 'negative' END AS polarity,
           unnest({_kw_tokens_sql(clean_keywords_sql('content'))}) AS word
    FROM v_reviews WHERE content IS NOT NULL))""", f"""c AS (
  SELECT appid, polarity, word, count(*) AS count FROM w
  WHERE length(word) > 1 AND word NOT IN (SELECT word FROM stop)
  GROUP BY ALL)""", body=f"""
SELECT *, row_number() OVER (PARTITION BY appid, polarity ORDER BY count DESC, word) AS rank FROM c""")


def _dot_sql(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda acc, x: acc + x, cast(0 AS double))"


_proto_cols = ",\n       ".join(
    f"CASE WHEN v IS NULL OR vn = 0 THEN {K.NEUTRAL_ASPECT} ELSE round_even((cast(1 AS double) + "
    f"{_dot_sql('v', f'p{i}')} / (vn * sqrt({_dot_sql(f'p{i}', f'p{i}')}))) / 2, 6) END AS {c}"
    for i, c in enumerate(K.SCORE_COLUMNS))
ORACLE["vector_scores"] = with_ctes("""protos AS (
  SELECT label, arg_min(cast(embedding AS double[]), vec_id) AS p FROM embeddings WHERE label IN (0, 1, 2, 3, 4) GROUP BY label)""",
                                    f"""pv AS (SELECT {', '.join(f"max(CASE WHEN label = {i} THEN p END) AS p{i}" for i in range(5))} FROM protos)""",
                                    """rv AS (SELECT vec_id AS review_id, cast(embedding AS double[]) AS v FROM embeddings)""",
                                    f"""rvn AS (SELECT *, sqrt({_dot_sql('v', 'v')}) AS vn FROM rv)""",
                                    body=f"SELECT review_id,\n       {_proto_cols}\nFROM rvn, pv")


def bucket_sql(word: str) -> str:
    return f"cast(cast('0x' || substr(md5({word}), 1, 8) AS bigint) % {1 << HASH_BITS} AS int)"


def _tf_sql(src: str, key: str, tokens: str) -> str:
    return f"""SELECT {key}, bucket, count(*) AS tf FROM (SELECT {key}, {bucket_sql('w')} AS bucket FROM (SELECT {key}, unnest({tokens}) AS w FROM {src})) GROUP BY ALL"""


def _idf_sql(tf: str, key: str) -> str:
    return f"""SELECT bucket, ln((SELECT cast(count(DISTINCT {key}) + 1 AS double) FROM {tf}) / (count(*) + 1)) + 1 AS idf FROM {tf} GROUP BY bucket"""


_score_tokens = tokens_sql(clean_topics_sql(clean_scoring_sql("content")))
_n_aspects = len(K.SCORE_COLUMNS)
ORACLE["aspect_scores"] = with_ctes(
    V_REVIEWS, f"tf AS ({_tf_sql('v_reviews', 'review_id', _score_tokens)})", f"idf AS ({_idf_sql('tf', 'review_id')})",
    f"said AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS aspect, text AS content FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT {_n_aspects}))",
    f"htf AS ({_tf_sql('said', 'aspect', _score_tokens)})",
    "h AS (SELECT aspect, bucket, tf * idf AS w FROM htf JOIN idf USING (bucket))", "hn AS (SELECT aspect, sqrt(sum(w * w)) AS hnorm FROM h GROUP BY aspect)",
    "r AS (SELECT review_id, bucket, tf * idf AS w FROM tf JOIN idf USING (bucket))", "rn AS (SELECT review_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY review_id)",
    "dots AS (SELECT review_id, aspect, sum(r.w * h.w) AS dot FROM r JOIN h USING (bucket) GROUP BY ALL)",
    f"pairs AS (SELECT review_id, norm, unnest(range({_n_aspects})) AS aspect FROM rn)",
    f"""scored AS (SELECT review_id, aspect, CASE WHEN hnorm > 0 THEN round_even((cast(1 AS double) + coalesce(dot, 0) / (norm * hnorm)) / 2, 6) ELSE {K.NEUTRAL_ASPECT} END AS s
         FROM pairs LEFT JOIN hn USING (aspect) LEFT JOIN dots USING (review_id, aspect))""",
    body="SELECT v.review_id, v.appid, " + ", ".join(f"coalesce(max(CASE WHEN aspect = {i} THEN s END), cast({K.NEUTRAL_ASPECT} AS double)) AS {c}" for i, c in enumerate(K.SCORE_COLUMNS))
    + " FROM v_reviews v LEFT JOIN scored USING (review_id) GROUP BY v.review_id, v.appid")

ORACLE["hashed_terms"] = with_ctes(
    f"tf AS ({_tf_sql('documents', 'doc_id', tokens_sql(clean_topics_sql('text')))})", f"idf AS ({_idf_sql('tf', 'doc_id')})",
    "r AS (SELECT doc_id, bucket, tf * idf AS w FROM tf JOIN idf USING (bucket))",
    body="SELECT doc_id, bucket, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM r")


# ---- density topics (M3) over the given vectors, and M8 on what they find ------------------

def _density_ctes() -> list[str]:
    """Neighbour counts, cores, reachability and borders by plain joins on whole numbers."""
    def along(k: int) -> str:
        return (f"list_reduce(list_transform(cast(embedding AS double[]), lambda x, i: CASE WHEN ((i - 1) & {1 << k}) <> 0 THEN -x ELSE x END), "
                f"lambda s, x: s + x, cast(0 AS double)) / sqrt(cast(len(embedding) AS double))")
    at = ", ".join(f"cast(floor(({along(k)}) * {STEPS / DENSITY_EPS!r} + 0.5) AS bigint) AS {c}" for k, c in enumerate("xyz"))
    far = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return [
        f"pts AS (SELECT vec_id, {at} FROM embeddings)",
        "folded AS (SELECT x, y, z, count(*) AS weight, min(vec_id) AS first FROM pts GROUP BY x, y, z)",
        f"cores AS (SELECT a.x, a.y, a.z, a.first FROM folded a JOIN folded b ON {far} <= {STEPS * STEPS} GROUP BY ALL HAVING sum(b.weight) >= {DENSITY_POINTS})",
        f"links AS (SELECT a.first AS a, b.first AS b FROM cores a JOIN cores b ON {far} <= {STEPS * STEPS} AND a.first <> b.first)",
        "reach AS (SELECT first AS node, first AS root FROM cores UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)",
        "named AS (SELECT c.x, c.y, c.z, min(r.root) AS cluster FROM cores c JOIN reach r ON r.node = c.first GROUP BY ALL)",
        f"""border AS (SELECT a.x, a.y, a.z, arg_min(b.cluster, ({far}) * 1000000000 + b.cluster) AS cluster
         FROM (SELECT * FROM folded ANTI JOIN cores USING (x, y, z)) a JOIN named b ON {far} <= {STEPS * STEPS} GROUP BY ALL)""",
        "placed AS (SELECT * FROM named UNION ALL SELECT * FROM border)",
        f"""clusters AS (SELECT cluster, cast(row_number() OVER (ORDER BY size DESC, cluster) - 1 AS int) AS topic_id
         FROM (SELECT cluster, sum(weight) AS size FROM folded JOIN placed USING (x, y, z) GROUP BY cluster) WHERE size >= {DENSITY_POINTS})""",
        "density AS (SELECT vec_id, coalesce(topic_id, -1) AS topic_id FROM pts LEFT JOIN placed USING (x, y, z) LEFT JOIN clusters USING (cluster))",
    ]


def _recursive(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


ORACLE["density_topics"] = _recursive(*_density_ctes(), body="SELECT vec_id, topic_id FROM density")


def _assign_ctes() -> list[str]:
    stored = topic_ctes("fsrc", [], "doc_id", "text", "topic_label", K.DOMAIN_STOPWORDS)[:10]  # up to tfidf
    toks = remove_stop_sql(tokens_sql(clean_topics_sql("text")), K.DOMAIN_STOPWORDS)
    return [
        "fsrc AS (SELECT d.doc_id, d.text, cast(t.topic_id AS varchar) AS topic_label FROM documents d JOIN density t ON t.vec_id = d.doc_id)",
        *stored,
        "model AS (SELECT topic_id, word, weight, idf, sqrt(sum(weight * weight) OVER (PARTITION BY topic_id)) AS norm FROM tfidf)",
        "late AS (SELECT d.doc_id, d.text FROM documents d ANTI JOIN fsrc f ON f.doc_id = d.doc_id)",
        f"lt AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({toks}) AS word FROM late) GROUP BY ALL)",
        "lw AS (SELECT doc_id, word, tf * idf AS w FROM lt JOIN (SELECT DISTINCT word, idf FROM model) USING (word))",
        "ln_ AS (SELECT doc_id, sqrt(sum(w * w)) AS own FROM lw GROUP BY doc_id)",
        "ld AS (SELECT doc_id, topic_id, sum(w * (weight / norm)) AS dot FROM lw JOIN model USING (word) WHERE topic_id <> -1 AND norm > 0 GROUP BY ALL)",
        "near AS (SELECT doc_id, topic_id, round_even(dot / own, 9) AS cosine FROM ld JOIN ln_ USING (doc_id) WHERE own > 0)",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, topic_id) AS rn FROM near) WHERE rn = 1)",
        f"""assigned AS (SELECT l.doc_id, CASE WHEN b.cosine >= {ASSIGN_COSINE} THEN cast(b.topic_id AS int) ELSE -1 END AS topic_id, coalesce(b.cosine, cast(0 AS double)) AS cosine
         FROM late l LEFT JOIN best b USING (doc_id))""",
    ]


ORACLE["assigned_topics"] = _recursive(*_density_ctes(), *_assign_ctes(), body="SELECT * FROM assigned")
_ALL_DOCS = f"""all_docs AS MATERIALIZED (
  {_recursive(*_density_ctes(), *_assign_ctes(), body="""SELECT doc_id, text, topic_label FROM fsrc UNION ALL
  SELECT l.doc_id, l.text, coalesce(i.topic_label, '-1') FROM late l JOIN assigned a USING (doc_id) LEFT JOIN info i ON i.topic_id = a.topic_id""")})"""
ORACLE["discovered_topic_map"] = with_ctes(_ALL_DOCS, *topic_ctes("all_docs", [], "doc_id", "text", "topic_label", K.DOMAIN_STOPWORDS), body="SELECT * FROM tmap")


# ---- dashboard (J5) and time-series document (A16) --------------------------------------

def _dashboard_sql(score: str = "recommend_score") -> str:
    full = ORACLE[score]
    # wrap the flagship as a CTE named score_rows, then assemble the dashboard
    head, _, tail = full.rpartition("\nSELECT appid,\n       CASE WHEN has_reviews THEN base")
    body = "SELECT appid,\n       CASE WHEN has_reviews THEN base" + tail
    return head + f""",
score_rows AS ({body}),
cnt AS (SELECT appid, count_if(voted_up = true) AS positive_count, count_if(voted_up = false) AS negative_count
        FROM v_reviews GROUP BY appid)
SELECT i.appid, i.name, i.price, i.developer, i.publisher, i.release_date,
       coalesce({DISPLAY_RATING.replace('review_score_desc', 'm.review_score_desc')}, {q(K.NO_RATING)}) AS rating_display,
       coalesce(c.positive_count, 0) AS positive_count, coalesce(c.negative_count, 0) AS negative_count,
       s.score, s.score_class, s.suggestion
FROM v_app_info i LEFT JOIN v_app_summary m USING (appid) LEFT JOIN cnt c USING (appid)
LEFT JOIN score_rows s USING (appid)"""


ORACLE["dashboard"] = _dashboard_sql()
ORACLE["dashboard_negative"] = _dashboard_sql("recommend_score_negative")

ORACLE["export_timeseries_json"] = ORACLE["monthly_counts"].replace(
    "SELECT s.appid, strftime(s.month, '%Y-%m') AS month,",
    "SELECT appid, 'timeseries' AS kind, to_json({'dates': list(month ORDER BY month), "
    "'positive_counts': list(positive ORDER BY month), 'negative_counts': list(negative ORDER BY month)}) AS json\n"
    "FROM (SELECT s.appid, strftime(s.month, '%Y-%m') AS month,", 1) + ") GROUP BY appid"

# the stream's monthly roll-up equals the batch monthly counts
ORACLE["stream_monthly_counts"] = ORACLE["monthly_counts"]

# the stream's final table equals the batch upsert
ORACLE["stream_summary_upserts"] = ORACLE["upsert_summary"]

# artefact documents as JSON (A16), built on the metric oracles
ORACLE["export_radar_json"] = f"""SELECT appid, 'radar' AS kind,
  to_json({{'indicator': list({{'name': dimension, 'max': max}} ORDER BY dim_idx),
            'value': list(value ORDER BY dim_idx)}}) AS json
FROM ({ORACLE['aspect_radar']}) r GROUP BY appid"""
ORACLE["export_playtime_json"] = f"""SELECT appid, 'playtime_sentiment' AS kind,
  to_json({{'labels': list(stage ORDER BY stage_idx), 'positive_scores': list(positive ORDER BY stage_idx),
            'negative_scores': list(negative ORDER BY stage_idx)}}) AS json
FROM ({ORACLE['playtime_sentiment']}) p GROUP BY appid"""
ORACLE["export_score_json"] = f"""SELECT appid, 'score' AS kind, to_json({{'score': score, 'suggestion': suggestion}}) AS json
FROM ({ORACLE['recommend_score']}) s"""


def _topics_doc(polarity: str, kind: str) -> str:
    entry = ("cast(to_json(cast(topic_id AS varchar)) AS varchar) || ':' || "
             "cast(to_json({'keywords': keywords, 'summary': summary}) AS varchar)")
    return f"""SELECT c.appid, '{kind}' AS kind,
  '{{"topic_map":{{' || coalesce(m.entries, '') || '}},"word_data":' || coalesce(w.word_data, '[]') || '}}' AS json
FROM ({ORACLE['polarity_counts']}) c
LEFT JOIN (SELECT appid, string_agg({entry}, ',' ORDER BY cast(topic_id AS varchar)) AS entries
           FROM ({ORACLE['topic_map']}) t WHERE polarity = '{polarity}' GROUP BY appid) m USING (appid)
LEFT JOIN (SELECT appid, cast(to_json(list({{'name': word, 'value': value, 'topic_id': topic_id}} ORDER BY topic_id, rank)) AS varchar) AS word_data
           FROM ({ORACLE['topic_words']}) t WHERE polarity = '{polarity}' GROUP BY appid) w USING (appid)"""


ORACLE["export_artefacts"] = "\nUNION ALL\n".join(
    f"SELECT appid, kind, cast(json AS varchar) AS json FROM ({sql}) d"
    for sql in (ORACLE["export_score_json"], ORACLE["export_radar_json"], ORACLE["export_playtime_json"],
                ORACLE["export_timeseries_json"], _topics_doc("positive", "pos_topics"), _topics_doc("negative", "neg_topics")))


def _load_artefacts_sql(topics_kind: str) -> str:
    kinds = {"sc": "score", "tp": topics_kind, "ra": "radar", "pl": "playtime_sentiment", "ti": "timeseries"}
    cols = ", ".join(f"max(CASE WHEN kind = '{k}' THEN json END) AS {c}" for c, k in kinds.items())
    full = " AND ".join(f"{c} IS NOT NULL" for c in kinds)
    either = lambda then, default: f"CASE WHEN ok THEN {then} ELSE {default} END"
    return f"""WITH piv AS (SELECT appid, {cols} FROM ({ORACLE['export_artefacts']}) a GROUP BY appid),
j AS (SELECT i.appid, sc, tp, ra, pl, ti, {full} AS ok FROM ({ORACLE['normalise_app_info']}) i LEFT JOIN piv USING (appid))
SELECT appid, {either("cast(json_extract(sc, '$.score') AS int)", K.NEUTRAL_SCORE)} AS recommend_score,
       {either("json_extract_string(sc, '$.suggestion')", q(K.ARTEFACT_READ_FAILED))} AS suggestion,
       {either("cast(json_extract(tp, '$.word_data') AS varchar)", "'[]'")} AS word_data_json,
       {either("cast(json_extract(tp, '$.topic_map') AS varchar)", "'{}'")} AS topic_map_json,
       {either("ra", "'{}'")} AS radar_json, {either("pl", "'{}'")} AS playtime_sentiment_json,
       {either("ti", "'{}'")} AS time_series_json, ok AS from_artefacts
FROM j"""


ORACLE["load_artefacts_positive"] = _load_artefacts_sql("pos_topics")
ORACLE["load_artefacts_negative"] = _load_artefacts_sql("neg_topics")

ORACLE["stored_reviews"] = with_ctes(V_REVIEWS, """replaced AS (
  SELECT DISTINCT appid FROM v_reviews WHERE NOT voted_up AND appid % 2 = 0)""", body="""
SELECT review_id, appid, voted_up, votes_up FROM v_reviews
WHERE appid NOT IN (SELECT appid FROM replaced) OR NOT voted_up""")

ORACLE["union_pulls"] = with_ctes(V_REVIEWS, body="""
SELECT review_id, appid, CASE WHEN voted_up THEN votes_up END AS votes_up,
       CASE WHEN NOT voted_up THEN playtime_at_review END AS playtime_at_review
FROM v_reviews WHERE voted_up IS NOT NULL""")


# ---- bounds that bite, callbacks, stopword files, search by part, streams ----------------------

ORACLE["critical_flaws_custom"] = with_ctes(*REVIEW_TOPICS, flaws_sql("tmap", "negative", FLAW_WORDS), body="SELECT * FROM flaws")
ORACLE["valid_page_prefix_short"] = ORACLE["valid_page_prefix"].replace(f"rk <= {K.MAX_PAGES}", f"rk <= {SHORT_PAGES}")
ORACLE["stream_page_chain"] = ORACLE["valid_page_prefix"]
ORACLE["topic_words_callback"] = ORACLE["topic_words"]
ORACLE["embed_callback"] = f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower({clean_topics_sql('text')}), '\\s+'), lambda x: length(x) > 0)) AS word FROM documents),
n AS (SELECT doc_id, cast('0x' || substr(md5(word), 1, 8) AS bigint) % {CALLBACK_DIMS} AS component, count(*) AS x FROM w GROUP BY ALL),
c AS (SELECT doc_id, unnest(range({CALLBACK_DIMS})) AS component FROM documents)
SELECT doc_id, cast(component AS int) AS component, coalesce(x, 0) AS x FROM c LEFT JOIN n USING (doc_id, component)"""
ORACLE["tokens_stopped"] = with_ctes(STOP_FILE, f"""w AS (SELECT doc_id, unnest({tokens_sql(clean_topics_sql('text'))}) AS word FROM documents)""", body=f"""
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w
WHERE word NOT IN (SELECT word FROM stop) AND NOT list_contains({_str_list(K.DOMAIN_STOPWORDS)}, word) GROUP BY word""")
ORACLE["search_app"] = with_ctes(V_APP_RAW, V_APP_INFO, """terms AS (SELECT DISTINCT unnest([upper(p_name), substr(p_name, 2, 4), substr(p_name, 3, 7), substr(p_name, 1, 1), substr(p_name, 4, 2),
                substr(p_name, 2, 3), substr(p_name, 3, 5) || 'zq', '']) AS term FROM part)""",
                                 """hits AS (SELECT term, appid, name, row_number() OVER (PARTITION BY term ORDER BY length(name), appid) AS rn
         FROM terms JOIN v_app_info ON contains(lower(name), lower(term)) WHERE term <> '')""",
                                 body="SELECT t.term, h.appid, h.name FROM terms t LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING (term)")
ORACLE["stream_refresh"] = f"""WITH r AS (SELECT DISTINCT user_id AS appid, date_trunc('second', ts) AS t FROM events WHERE event_type = 'signup'),
n AS (SELECT *, lead(t) OVER (PARTITION BY appid ORDER BY t) AS later FROM r)
SELECT appid, t AS "at", 'HIT' AS action FROM n
UNION ALL SELECT appid, t + INTERVAL {K.CACHE_HOURS} HOUR, 'FETCH' FROM n WHERE later IS NULL OR later > t + INTERVAL {K.CACHE_HOURS} HOUR"""
ORACLE["stored_review_metrics"] = with_ctes(V_REVIEWS, body="""
SELECT appid, count_if(voted_up = true) AS positive_count, count_if(voted_up = false) AS negative_count,
       count(DISTINCT strftime(ts, '%Y-%m')) AS months, cast(sum(playtime_at_review) AS bigint) AS minutes, count(*) AS n_reviews
FROM v_reviews GROUP BY appid""")
