"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote for good (1) or bad (-1) or abstain (0). Expectation-maximisation over the counted
vote patterns of all texts estimates how reliable each rule is; the posterior
probability of quality replaces all-must-pass filtering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import WORD_PATTERN, Kept, once
from plaudit.llm.weak_supervision import VoteModel, fit_votes

#: What is believed of the rules before data: they seldom call a good text bad, and each sees few of the bad ones.
START = ((0.002, 0.1, 0.898), (0.25, 0.1, 0.65))
RULES = ["r_word_length", "r_symbols", "r_symbol_chars", "r_lines", "r_repeats", "r_capitals", "r_vocabulary", "r_exclaims", "r_sentences"]


def with_repeated_words(rows: DataFrame, triples: str, name: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that occur twice or more. ``triples``: the windows' 64-bit hashes, in order.

    (Hash, place) pairs are sorted and neighbours compared, so a window counts exactly if an equal hash exists, whatever
    the text's length. Texts without repeats are not sorted."""
    plain = F.size(F.array_distinct(triples)) == F.size(triples)
    pairs = F.transform(triples, lambda h, i: F.struct(h.alias("hash"), i.cast("long").alias("place")))
    rows = once(rows, __keys=F.when(plain, F.array().cast("array<struct<hash:bigint,place:bigint>>")).otherwise(F.sort_array(pairs)))
    same = lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False))
    stay = F.filter("__keys", lambda x, i: same(x, F.get("__keys", i - 1)) | same(x, F.get("__keys", i + 1)))
    places = F.sort_array(F.transform(stay, lambda x: x["place"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["upto"])).alias("n"), (p + 3).alias("upto"))
    return rows.withColumn(name, F.aggregate(places, zero, add, lambda s: s["n"])).drop("__keys")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules read, for every whole text; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = once(docs.select("doc_id", text.alias("text")), words=F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    w = F.col("words")
    triples = F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    rows = once(rows, triples=triples, lines=lines)
    rows = rows.select(
        "doc_id", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), without("[^#*$%&|<>]+").alias("n_symbols"),
        without("[^A-Z]+").alias("n_capitals"), without("[^!]+").alias("n_exclaims"), without("[^.!?]+").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_kinds"), "lines", "triples")
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    return with_repeated_words(rows, "triples", "n_repeat_words").drop("lines", "triples")


def votes(measured: DataFrame) -> DataFrame:
    """One column per rule of RULES; every rule abstains on a text without words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    def vote(good: Column, bad: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    share = lambda c, of=n: F.col(c) / of
    length, chars = share("word_chars"), F.greatest(F.col("word_chars"), F.lit(1))
    richness = F.log(F.greatest(F.col("n_kinds"), F.lit(1))) / F.log(F.greatest(F.col("n_words"), F.lit(2)))
    rules = {
        "r_word_length": vote(length.between(3, 10), (length < 2) | (length > 15)),
        "r_symbols": vote(share("n_symbols") <= 0.02, share("n_symbols") > 0.1),
        "r_symbol_chars": vote(share("n_symbols", chars) <= 0.01, share("n_symbols", chars) > 0.06),
        "r_lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 2 > F.col("n_lines")),
        "r_repeats": vote(share("n_repeat_words") <= 0.1, share("n_repeat_words") > 0.3),
        "r_capitals": vote(share("n_capitals", chars) <= 0.15, share("n_capitals", chars) > 0.4),
        "r_vocabulary": vote(richness >= 0.75, (F.col("n_words") >= 20) & (richness < 0.6)),
        "r_exclaims": vote(share("n_exclaims") <= 0.05, share("n_exclaims") > 0.3),
        "r_sentences": vote(share("n_stops").between(0.01, 0.4), F.lit(False)),
    }
    return measured.withColumns(rules)


def score_rules(docs: DataFrame, kept: Kept | None = None) -> tuple[DataFrame, VoteModel]:
    """Measures, votes, posterior (0-1), base_failed and kept for every row of ``docs`` (doc_id, text), and the fitted model.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: not base_failed and
    posterior >= 0.5. A null or empty text has no words and fails. Repeated rows are judged (and counted) each; a null
    doc_id stays null; other columns are not read; an empty table gives no rows."""
    kept = kept or Kept(docs.sparkSession, "rules")
    measured = kept.keep(votes(measures(docs)), "measured")
    model = fit_votes(measured.groupBy(*RULES).agg(F.count("*").alias("n")), RULES, start=START)
    odds = model.log_odds([F.col(r) for r in RULES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)), model
