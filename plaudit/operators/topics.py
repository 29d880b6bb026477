"""Topic description for a given topic assignment.

Topics are computed independently inside each group (e.g. app x polarity),
exactly as one model fit per group would, but for all groups in one job:

* ``topic_info``          sizes, outliers (-1) kept aside, ids re-ranked by size
* ``doc_terms``           per document term counts (tokenise, drop stopwords)
* ``class_tfidf``         tf(w,t)/sum tf(.,t) * ln(1 + A/f(w)) with three groupBys
* ``topic_words``         top-n words per topic (row_number, group-limited)
* ``topic_keywords``      first 7 words joined
* ``representative_docs`` cosine of each doc's weighted term vector to its topic
* ``topic_map``           keywords + summary per topic; ``word_tooltips`` (J3)

All steps are joins and aggregations keyed by (group, topic[, word]); nothing
is collected, and no group is handed to a single Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit import session
from plaudit.constants import (KEYWORD_SEP, NO_SUMMARY, NO_TOPIC_TOOLTIP, PAT_SPLIT, SUMMARY_CUT, SUMMARY_SEP,
                               TOPIC_DOCS_N, TOPIC_KEYWORDS_N, TOPIC_WORDS_N)
from plaudit.functions.text import clean_for_topics, cut_summary, token_rows, tokens
from plaudit.functions.vectors import coded_tokens, computed
from plaudit.session import materialize

OUTLIER = "-1"
# cosines are rounded before ranking so that float summation order cannot
# reorder documents whose similarity is equal
COSINE_DIGITS = 9
#: Ranked documents up to which their texts are picked by id where they are read; rows of a word that a task sums or joins.
PICKED_IDS, TASK_TERMS = 10_000, 1 << 18
#: Rows of words in a stored file. Scans pack files by size and opening cost, under Spark's defaults at most 32 of them to a task.
FILE_TERMS = 1 << 16


def dealt(rows: DataFrame, n: int, on: Sequence[str]) -> DataFrame:
    """``n`` rows dealt over tasks by ``on``, as many to a task whatever the input. The number of tasks is fixed: partitions merged
    by their compressed bytes would hold ever more rows."""
    return rows.repartition(-(-n // TASK_TERMS) or 1, *on)


def store_terms(rows: DataFrame, how: str | None = "table") -> DataFrame:
    """Rows of words, stored to be dealt later. A task that deals rows over more than 200 others holds all it has read, so the files
    are small: a split of few large ones would hold ever more rows."""
    return session.materialize(rows, how, FILE_TERMS)


def topic_info(assign: DataFrame, group_cols: Sequence[str], label_col: str = "topic_label") -> DataFrame:
    """Topic sizes per group; label '-1' stays -1, other labels get ids
    0.. by size (desc), ties by label. Returns group, label, topic_id, size."""
    g = list(group_cols)
    sizes = assign.groupBy(*g, label_col).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("_o", F.col(label_col).cast("string") == OUTLIER)
    w = Window.partitionBy(*g, "_o").orderBy(F.col("size").desc(), F.col(label_col).cast("string"))
    ranked = sizes.withColumn("topic_id", F.when(F.col("_o"), F.lit(-1)).otherwise(F.row_number().over(w) - 1))
    return ranked.drop("_o")


def doc_topics(df: DataFrame, group_cols: Sequence[str], doc_col: str, info: DataFrame, label_col: str = "topic_label") -> DataFrame:
    """Documents with their topic id, without text."""
    g = list(group_cols)
    return df.select(*g, doc_col, label_col).join(info.select(*g, label_col, "topic_id"), [*g, label_col])


def topic_docs(df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str,
               info: DataFrame, label_col: str = "topic_label") -> DataFrame:
    """Documents with their topic id and topic-cleaned text."""
    g = list(group_cols)
    lab = info.select(*g, label_col, "topic_id")
    d = df.select(*g, doc_col, label_col, clean_for_topics(F.col(text_col)).alias("doc_text"))
    return d.join(lab, [*g, label_col], "inner")


def doc_terms(docs: DataFrame, group_cols: Sequence[str], doc_col: str, stopwords: Sequence[str] = (),
              tokenizer: Callable[[Column], Column] | None = None, blank_tokens: bool = False) -> DataFrame:
    """Per document and word: term count ``tf``.

    The built-in tokeniser emits token rows directly; a custom ``tokenizer``
    (Column -> array<string>, e.g. a ``pandas_udf`` segmenter) is exploded.
    Blank tokens never appear unless ``blank_tokens``: then each run of
    blanks between words counts as the pseudo-word " ", as a segmenter that
    keeps blanks would report (it competes in the rankings and is dropped
    after the cut, reproducing 6 keywords / 19 words)."""
    g = list(group_cols)
    keep = [*g, "topic_id", doc_col]
    if blank_tokens:
        runs = F.size(F.split(F.col("doc_text"), PAT_SPLIT)) - 1
        blanks = (docs.select(*keep, F.lit(" ").alias("word"), F.when(F.length("doc_text") > 0, runs)
                              .otherwise(F.lit(0)).cast("bigint").alias("tf")).filter(F.col("tf") > 0))
        return doc_terms(docs, g, doc_col, stopwords, tokenizer).unionByName(blanks)
    if tokenizer is None:
        rows = token_rows(docs, F.col("doc_text"), "word", keep, stopwords)
    else:
        rows = docs.select(*keep, F.explode(tokenizer(F.col("doc_text"))).alias("word"))
        rows = rows.filter(F.length("word") > 0)
        if stopwords:
            rows = rows.filter(~F.col("word").isin(list(stopwords)))
    return rows.groupBy(*keep, "word").agg(F.count(F.lit(1)).alias("tf"))


def counted_words(df: DataFrame, keep: Sequence[str], text_col: str, stopwords: Sequence[str] = (),
                  tokenizer: Callable[[Column], Column] | None = None, by_row: bool = False) -> DataFrame:
    """(keep, word, tf): the words of the topic-cleaned texts, counted batch by batch in the tasks that read them: of each row (``by_row``),
    or of all rows of a batch that are equal in ``keep``. Equal keys of different rows or batches are not summed yet."""
    keep = list(keep)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())])
    stop = pa.array(sorted({"", *stopwords}), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, words = coded_tokens(batch.column("_tokens"))
            wanted = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)
            row, number = row[wanted[number]], number[wanted[number]]
            first = np.arange(len(batch))
            if not by_row and len(batch):
                codes = np.column_stack([batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in keep])
                _, first, group = np.unique(codes, axis=0, return_index=True, return_inverse=True)
                row = group.ravel()[row]
            found, tf = np.unique(row * len(words) + number, return_counts=True)
            group, number = np.divmod(found, max(len(words), 1))
            at = pa.array(first[group])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), words.take(pa.array(number)), pa.array(tf.astype(np.int64))], schema.names)

    clean = computed(df, "_clean", clean_for_topics(F.col(text_col)))  # cleaned once, though the tokeniser reads it in several places
    return clean.select(*keep, (tokenizer or tokens)(F.col("_clean")).alias("_tokens")).mapInArrow(run, schema)


def topic_terms(df: DataFrame, group_cols: Sequence[str], text_col: str, info: DataFrame, label_col: str = "topic_label",
                stopwords: Sequence[str] = (), tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(group, topic_id, word, tf) straight from the texts: counted by label before any shuffle, so neither text nor documents
    travel; the label becomes an id after it. ``class_tfidf`` takes it in place of document terms."""
    g = list(group_cols)
    rows = counted_words(df, [*g, label_col], text_col, stopwords, tokenizer)
    counted = rows.groupBy(*g, label_col, "word").agg(F.sum("tf").alias("tf"))
    return counted.join(info.select(*g, label_col, "topic_id"), [*g, label_col]).select(*g, "topic_id", "word", "tf")


def class_tfidf(terms: DataFrame, group_cols: Sequence[str], n_terms: int | None = None) -> DataFrame:
    """M4: class-based TF-IDF per group. Every topic (including -1) is a class.
    ``n_terms``: the rows of ``terms``, if they are stored; they are then dealt over tasks by word before they are summed.

    weight(w,t) = tf(w,t) / sum_w tf(w,t) * ln(1 + A / f(w)); f = count of w over
    all topics of the group, A = integer mean of tokens per topic in the group.
    Returns group, topic_id, word, tf, weight, idf."""
    g = list(group_cols)
    # stored, as three steps read it; so are the totals, a row a topic: the planner sees their size
    on = [*g, "topic_id", "word"]
    if n_terms is not None:  # no task sums the words of a whole file split
        terms = dealt(terms, n_terms, on)
    tw = store_terms(terms.groupBy(*on).agg(F.sum("tf").alias("tf")))
    # sums over topics and over words fold before their shuffles and are joined back; no window holds a word's or a group's rows
    topic_tot = tw.groupBy(*g, "topic_id").agg(F.sum("tf").alias("topic_tokens"))
    mean = F.floor(F.avg("topic_tokens")).cast("bigint").alias("A")
    topic_tot = (topic_tot.join(topic_tot.groupBy(*g).agg(mean), g) if g
                 else topic_tot.withColumn("A", F.floor(F.avg("topic_tokens").over(Window.partitionBy())).cast("bigint")))
    topic_tot = materialize(topic_tot)
    tw = dealt(tw, tw.count(), [*g, "word"])  # one shuffle for the sums and the join
    f = tw.groupBy(*g, "word").agg(F.sum("tf").alias("f"))
    out = tw.join(f, [*g, "word"]).join(topic_tot, [*g, "topic_id"])
    idf = F.log(F.lit(1.0) + F.col("A") / F.col("f"))
    return out.select(*g, "topic_id", "word", "tf",
                      (F.col("tf") / F.col("topic_tokens") * idf).alias("weight"), idf.alias("idf"))


def topic_words(tfidf: DataFrame, group_cols: Sequence[str], n: int = TOPIC_WORDS_N, n_rows: int | None = None) -> DataFrame:
    """M5 + T9: top-n words per non-outlier topic by weight (ties: word), with
    the integer display value max(int(weight*1000), 1).
    ``n_rows``: the rows of ``tfidf``, if they are stored; they are then dealt over tasks by word before they are ranked."""
    g = list(group_cols)
    w = Window.partitionBy(*g, "topic_id").orderBy(F.col("weight").desc(), F.col("word"))
    rows = tfidf.filter((F.col("topic_id") != -1) & (F.col("weight") > 0)).select(*g, "topic_id", "word", "weight")
    if n_rows is not None:  # no task sorts the words of a whole file split; each passes on n words a topic
        rows = dealt(rows, n_rows, [*g, "topic_id", "word"])
    top = (rows.withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= n)
           .filter(F.length(F.trim("word")) > 0))  # blanks (if kept) drop after the cut
    return top.select(*g, "topic_id", "rank", "word", "weight",
                      F.greatest((F.col("weight") * 1000).cast("int"), F.lit(1)).alias("value"))


def topic_keywords(words: DataFrame, group_cols: Sequence[str], n: int = TOPIC_KEYWORDS_N) -> DataFrame:
    """M6 + T7: first n words of each topic joined with the keyword separator;
    topics without a usable word do not appear."""
    g = list(group_cols)
    kw = (words.filter((F.col("rank") <= n) & (F.length(F.trim("word")) > 0))
          .groupBy(*g, "topic_id")
          .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_kw")))
    return kw.select(*g, "topic_id", F.array_join(F.transform("_kw", lambda s: s["word"]), KEYWORD_SEP)
                     .alias("keywords"))


def representative_docs(docs: DataFrame, terms: DataFrame, tfidf: DataFrame, group_cols: Sequence[str],
                        doc_col: str, n: int = TOPIC_DOCS_N) -> DataFrame:
    """M7: per topic the n documents whose tf*idf vector is closest (cosine) to
    the topic's c-TF-IDF vector; all documents of the topic are ranked.
    ``docs`` needs only (group, topic_id, doc); no text is read here. ``terms`` should be stored, or cheap: they are counted.
    Returns group, topic_id, rank, doc_id, cosine."""
    g = list(group_cols)
    tv = tfidf.filter(F.col("topic_id") != -1)
    tnorm = tv.groupBy(*g, "topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tnorm"))
    # every word of a document of topic t has a TF-IDF row for t (it was counted
    # there), which carries both idf and the topic weight: one join, one aggregation
    dw = F.col("tf") * F.col("idf")
    on = [*g, "topic_id", "word"]
    mine, topic_side = terms.filter(F.col("topic_id") != -1), tv.select(*on, "idf", "weight")
    n_terms = terms.count()
    mine, topic_side = dealt(mine, n_terms, on), dealt(topic_side, n_terms, on)
    per_doc = (mine.join(topic_side, on)
               .groupBy(*g, "topic_id", doc_col)
               .agg(F.sqrt(F.sum(dw * dw)).alias("dnorm"), F.sum(dw * F.col("weight")).alias("dot")))
    cand = (docs.filter(F.col("topic_id") != -1).select(*g, "topic_id", doc_col)
            .join(per_doc, [*g, "topic_id", doc_col], "left")
            .join(tnorm, [*g, "topic_id"], "left"))
    cos = F.when((F.col("dnorm") > 0) & (F.col("tnorm") > 0),
                 F.col("dot") / (F.col("dnorm") * F.col("tnorm"))).otherwise(F.lit(0.0))
    cand = cand.withColumn("cosine", F.bround(F.coalesce(cos, F.lit(0.0)), COSINE_DIGITS))
    w = Window.partitionBy(*g, "topic_id").orderBy(F.col("cosine").desc(), F.col(doc_col))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*g, "topic_id", "rank", doc_col, "cosine"))


def with_doc_text(rep: DataFrame, source: DataFrame, group_cols: Sequence[str], doc_col: str,
                  text_col: str) -> DataFrame:
    """Attach the topic-cleaned text to the few ranked documents only: they are stored first, so that the planner sees their
    size and sends them to the texts, not the texts to them. The texts of few documents are picked by id where they are read."""
    g = list(group_cols)
    rep = materialize(rep)
    src = source.select(*g, doc_col, F.col(text_col).alias("_raw"))
    ids = rep.select(doc_col).distinct().limit(PICKED_IDS + 1).collect()  # bounded
    if len(ids) <= PICKED_IDS:
        src = src.where(F.col(doc_col).isin([r[0] for r in ids if r[0] is not None]))
    return rep.join(src, [*g, doc_col]).withColumn("doc_text", clean_for_topics(F.col("_raw"))).drop("_raw")


def topic_summary(rep: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Quoted, cleaned, cut representative texts joined by ' | '."""
    g = list(group_cols)
    quoted = F.concat(F.lit('"'), cut_summary(clean_for_topics(F.col("doc_text")), SUMMARY_CUT), F.lit('"'))
    s = (rep.groupBy(*g, "topic_id")
         .agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), quoted.alias("q")))).alias("_s")))
    return s.select(*g, "topic_id", F.array_join(F.transform("_s", lambda x: x["q"]), SUMMARY_SEP).alias("summary"))


def topic_map(keywords: DataFrame, summary: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """M8: topics that have keywords, with their summary or the fixed no-summary text."""
    g = list(group_cols)
    j = keywords.join(summary, [*g, "topic_id"], "left")
    return j.select(*g, "topic_id", "keywords", F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary"))


def word_tooltips(words: DataFrame, tmap: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Each cloud word with its topic's keywords and summary; a word whose
    topic is not in the map gets the no-topic text."""
    g = list(group_cols)
    j = words.join(tmap, [*g, "topic_id"], "left")
    tip = F.when(F.col("keywords").isNotNull(),
                 F.concat(F.col("word"), F.lit("\n主题: "), F.col("keywords"), F.lit("\n摘要: "), F.col("summary"))
                 ).otherwise(F.concat(F.col("word"), F.lit(" "), F.lit(NO_TOPIC_TOOLTIP)))
    return j.select(*g, "topic_id", "word", "value", tip.alias("tooltip"))


class TopicChain:
    """The description chain, built lazily: each piece is planned on first use.

    The tables several later steps read, topic sizes, document-term counts, class
    TF-IDF and topic words, are materialised once (``plaudit.session.materialize``); the
    documents themselves are not copied (re-deriving the cleaned text is as
    cheap as re-reading a copy of it)."""

    def __init__(self, df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str,
                 label_col: str = "topic_label", stopwords: Sequence[str] = (),
                 tokenizer: Callable[[Column], Column] | None = None, materialize_as: str | None = "table",
                 blank_tokens: bool = False):
        self.df, self.g, self.doc_col, self.text_col = df, list(group_cols), doc_col, text_col
        self.label_col, self.stopwords, self.tokenizer, self.how = label_col, stopwords, tokenizer, materialize_as
        self.blank_tokens = blank_tokens
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}")()
        return self._built[name]

    def _info(self):
        # a row a topic: stored, so that it is sent to the words and documents, not they to it
        return materialize(topic_info(self.df.select(*self.g, self.label_col), self.g, self.label_col), self.how)

    def _docs(self):
        return topic_docs(self.df, self.g, self.doc_col, self.text_col, self["info"], self.label_col)

    def _doc_topics(self):
        return doc_topics(self.df, self.g, self.doc_col, self["info"], self.label_col)

    def _terms(self):
        if self.blank_tokens:
            return store_terms(doc_terms(self["docs"], self.g, self.doc_col, self.stopwords, self.tokenizer,
                                         self.blank_tokens), self.how)
        # counted per document before the topic id comes in: no text is joined or shuffled
        keep = [*self.g, self.label_col, self.doc_col]
        rows = counted_words(self.df, keep, self.text_col, self.stopwords, self.tokenizer, by_row=True)
        if not self.df.groupBy(*keep).count().where("count > 1").isEmpty():  # documents in several rows
            rows = rows.groupBy(*keep, "word").agg(F.sum("tf").alias("tf"))
        rows = rows.join(self["info"].select(*self.g, self.label_col, "topic_id"), [*self.g, self.label_col])
        return store_terms(rows.select(*self.g, "topic_id", self.doc_col, "word", "tf"), self.how)

    def _tfidf(self):
        if not self.blank_tokens and "terms" not in self._built:  # document terms only where documents are ranked
            terms, n_terms = topic_terms(self.df, self.g, self.text_col, self["info"], self.label_col, self.stopwords, self.tokenizer), None
        else:
            terms = self["terms"]
            n_terms = None if self.how is None else terms.count()
        return store_terms(class_tfidf(terms, self.g, n_terms), self.how)

    def _words(self):
        # n rows a topic: stored, as the map, the tooltips and the exports read them
        tfidf = self["tfidf"]
        return materialize(topic_words(tfidf, self.g, n_rows=None if self.how is None else tfidf.count()), self.how)

    def _keywords(self):
        return topic_keywords(self["words"], self.g)

    def _representative(self):
        terms = self["terms"]  # before the TF-IDF, which then reads them
        return representative_docs(self["doc_topics"], terms, self["tfidf"], self.g, self.doc_col)

    def _summary(self):
        rep = with_doc_text(self["representative"], self.df, self.g, self.doc_col, self.text_col)
        return topic_summary(rep, self.g)

    def _topic_map(self):
        summary = self["summary"]
        return topic_map(self["keywords"], summary, self.g)

    def _tooltips(self):
        tmap = self["topic_map"]
        return word_tooltips(self["words"], tmap, self.g)


def describe_topics(df: DataFrame, group_cols: Sequence[str], doc_col: str, text_col: str,
                    label_col: str = "topic_label", stopwords: Sequence[str] = (),
                    tokenizer: Callable[[Column], Column] | None = None,
                    materialize_as: str | None = "table", blank_tokens: bool = False) -> TopicChain:
    """The whole description chain; index the result by name (info, docs,
    terms, tfidf, words, keywords, representative, summary, topic_map, tooltips)."""
    return TopicChain(df, group_cols, doc_col, text_col, label_col, stopwords, tokenizer, materialize_as,
                      blank_tokens)
