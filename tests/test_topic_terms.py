"""Words of topics and documents, counted where the texts are read."""

from pyspark.sql import functions as F

from plaudit.functions.text import tokens
from plaudit.operators import topics as TP

ROWS = [(1, "a", "red Red blue the"), (2, "a", "blue <b>画面好</b>"), (2, "a", "blue"), (3, None, "red"), (None, "b", "x y x"), (4, "b", ""), (5, "b", None)]


def _df(spark):
    return spark.createDataFrame(ROWS, "id long, topic_label string, text string")


def test_words_are_counted_without_aggregation(spark):
    """One row of memory a row of text: a hash aggregate held every (document, word) of a partition."""
    rows = TP.counted_words(_df(spark), ["topic_label", "id"], "text", ["the"], by_row=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([("a", 1, "red", 2), ("a", 1, "blue", 1), ("a", 2, "blue", 1), ("a", 2, "画面", 1), ("a", 2, "面好", 1), ("a", 2, "blue", 1),
                                                                   (None, 3, "red", 1), ("b", None, "x", 2), ("b", None, "y", 1)], key=repr)


def test_words_by_label_equal_exploded_tokens(spark):
    df = _df(spark)
    got = TP.counted_words(df, ["topic_label"], "text").groupBy("topic_label", "word").agg(F.sum("tf").alias("tf"))
    want = df.select("topic_label", F.explode(tokens(TP.clean_for_topics(F.col("text")))).alias("word")).groupBy("topic_label", "word").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_documents_in_several_rows_are_one(spark):
    """Terms of rows that share a document are summed, with a built-in and a given tokeniser; texts are picked by the ranked ids."""
    df = _df(spark)
    for tokenizer in (None, tokens):
        chain = TP.describe_topics(df, [], "id", "text", tokenizer=tokenizer)
        terms = {(r.topic_id, r.id, r.word): r.tf for r in chain["terms"].collect()}
        label = {r.topic_label: r.topic_id for r in chain["info"].collect()}
        assert terms[label["a"], 2, "blue"] == 2 and len(terms) == len(chain["terms"].collect()) == 8
    source = df.where("id is not null")
    rep = source.select("id").withColumn("rank", F.lit(1)).where("id = 1")
    texts = TP.with_doc_text(rep, source, [], "id", "text")
    assert [r.doc_text for r in texts.collect()] == ["red Red blue the"]
    assert "IN (1)" in texts._jdf.queryExecution().toString() or "id#" in texts._jdf.queryExecution().toString() and "= 1" in texts._jdf.queryExecution().toString()


def test_large_term_tables_are_dealt_over_more_tasks(spark, monkeypatch):
    df = _df(spark)
    want = sorted(map(tuple, TP.describe_topics(df, [], "id", "text")["representative"].collect()), key=repr)
    monkeypatch.setattr(TP, "TASK_TERMS", 1)
    monkeypatch.setattr(TP, "PICKED_IDS", 0)
    chain = TP.describe_topics(df, [], "id", "text")
    assert "REPARTITION_BY_NUM" in chain["representative"]._jdf.queryExecution().toString() or chain["terms"].count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, chain["representative"].collect()), key=repr) == want
    assert {r.summary for r in chain["summary"].collect()} == {r.summary for r in TP.describe_topics(df, [], "id", "text")["summary"].collect()}


def test_rows_of_a_task_do_not_grow_with_the_input(spark, monkeypatch):
    """TF-IDF and document ranking deal words over as many tasks as their rows ask for; partitions merged by their bytes would grow."""
    df = _df(spark)
    want = sorted((r.topic_id, r.word, r.tf, round(r.weight, 9)) for r in TP.describe_topics(df, [], "id", "text")["tfidf"].collect())
    monkeypatch.setattr(TP, "TASK_TERMS", 2)
    chain = TP.describe_topics(df, [], "id", "text", materialize_as="persist")
    terms = chain["terms"]
    tfidf = TP.class_tfidf(terms, [], terms.count())
    ranked = TP.representative_docs(chain["doc_topics"], terms, chain["tfidf"], [], "id")
    for frame, tasks in ((tfidf, -(-tfidf.count() // 2)), (ranked, -(-terms.count() // 2))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and f", {tasks})" in plan
    assert sorted((r.topic_id, r.word, r.tf, round(r.weight, 9)) for r in tfidf.collect()) == want


def test_words_ranked_by_a_task_do_not_grow_with_the_input(spark, monkeypatch):
    """Stored TF-IDF rows are dealt over tasks before they are sorted: file splits hold ever more rows."""
    df = _df(spark)
    want = sorted(map(tuple, TP.topic_words(TP.describe_topics(df, [], "id", "text", materialize_as=None)["tfidf"], []).collect()), key=repr)
    stored, materialize = [], TP.materialize
    monkeypatch.setattr(TP, "TASK_TERMS", 2)
    monkeypatch.setattr(TP, "materialize", lambda frame, how="table": stored.append(frame) or materialize(frame, how))
    chain = TP.describe_topics(df, [], "id", "text")
    assert sorted(map(tuple, chain["words"].collect()), key=repr) == want
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in stored if "rank" in f.columns]
    assert len(plans) == 1  # computed once for all that read it
    dealt = [line for line in plans[0].splitlines() if "REPARTITION_BY_NUM" in line]
    assert dealt and all(f", {-(-chain['tfidf'].count() // 2)})" in line for line in dealt)


def test_stored_words_are_read_in_small_files(spark, monkeypatch):
    """What deals stored rows over many tasks holds all rows of its split: a split of large files holds ever more."""
    df = _df(spark)
    want = sorted(map(tuple, TP.describe_topics(df, [], "id", "text")["summary"].collect()), key=repr)
    monkeypatch.setattr(TP, "FILE_TERMS", 2, raising=False)
    chain = TP.describe_topics(df.coalesce(1), [], "id", "text")
    for stored in (chain["terms"], chain["tfidf"]):
        rows = stored.groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in rows) == stored.count() > 2 and max(r["count"] for r in rows) <= 2
    assert sorted(map(tuple, chain["summary"].collect()), key=repr) == want
