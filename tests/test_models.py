"""Plug-in scorers, embedding and topic discovery."""

from pyspark.sql import functions as F

from plaudit import constants as K
from plaudit.operators import aspects as A
from plaudit.operators.clusters import discover_topics
from plaudit.operators.embed import embed


def _reviews(spark):
    return spark.createDataFrame([(1, 1, "great fun <b>x</b>"), (2, 1, "bad"), (3, 1, None)],
                                 "review_id long, appid int, content string")


def test_neutral_scores(spark):
    r = A.neutral_scores(_reviews(spark)).first()
    assert [r[c] for c in K.SCORE_COLUMNS] == [0.5] * 5


def test_model_scores_plugin(spark):
    def factory():
        def score(texts):
            return [{c: (0.9 if "fun" in t else 0.1) for c in K.SCORE_COLUMNS} for t in texts]
        return score

    got = {r.review_id: r.score_gameplay for r in A.model_scores(_reviews(spark), factory).collect()}
    assert got == {1: 0.9, 2: 0.1, 3: 0.1}


def test_model_scores_failure_is_neutral(spark):
    def factory():
        def score(texts):
            raise RuntimeError("model crashed")
        return score

    def broken_factory():
        raise RuntimeError("weights missing")

    for f in (factory, broken_factory, None):
        rows = A.model_scores(_reviews(spark), f).collect()
        assert all(r[c] == 0.5 for r in rows for c in K.SCORE_COLUMNS)


def test_prototype_scores(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    protos = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.0], [0.0, 0.0]]
    got = {r.review_id: r for r in A.prototype_scores(_reviews(spark), vecs, protos).collect()}
    assert (got[1].score_gameplay, got[1].score_visuals, got[1].score_opt) == (1.0, 0.5, 0.0)
    assert got[1].score_story == round((1 + 2 ** -0.5) / 2, 6)
    assert got[1].score_value == 0.5 and got[3].score_gameplay == 0.5


def test_embed_unit_norm(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in embed(df, "doc_id", "text", dims=64).collect()}
    assert abs(sum(x * x for x in got[1]) - 1.0) < 1e-5 and len(got[1]) == 64
    assert sum(abs(x) for x in got[3]) == 0.0


def test_planted_clusters(spark):
    base = ["the quick brown fox jumps over the lazy dog near the river bank today",
            "a completely different sentence about spaceships flying to distant planets soon",
            "cooking pasta requires boiling water salt and a good amount of patience always"]
    rows, i = [], 0
    for group, n in zip(base, (6, 5, 4)):
        for k in range(n):
            rows.append((i, group + (" extra" if k % 2 else "")))
            i += 1
    # digits vanish in topic cleaning, so the noise texts differ in words
    noise = ["violet harbor lanterns drift", "copper meadow whistles loudly", "silent glacier maps wander",
             "amber thunder bakes pretzels", "hollow canyon sings backwards"]
    rows += [(100 + j, t) for j, t in enumerate(noise)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1))
    got = {r.doc_id: r.topic_id for r in discover_topics(df, ["g"], "doc_id", "text").collect()}
    assert {got[d] for d in range(0, 6)} == {0}
    assert {got[d] for d in range(6, 11)} == {1}
    assert {got[d] for d in range(11, 15)} == {-1}
    assert all(got[100 + j] == -1 for j in range(5))


def test_topic_chain_blank_tokens_flag(spark):
    from plaudit.operators.topics import describe_topics
    texts = ["a b c d e f g h i", "b c d e f g h i j", "c d e f g h i j k", "alpha beta gamma delta epsilon"]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, topic_label string, text string") \
        .withColumn("g", F.lit(1))
    # two labels so the blank pseudo-word has a finite idf and competes in the ranking
    df = df.withColumn("topic_label", F.when(F.col("doc_id") < 3, "x").otherwise("y"))
    plain = describe_topics(df, ["g"], "doc_id", "text")
    blank = describe_topics(df, ["g"], "doc_id", "text", blank_tokens=True)
    kw_plain = {r.topic_id: r.keywords.split("、") for r in plain["keywords"].collect()}
    kw_blank = {r.topic_id: r.keywords.split("、") for r in blank["keywords"].collect()}
    assert len(kw_plain[0]) == 7
    assert len(kw_blank[0]) == 6 and " " not in kw_blank[0]
    assert blank["words"].filter("trim(word) = ''").count() == 0


def test_connected_components_match_union_find(spark):
    from conftest import SF_SMALL
    from plaudit.operators.clusters import band_edges, connected_components
    from plaudit.sources.standins import table

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    edges = band_edges(docs, ["lang"], "doc_id", "text")
    got = {(r.lang, r.doc_id): r.label for r in connected_components(edges, ["lang"], "doc_id").collect()}
    # brute force on the same (small) edge list
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in edges.collect():
        a, b = find(("doc", r.lang, r.doc_id)), find(("bucket", r.lang, r.bucket))
        if a != b:
            parent[a] = b
    comp = {}
    for (lang, doc) in got:
        comp.setdefault(find(("doc", lang, doc)), []).append((lang, doc))
    want = {m: min(d for _, d in members) for members in comp.values() for m in members}
    assert got == want
    assert sum(1 for members in comp.values() if len(members) > 1) >= 1


def test_buckets_of_one_document_take_no_part_in_the_rounds(spark, monkeypatch):
    """Only edges of shared buckets are stored for the rounds; documents alone get their own label."""
    from plaudit.operators import clusters
    kept = []

    def spy(df):
        out = materialize(df)
        if "bucket" in out.columns:
            kept.append(out.count())
        return out

    from plaudit.session import materialize
    monkeypatch.setattr(clusters, "materialize", spy)
    edges = [("x", d, 1000 + 10 * d + b) for d in range(50) for b in range(8)] + [("x", 3, 7), ("x", 9, 7), ("x", 9, 8), ("x", 20, 8), ("y", 3, 7), (None, 1, 7)]
    out = clusters.connected_components(spark.createDataFrame(edges, "grp string, doc long, bucket long"), ["grp"], "doc").collect()
    assert {(r.grp, r.doc): r.label for r in out} == {**{("x", d): 3 if d in (3, 9, 20) else d for d in range(50)}, ("y", 3): 3} and len(out) == 51
    assert kept == [405, 4]
