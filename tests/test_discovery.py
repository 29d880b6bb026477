"""Topic discovery from text: low-rank vectors, density clusters, assignment of unseen texts, scores from text."""

import collections
import itertools
import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit import constants as K
from plaudit.functions.vectors import bucket, walsh_coordinates, with_term_counts
from plaudit.operators import aspects as A
from plaudit.operators.assign import assign_topics
from plaudit.operators.clusters import discover_topics
from plaudit.operators.density import connect, density_clusters
from plaudit.operators.lowrank import low_rank_embedding, project, singular_vectors, tfidf_rows
from plaudit.operators.topics import describe_topics

BITS = 10


def bucket_of(word, bits=BITS):
    return int(md5(word.encode()).hexdigest()[:8], 16) % (1 << bits)


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = words(rng, 60)
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(50)] + ["", None, "123 !!", "a", "a a a a"]


def dense_rows(texts, bits=BITS):
    counts = [collections.Counter(bucket_of(w, bits) for w in (t or "").lower().split() if w.isalpha()) for t in texts]
    n = sum(bool(c) for c in counts)
    df = collections.Counter(b for c in counts for b in c)
    out = np.zeros((len(texts), 1 << bits))
    for i, c in enumerate(counts):
        for b, tf in c.items():
            out[i, b] = tf * (math.log((1 + n) / (1 + df[b])) + 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["x"])], "id int, w array<string>")
    got = {r.id: [(t.bucket, t.tf) for t in r.vector] for r in with_term_counts(df, F.col("w")).collect()}
    assert got == {1: sorted([(bucket_of("b", 16), 3), (bucket_of("a", 16), 1)]), 2: [], 3: [(bucket_of("x", 16), 1)]}
    assert spark.range(1).select(bucket(F.lit("ünïcode"))).first()[0] == bucket_of("ünïcode", 16)


def test_tfidf_rows_and_svd_equal_numpy(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dense_rows(texts)
    rows = tfidf_rows(df, ["doc_id"], "text", BITS)
    for r in rows.collect():
        row = np.zeros(1 << BITS)
        row[r.buckets] = r.weights
        assert np.allclose(row, want[r.doc_id]), r.doc_id
    v, s = singular_vectors(rows, 4, BITS, passes=8)
    _, values, vt = np.linalg.svd(want, full_matrices=False)
    assert np.allclose(s, values[:4], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(v * vt[:4].T, axis=0)), 1, atol=1e-2)  # the same directions, up to sign
    got = {r.doc_id: r.embedding for r in project(rows, v, ["doc_id"]).collect()}
    assert all(np.allclose(got[i], want[i] @ v) for i in range(len(texts)))
    assert low_rank_embedding(df.limit(0), ["doc_id"], "text", 3, BITS).count() == 0


def brute_clusters(points, eps, least, min_size, steps=8):
    """{id: topic} by comparing all pairs of lattice points."""
    at = {i: tuple(math.floor(x * (steps / eps) + 0.5) for x in p) for i, p in points.items() if p is not None and all(math.isfinite(x) for x in p)}
    near = {i: [j for j in at if sum((a - b) ** 2 for a, b in zip(at[i], at[j])) <= steps * steps] for i in at}
    core = {i for i in at if len(near[i]) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(label[j] for j in near[i] if j in core)
            if low < label[i]:
                label[i], changed = low, True
    for i in at:
        if i not in core:
            around = [(sum((a - b) ** 2 for a, b in zip(at[i], at[j])), label[j]) for j in near[i] if j in core]
            if around:
                label[i] = min(around)[1]
    sizes = collections.Counter(label.values())
    order = [c for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])) if n >= min_size]
    return {i: order.index(label[i]) if i in label and label[i] in order else -1 for i in points}


@pytest.mark.parametrize("dims,eps,least", [(2, 0.3, 5), (3, 0.35, 4), (1, 0.05, 3)])
def test_density_equals_brute_force(spark, dims, eps, least):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims))
    points = {i: (centres[i % 6] + rng.normal(scale=0.12, size=dims)).tolist() for i in range(300)}
    points |= {300 + i: rng.uniform(-3, 3, dims).tolist() for i in range(60)}
    points |= {400 + i: points[7] for i in range(40)} | {500: None, 501: [float("nan")] * dims, 502: [float("inf")] * dims}
    df = spark.createDataFrame(list(points.items()), "id long, v array<double>")
    got = {r.id: r.topic_id for r in density_clusters(df, "id", "v", dims, eps, least, min_size=6).collect()}
    want = brute_clusters(points, eps, least, 6)
    assert got == want and len(set(want.values())) > 2
    assert density_clusters(df.limit(0), "id", "v", dims, eps, least).count() == 0


def test_planted_clusters_of_unlike_size_and_a_thin_bridge(spark):
    """Clusters of 400, 60 and 12 points are found; a row of single points between two of them joins nothing."""
    rng = np.random.default_rng(0)
    points = [(c * 1000 + i, "g", (np.array(centre) + rng.normal(scale=0.02, size=3)).tolist()) for c, (centre, n) in enumerate([((0, 0, 0), 400), ((1, 0, 0), 60), ((0, 1, 0), 12)]) for i in range(n)]
    points += [(9000 + i, "g", [float(x), 0.0, 0.0]) for i, x in enumerate(np.arange(0.15, 0.86, 0.07))] + [(9500, "g", [5.0, 5.0, 5.0])]
    points += [(i, None, p) for i, _, p in points[:50]]  # another group, without a name
    df = spark.createDataFrame(points, "id long, grp string, v array<double>")
    out = density_clusters(df, "id", "v", 3, 0.1, 8, ["grp"], min_size=10).collect()
    got = {(r.grp, r.id): r.topic_id for r in out}
    assert len(got) == len(points)
    for c, n in enumerate((400, 60, 12)):
        assert sum(got["g", c * 1000 + i] == c for i in range(n)) >= 0.95 * n
    assert got["g", 9500] == -1 and sum(got["g", 9000 + i] == -1 for i in range(11)) >= 7
    assert sum(got[None, i] == 0 for i in range(50)) >= 45


def test_connect_follows_long_chains(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 700), (700, 600)]
    edges = spark.createDataFrame([("x", a, b) for a, b in pairs] + [("x", b, a) for a, b in pairs], "grp string, a long, b long")
    nodes = edges.select("grp", F.col("a").alias("node")).distinct().unionByName(spark.createDataFrame([("x", 999)], "grp string, node long"))
    got = {r.node: r.label for r in connect(edges, nodes, ["grp"]).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 600: 500, 700: 500, 999: 999}


def test_discovered_topics_are_the_planted_ones(spark):
    rng = random.Random(4)
    themes = [words(rng, 12, letters) for letters in ("abcd", "efgh", "ijkl")]
    rows = [(t * 100 + i, "x", " ".join(rng.choice(themes[t]) for _ in range(40))) for t, n in enumerate((60, 25, 12)) for i in range(n)]
    rows += [(900, "x", ""), (901, "x", None)]
    got = {r.doc_id: r.topic_id for r in discover_topics(spark.createDataFrame(rows, "doc_id long, grp string, text string"), ["grp"], "doc_id", "text", eps=0.3).collect()}
    for t, n in enumerate((60, 25, 12)):
        assert collections.Counter(got[t * 100 + i] for i in range(n)).most_common(1)[0][1] >= 0.9 * n
    assert len({collections.Counter(got[t * 100 + i] for i in range(n)).most_common(1)[0][0] for t, n in enumerate((60, 25, 12))} - {-1}) == 3
    assert got[900] == got[901] == -1


def test_assignment_equals_brute_force(spark):
    rng = random.Random(5)
    themes = [words(rng, 8, letters) for letters in ("abcd", "cdef", "efgh")]
    rows = [(i, " ".join(rng.choice(themes[i % 3]) for _ in range(15)), str(i % 3)) for i in range(30)]
    chain = describe_topics(spark.createDataFrame(rows, "doc_id long, text string, topic_label string"), [], "doc_id", "text", "topic_label")
    model = [r.asDict() for r in chain["tfidf"].collect()]
    new = [(100 + i, " ".join(rng.choice(themes[rng.randrange(3)] + ["unseenword"]) for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(200, ""), (201, None), (202, "unknownword")]
    got = {r.doc_id: (r.topic_id, r.cosine) for r in assign_topics(spark.createDataFrame(new, "doc_id long, text string"), chain["tfidf"], [], "doc_id", "text", 0.4).collect()}
    idf = {m["word"]: m["idf"] for m in model}
    weight = {(m["topic_id"], m["word"]): m["weight"] for m in model}
    norm = {t: math.sqrt(sum(w * w for (x, _), w in weight.items() if x == t)) for t in range(3)}
    for doc, text in new:
        tf = collections.Counter(w for w in (text or "").split() if w in idf)
        own = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
        cosines = {t: sum(n * idf[w] * weight.get((t, w), 0.0) for w, n in tf.items()) / (own * norm[t]) for t in range(3)} if own else {}
        best = max(cosines, key=lambda t: (round(cosines[t], 9), -t)) if cosines else -1
        cosine = cosines.get(best, 0.0)
        assert got[doc] == (best if cosine >= 0.4 else -1, pytest.approx(cosine, abs=1e-8)), (doc, text)
    assert {t for t, _ in got.values()} == {-1, 0, 1, 2}


def test_text_scores_equal_brute_force(spark, texts):
    said = ["aa bb", " ".join(str(t) for t in texts[:2]), texts[5], "zzz", texts[3]]
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "review_id long, appid int, content string").withColumn("score_opt", F.lit("clash"))
    got = {r.review_id: [r[c] for c in K.SCORE_COLUMNS] for r in A.text_scores(df, said, bits=BITS).collect()}
    counts = lambda t: collections.Counter(bucket_of(w) for w in (t or "").lower()[:512].split() if w.isalpha())
    rows = [counts(t) for t in texts]
    n, freq = sum(bool(c) for c in rows), collections.Counter(b for c in rows for b in c)
    weigh = lambda c: {b: tf * (math.log((1 + n) / (1 + freq[b])) + 1) for b, tf in c.items() if b in freq}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, c in enumerate(rows):
        v = weigh(c)
        for k, h in enumerate(map(weigh, map(counts, said))):
            want = (1 + sum(x * h.get(b, 0) for b, x in v.items()) / (length(v) * length(h))) / 2 if v and h else 0.5
            assert got[i][k] == pytest.approx(want, abs=1e-6), (i, k)
    assert A.text_scores(df.limit(0), said).count() == 0


def test_walsh_coordinates_keep_distances(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 16))
    df = spark.createDataFrame([(0, x.tolist()), (1, y.tolist())], "id int, v array<double>")
    a, b = (np.array(r.w) for r in df.select(walsh_coordinates(F.col("v"), 3).alias("w")).collect())
    signs = [[(-1) ** ((i >> k) & 1) for i in range(16)] for k in range(3)]
    assert np.allclose(a, [np.dot(s, x) / 4 for s in signs]) and np.linalg.norm(a - b) <= np.linalg.norm(x - y) + 1e-9
    assert list(itertools.chain(a.shape)) == [3]


@pytest.mark.parametrize("places", [0, 1 << 22])
def test_neighbours_equal_brute_force(monkeypatch, places):
    """Compared with each other, and looked up in an array of the block; a dense block costs a ball a point, no pair list."""
    from plaudit.operators import density
    monkeypatch.setattr(density, "PLACES", places)
    rng = np.random.default_rng(7)
    for dims, size in ((1, 40), (2, 30), (3, 12)):
        b = np.unique(rng.integers(-8, size, (900, dims)), axis=0)
        a = b[rng.random(len(b)) < 0.5]
        d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        want = {(i, j, int(d2[i, j])) for i, j in zip(*np.nonzero(d2 <= 25))}
        got = [tuple(map(int, x)) for part in density.neighbours(a, b, 5) for x in zip(*part)]
        assert set(got) == want and len(got) == len(want)


def test_density_plans_join_no_points_with_points(spark):
    """A dense place of n points made n * n joined rows; now blocks go to tasks and no join stands on cells."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(scale=0.02, size=3).tolist()) for i in range(3000)], "id long, v array<double>")
    out = density_clusters(df, "id", "v", 3, 0.1, 5)
    assert "_cell" not in out._jdf.queryExecution().toString()
    assert {r.topic_id for r in out.collect()} <= {0, -1}
    from plaudit.operators import density
    assert not hasattr(density, "_near")


def test_hashed_rows_shuffle_no_terms(spark):
    """Words are counted and weighed where the text is read: no exchange in the rows' plan (before: two of all terms)."""
    from plaudit.functions.vectors import bucket_counts
    df = spark.createDataFrame([(1, "Aa bb aa"), (1, "bb"), (None, "cc dd"), (4, ""), (5, None), (6, "<b>")], "id long, text string")
    rows = tfidf_rows(df, ["id"], "text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted(rows.collect(), key=lambda r: -len(r.buckets))
    assert [len(r.buckets) for r in got] == [2, 2, 1, 0, 0, 0] and all(sum(w * w for w in r.weights) == pytest.approx(1) for r in got[:3])
    words_of = df.select("id", F.array(F.lit("x"), F.lit("y"), F.lit("x")).alias("w"))
    plain = [[(t.bucket, t.tf) for t in r.vector] for r in with_term_counts(words_of, F.col("w")).collect()]
    assert [list(zip(r.buckets, r.times)) for r in bucket_counts(words_of, ["id"], F.col("w")).collect()] == plain
