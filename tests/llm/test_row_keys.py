"""Rows that share an id or lack one, texts without letters, very long texts and very many matches."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from plaudit.llm import cube_mix, langid_kn, ngram_join, pii_weak, quality_mil, suffix_dedup
from plaudit.llm.common import Kept


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_suffix_dedup_of_many_null_ids(spark):
    """2,000 rows without an id lose what the same texts lose under ids in the order of their hash, and no span leaves its text."""
    rng = random.Random(11)
    shared = [prose(rng, 30) for _ in range(40)]
    texts = [prose(rng, 12) + rng.choice(shared) + prose(rng, rng.randint(3, 12)) for _ in range(2000)]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts[:300]] + [(7, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    hashed = df.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("x")).collect()
    order = sorted(range(len(hashed)), key=lambda i: (hashed[i].doc_id is not None, hashed[i].doc_id or 0, hashed[i].x))
    plain = spark.createDataFrame([(n, hashed[i].text) for n, i in enumerate(order)], "doc_id long, text string")
    result = lambda d: sorted((r.n_bytes, r.n_removed, r.kept_sha256, tuple(r.spans)) for r in suffix_dedup.repeated_spans(d).collect())
    got = result(df)
    assert got == result(plain)
    assert sum(r[1] > 0 for r in got) > 1500 and all(s.end <= r[0] for r in got for s in r[3])


def test_suffix_dedup_of_a_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    passage = prose(rng, 40)
    text = prose(rng, 900) + passage + prose(rng, 700) + passage + prose(rng, 500)
    whole = [(b.size, b.tolist()) for b in suffix_dedup.blocks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 100, 32)[3:]]
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 333)
    data = np.frombuffer(text.encode(), np.uint8)
    starts, windows = [], []
    for begin, part, offs in suffix_dedup.parts(data, np.array([0, len(data)]), 100):
        found = suffix_dedup.blocks(part, offs, 100, 32)
        starts += (begin + found[3]).tolist()
        windows += found[4].tolist()
    # parts cover every window once, in order
    assert starts == np.concatenate([[0], np.cumsum(windows)[:-1]]).tolist() and sum(windows) == len(text) - 99
    assert len(starts) > whole[0][0]


def test_letterless_texts_are_und(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 30), "en") for i in range(40)] + [(i, " ".join("".join(rng.choice("äöüßwxyz") for _ in range(5)) for _ in range(30)), "de") for i in range(40, 80)]
    odd = ["❤️ 123 ❤️", "1️⃣ 2️⃣", "123 !!", "́̀", "", None]
    df = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid_kn.identify_languages(df.withColumn("held_out", F.lit("clash"))).collect()}
    assert all(got[100 + i] == ("und", 0.0) for i in range(len(odd)))
    assert sum(got[i][0] == lang for i, _, lang in rows) >= 78
    assert langid_kn.identify_languages(df.limit(0)).count() == 0


def test_quality_learns_one_row_of_a_shared_id(spark, monkeypatch):
    """An id on a third of all rows is one training text; long texts count with all their passages."""
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice([60, 200, 3000])), 1) for i in range(40)] + [(i, "$$$ ### " * rng.randint(20, 2000), 0) for i in range(40, 80)]
    rows += [(3, prose(rng, 50), 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:80]], "doc_id long, quality int")
    seen, real = [], quality_mil.train
    monkeypatch.setattr(quality_mil, "train", lambda x, at, *a: seen.append(np.diff(at)) or real(x, at, *a))
    whole = quality_mil.fit(df.select("doc_id", "text"), labels)
    assert len(seen[0]) < 80 and seen[0].max() > 30
    monkeypatch.setattr(quality_mil, "STEP_PASSAGES", 100)
    parts = quality_mil.fit(df.select("doc_id", "text"), labels)
    assert np.allclose(whole.c, parts.c, atol=1e-2)


def test_keep_good_takes_effect(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 100), "s", 1) for i in range(60)] + [(i, "$$$ ### 123 " * 40, "s", 0) for i in range(60, 120)] + [(None, prose(rng, 100), None, 1), (None, "$$$ ### 123 " * 40, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, good int").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = quality_mil.keep_good(df, labels)
    assert got.columns == df.columns
    scores = {(r.doc_id, i): r.score for i, r in enumerate(quality_mil.score_quality(df, labels).orderBy("doc_id").collect())}
    assert got.count() == sum(s >= 0.5 for s in scores.values())
    kept = got.collect()
    assert sum(r.good for r in kept) >= 58 and sum(1 - r.good for r in kept) <= 3
    assert quality_mil.keep_good(df.limit(0), labels).count() == 0
    assert quality_mil.keep_good(df, labels.limit(0)).count() == len(rows)  # no model: every score is 0.5


def test_equal_rows_are_dealt_over_blocks(spark):
    """Many rows without an id and of one size meet their target, and no block is over its size."""
    rows = [(None, "a b c", "s")] * 6000 + [(i, "w " * (i % 9 + 1), "t") for i in range(500)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = cube_mix.cube_mix(df, ratio=1.3, weights=(1,), block_rows=256, kept=(kept := Kept(spark, "mix")))
    got = dealt.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.count("*").alias("rows")).collect()
    assert {r.source: r.rows for r in got} == {"s": 6000, "t": 500, None: 1}
    assert all(abs(r.taken - r.target) <= 20 for r in got if r.source)
    places = spark.read.parquet(kept.paths["flight0"]).where("source = 's'").agg(F.count_distinct("place")).first()[0]
    assert places == 6000  # rows are dealt by this hash: equal ones no longer share it


def test_many_matches_take_linear_time(spark):
    def took(n):
        text = " ".join(f"host 10.0.{i % 250}.{i % 199} mail u{i}@x.com" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.perf_counter()
        row = pii_weak.find_personal_data(df, Kept(spark, "pii")).first()
        assert (row.n_email, row.n_ip) == (n, n)
        red = pii_weak.redact(df).first().text
        assert red == re.sub(r"u\d+@x\.com", "[EMAIL]", re.sub(r"10\.0\.\d+\.\d+", "[IP]", text))
        return time.perf_counter() - t
    took(50)
    small, large = took(4000), took(16000)
    assert large < 8 * small + 5, (small, large)


def test_links_of_a_family_stay_in_proportion(spark, monkeypatch):
    """Of all links between components of one leader's members only a spanning forest is sent on."""
    a, b = ngram_join.forest(np.array([1, 2, 1, 3, 5, 5]), np.array([2, 3, 3, 1, 6, 6]))
    assert list(zip(a, b)) == [(1, 2), (2, 3), (5, 6)]
    seen, real = [], ngram_join._across

    def spy(members, percent):
        out = real(members, percent)
        seen.append((out.count(), members.select("leader", "sig").distinct().count()))
        return out

    monkeypatch.setattr(ngram_join, "_across", spy)
    rng = random.Random(16)
    base = [f"w{i}" for i in range(100)]
    for n in (200,):
        texts = []
        for _ in range(n):
            words = list(base)
            for place in rng.sample(range(5, 100, 10), rng.randint(0, 6)):
                words[place] = f"x{rng.randrange(12)}"
            texts.append(" ".join(words))
        ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).count()
    assert seen[0][0] > 0 and all(links < members for links, members in seen), seen
