"""Lookup by part of a name (A5) and segmentation without blanks (T5)."""

import collections
import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from plaudit.operators import segment as SG
from plaudit.sources.search import build_index, probes, search_apps


def test_search_equals_plain_contains(spark):
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcde İß字") for _ in range(rng.randint(0, 5))) for _ in range(80)]
    apps = [(i, rng.choice([" ".join(rng.sample(parts, 2)), rng.choice(parts).upper(), None])) for i in range(300)]
    terms = [rng.choice(parts) for _ in range(60)] + [(a[1] or "x")[1:7] for a in apps[:80]] + ["", None, "zz", "abcdeabcde", "A", "字", "bcd"]
    df = spark.createDataFrame(apps, "appid int, name string")
    index = build_index(df)
    asked = spark.createDataFrame([(t,) for t in terms + terms[:10]], "term string")
    got = {r.term: (r.appid, r.name) for r in search_apps(asked, index).collect()}
    plain = asked.distinct().where("term <> ''").join(df, F.contains(F.lower("name"), F.lower("term"))).groupBy("term").agg(F.min(F.struct(F.length("name").alias("n"), "appid", "name")).alias("f"))
    want = dict.fromkeys(terms, (None, None)) | {r.term: (r.f.appid, r.f.name) for r in plain.collect()}
    assert got == want and sum(a is not None for a, _ in want.values()) > 40


def test_candidates_grow_with_the_terms_not_with_the_names(spark):
    """Names that are equal are one, and a term probes its rarest gram only."""
    def candidates(n):
        apps = spark.createDataFrame([(i, f"{('red', 'hot', 'big')[i % 3]} widget {'' if i % 5 else f'model{i % 40}'}") for i in range(n)], "appid int, name string")
        terms = spark.createDataFrame([(f"get model{i}",) for i in range(40)] + [("d widget",)], "term string")
        return probes(terms, build_index(apps)).agg(F.sum("n_names")).first()[0]
    assert candidates(6000) == candidates(1200)


def all_segmentations(text, most):
    if not text:
        yield []
    for i in range(1, min(most, len(text)) + 1):
        for rest in all_segmentations(text[i:], most):
            yield [text[:i], *rest]


def test_paths_and_expected_counts_equal_enumeration():
    rng = random.Random(2)
    words = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)}
    lexicon = SG.log_lexicon({w: rng.uniform(0.1, 3) for w in words if len(w) == 1 or rng.random() < 0.7})
    floor = SG.unknown(lexicon)
    for text in ["", "a", "c", "abab", "aabbab", "abcab", "bbbbaaa"]:
        paths = [p for p in all_segmentations(text, 3) if all(w in lexicon or len(w) == 1 for w in p)]
        score = lambda p: sum(lexicon.get(w, floor) for w in p)
        assert score(SG.best_path(text, lexicon, 3)) == pytest.approx(max(map(score, paths)))
        total, want = sum(math.exp(score(p)) for p in paths), collections.Counter()
        for p in paths:
            for w in p:
                want[w] += math.exp(score(p)) / total
        got = SG.expected(text, lexicon, 3)
        assert set(got) == {w for w, n in want.items() if n} and all(got[w] == pytest.approx(want[w]) for w in got)
    assert sum(len(w) for w in SG.best_path("ab" * 3000, lexicon, 3)) == 6000
    assert sum(n * len(w) for w, n in SG.expected("ab" * 3000, lexicon, 3).items()) == pytest.approx(6000)


def test_many_texts_at_once_equal_one_by_one():
    """Texts of any length side by side, with characters that the lexicon lacks; substrings against slices."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé画x") for _ in range(rng.choice([0, 1, 2, 3, 9, 30, 200]))) for _ in range(60)]
    times = [float(rng.randint(1, 4)) for _ in texts]
    slices = collections.Counter()
    for text, n in zip(texts, times):
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            if j - i <= 5:
                slices[text[i:j]] += n
    assert {w: n for words, counts in SG.substrings(texts, times, 5) for w, n in zip(words.tolist(), counts.tolist())} == slices
    lexicon = SG.log_lexicon({w: n for w, n in slices.items() if n > 4 and "x" not in w})
    side = SG._Steps(texts, SG.Trie(lexicon, 5))
    assert side.paths() == [SG.best_path(t, lexicon, 5) for t in texts]
    want = collections.Counter()
    for text, n in zip(texts, times):
        for word, c in SG.expected(text, lexicon, 5).items():
            want[word] += n * c
    got = side.expected(times)
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w]) for w in want)


def test_segmenting_is_fast_enough_for_many_characters():
    """300,000 characters: a step a character in Python took over 15 seconds here."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["th", "er", "ion", "a", "re"]) for _ in range(20)) for _ in range(8000)]
    began = time.process_time()
    counts = {w: n for words, ns in SG.substrings(texts, [1.0] * len(texts)) for w, n in zip(words.tolist(), ns.tolist()) if n >= 50}
    side = SG._Steps(texts, SG.Trie(SG.log_lexicon(counts)))
    assert sum(n * len(w) for w, n in side.expected([1.0] * len(texts)).items()) == pytest.approx(sum(map(len, texts)))
    assert ["".join(p) for p in side.paths()] == texts
    assert time.process_time() - began < 8


def test_learned_lexicon_finds_word_boundaries(spark):
    """Boundary F1 on text whose blanks were removed, against the blanks; better than cutting every character or none."""
    rng = random.Random(3)
    vocabulary = list({"".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(120)})
    common = [1 / (i + 1) for i in range(len(vocabulary))]
    lines = [rng.choices(vocabulary, common, k=rng.randint(3, 12)) for _ in range(600)]
    df = spark.createDataFrame([(i, "".join(line)) for i, line in enumerate(lines)] + [(9998, ""), (9999, None)], "id long, text string")
    lexicon = SG.learn_lexicon(df, F.col("text"), least=3.0)
    assert all(c in lexicon for c in set("".join(vocabulary)))
    got = {r.id: r.w for r in df.select("id", SG.segmenter(spark, lexicon)(F.col("text")).alias("w")).collect()}
    assert got[9998] == got[9999] == []

    def cuts(row):
        return set(itertools.accumulate(map(len, row[:-1])))

    hit = sum(len(cuts(got[i]) & cuts(line)) for i, line in enumerate(lines))
    said, true = sum(len(cuts(got[i])) for i in range(len(lines))), sum(len(cuts(line)) for line in lines)
    f1 = 2 * hit / (said + true)
    every = 2 * true / (sum(sum(map(len, line)) - 1 for line in lines) + true)
    assert f1 > 0.8 and f1 > every, (f1, every)


def test_segmenter_keeps_han_and_blanks(spark):
    lexicon = SG.log_lexicon({"画面": 5, "很": 3, "精美": 4, "画": 1, "面": 1, "精": 1, "美": 1, "good": 2})
    df = spark.createDataFrame([("画面很精美 good!x",)], "text string")
    assert df.select(SG.segmenter(spark, lexicon)(F.col("text")).alias("w")).first().w == ["画面", "很", "精美", "good", "x"]
    assert SG.learn_lexicon(df.limit(0), F.col("text")) == {}
