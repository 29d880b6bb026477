"""The corpus pipeline end to end on a small corpus, each stage against brute force on what its predecessor kept."""

import base64
import collections
import itertools
import os
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from plaudit.llm import cube_mix, quality_mil

WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    good = [prose(rng.randint(60, 120)) for _ in range(70)]
    near = [g.replace(g.split()[7], "zebra", 1) for g in good[:10]]
    junk = ["$$$ ### 123 " * rng.randint(30, 60) for _ in range(40)]
    private = [prose(60) + f" write to bob{i}@mail.example.com from 10.0.0.{i}" for i in range(12)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", None]), len(t)) for i, t in enumerate(good + near + junk + private + good[:6])]
    rows += [(None, good[20], "en", "s0", len(good[20])), (None, prose(80), "en", "s1", 400), rows[3], (500, None, None, None, None), (501, "", "en", "s0", 0), (501, "  \n", "en", "s0", 3)]
    labels = [(i, int(i < 80 or i >= 120), 0) for i in range(132)]
    return rows, labels


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(os.path.join(sf, name))
        seen[name] = (docs, spark.read.parquet(os.path.join(sf, name)))
        docs = seen[name][1]
    given = lambda name: [tuple(r) for r in seen[name][0].collect()]
    got = lambda name: [tuple(r) for r in seen[name][1].collect()]

    # quality: what scores under a half goes, and nothing else
    scored = quality_mil.score_quality(seen["quality"][0], spark.read.parquet(f"{sf}/labels.parquet")).collect()
    passing = collections.Counter(r.doc_id for r in scored if r.score >= 0.5)
    assert collections.Counter(r[0] for r in got("quality")) == passing
    assert sum("$$$" in (r[1] or "") for r in got("quality")) <= 2 and sum(r[0] is not None and r[0] < 70 for r in got("quality")) >= 66

    # near duplicates: one row of each component of the Jaccard graph
    texts = given("near_duplicates")
    sets = []
    for r in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = root[b], root[a]
            root = [new if x == old else x for x in root]
    groups = collections.defaultdict(list)
    for i, x in enumerate(root):
        groups[x].append(texts[i])
    smallest = lambda g: min(-1 if r[0] is None else r[0] for r in g)
    want = collections.Counter(smallest(g) for g in groups.values())
    assert collections.Counter(-1 if r[0] is None else r[0] for r in got("near_duplicates")) == want
    assert set(got("near_duplicates")) <= set(texts) and len(want) < len(texts)

    # personal data: base kinds go from every text, texts without a candidate are unchanged, no row goes
    before, after = {(r[0], r[2], r[3]): r for r in given("personal_data")}, got("personal_data")
    assert len(after) == len(given("personal_data"))
    assert not any("@" in (r[1] or "") or re.search(r"10\.0\.0\.\d", r[1] or "") for r in after)
    assert sum("[EMAIL]" in (r[1] or "") for r in after) == sum("@" in (r[1] or "") for r in before.values()) > 5
    assert all(r[1] == before[r[0], r[2], r[3]][1] for r in after if not re.search("[0-9@=:]", before[r[0], r[2], r[3]][1] or ""))

    # mix: targets by pouring words step by step; each row at most twice; words near the target
    rows = given("mix")
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(WORD, r[1] or ""))
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2))))
    target, total = dict.fromkeys(size, 0.0), 1.5 * sum(size.values())
    for _ in range(200):
        rest, open_ = total - sum(target.values()), [s for s in size if target[s] < 2 * size[s] - 1e-9]
        if rest < 1e-6 or not open_:
            break
        for s in open_:
            target[s] = min(2 * size[s], target[s] + rest * weight[s] / sum(weight[o] for o in open_))
    stated = {r.source: r.target for r in cube_mix.cube_mix(seen["mix"][0]).collect()}
    assert all(abs(stated[s] - target[s]) < 1e-3 for s in size)
    taken, times = collections.Counter(), collections.Counter(got("mix"))
    for r in got("mix"):
        taken[r[3]] += len(re.findall(WORD, r[1] or ""))
    assert all(abs(taken[s] - target[s]) <= 130 for s in size) and max(times.values()) <= 2 * max(collections.Counter(rows).values())

    # tokens: the public library's ids for every row of the mix
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((repr(r[0]), exact.encode_ordinary(r[1] or "")) for r in given("tokens"))
    assert sorted((repr(r.doc_id), list(r.ids)) for r in seen["tokens"][1].collect()) == want

    whole = corpus_pipeline.run(spark, sf)
    assert collections.Counter(r.ids_sha256 for r in whole.collect()) == collections.Counter(r.ids_sha256 for r in seen["tokens"][1].collect())


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
