"""The training-data operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plaudit.llm import ann_crosspoly, byte_bpe, chat_fsm, cube_mix, langid_kn, ngram_join, pii_weak, quality_mil, rules_weak, suffix_dedup
from plaudit.llm.common import Kept
from plaudit.llm.graph import components

WORD = r"[^\x20\x09-\x0D]+"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def corpus(spark):
    """(rows, DataFrame): prose with copies, near copies and edge rows; columns that operators use inside clash."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    shared = prose(40)
    texts = [prose(rng.randint(60, 300)) for _ in range(25)]
    texts += texts[:4] + [texts[5].replace(texts[5].split()[9], "Zebra", 1), texts[6] + " end", shared + "\n" + prose(50), prose(30) + "\n" + shared, shared + " " + shared]
    texts += ["", None, "   \n\t", "Ünïcödé ça 中文字 😀 </turn> ### \\", "a" * 3000, "one two", "One TWO", "x", "!!!", "ABC!! " * 80,
              "mail bob.x+1@mail.example.com or 10.0.0.255, 1.2.3.4.5.6.7.8 and 300.1.1.1; card 4111 1111 1111 1111, 4111111111111112, tel +1 (366) 555-9807 a@b.c_d@e.f",
              "password=0030ef94f364d8386a and token = \"4b579d3cee1dcaf48e80dfd04d785e892fc7d365\" http://www.example.com/aaaaaaaaaaaaaaaaaa " + "1 2-3 " * 300]
    rows = [(i, t, ("en", "de", None)[i % 3], (f"s{i % 3}", None)[i % 7 == 0]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[8], "en", "s1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for extra in ("id", "n", "h", "sig", "words", "size", "target", "score", "__text", "spans"):
        df = df.withColumn(extra, F.lit("clash"))
    return rows, df


def collect(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.select(*columns).collect()), key=repr)


def test_byte_bpe_is_exact(corpus):
    rows, df = corpus
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [[i, list(ids := exact.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] for i, t, *_ in rows]
    got = byte_bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    assert collect(got, "doc_id", "ids", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert byte_bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 50)])
def test_ngram_join_equals_brute_force(corpus, k, percent):
    rows, df = corpus

    def shingles(text):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets, ids = [shingles(t) for _, t, *_ in rows], [-1 if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    least = collections.defaultdict(list)
    for r, i in zip(root, ids):
        least[r].append(i)
    none = lambda x: None if x == -1 else x
    want = [[none(i), len(s), none(min(least[r]))] for i, s, r in zip(ids, sets, root)]
    assert collect(ngram_join.near_duplicates(df, k, percent), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_of_one_leader(spark, monkeypatch, block):
    """A family around one text whose members are often too far from it: pairs across components are found in one block, or in many."""
    across, seen = ngram_join._across, []

    def spy(members, percent):
        seen.append(members.agg(F.max("blocks")).first()[0])
        return across(members, percent)

    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(ngram_join, "_across", spy)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(118)} for t in texts]
    root = list(range(60))
    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))
    assert seen[0] == 1 if block == 1024 else seen[0] > 2
    assert ngram_join.near_duplicates(got.select("doc_id", F.lit("").alias("text")).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null and shared ids: rows of unlike texts never stand for each other, and no near copy survives by sharing an id."""
    rng = random.Random(11)
    prose = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a, "1"), (None, b, "2"), (None, c, "3"), (None, c, "4"), (None, c + " end", "5"),  # null ids, unlike texts
            (7, d, "6"), (7, a + " end", "7"), (7, b + " end", "8"), (9, d + " end", "9"),  # only one row of id 7 leads
            (8, e, "10"), (8, e, "11"), (8, e, None), (3, e + " end", "12"),
            (None, None, "13"), (None, "", "14"), (4, " ", "15"), (4, " ", "16"), (None, None, "13")]
    k, percent = 5, 80
    sets = [{tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in ((t or "").split() for _, t, _ in rows)]
    root = list(range(len(rows)))
    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            root = [root[x] if r == root[y] else r for r in root]
    least = {r: min(-1 if rows[i][0] is None else rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    runs = [ngram_join.one_per_group(df.repartition(n), k, percent).collect() for n in (1, 3)]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    got = [tuple(r) for r in runs[0]]
    assert not collections.Counter(got) - collections.Counter(rows)
    of = [root[rows.index(r)] for r in got if (r[1] or "").strip()]
    assert sorted(of) == sorted({r for r, s in zip(root, sets) if s})  # one row of every group
    assert all((-1 if r[0] is None else r[0]) == least[root[rows.index(r)]] for r in got)
    assert sorted(r[2] for r in got if not (r[1] or "").strip()) == ["13", "13", "14", "15", "16"]
    assert ngram_join.one_per_group(df.limit(0)).count() == 0


def test_suffix_dedup_equals_brute_force(corpus, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(suffix_dedup, "SPLIT_BLOCKS", 2)  # hot anchors are split
    for length in (100, 20):
        first: dict[bytes, tuple] = {}
        order = sorted({(-1 if i is None else i, t or "") for i, t, *_ in rows})
        cuts = {}
        for i, t in order:
            b = t.encode()
            hit = np.zeros(len(b) + 1, int)
            for s in range(len(b) - length + 1):
                if first.setdefault(b[s:s + length], (i, t, s)) != (i, t, s):
                    hit[s] += 1
                    hit[s + length] -= 1
            gone = np.cumsum(hit)[:-1] > 0
            cuts[i, t] = [len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()]
        want = [[i, *cuts[-1 if i is None else i, t or ""]] for i, t, *_ in rows if i is not None]
        got = suffix_dedup.repeated_spans(df, length)
        assert [r for r in collect(got, "doc_id", "n_bytes", "n_removed", "kept_sha256") if r[0] is not None] == sorted(want, key=repr)
        assert got.count() == len(rows)
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0


def test_rules_count_exactly(corpus):
    rows, df = corpus
    want = []
    for i, t, *_ in rows:
        w = re.findall(WORD, t or "")
        triples = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        often, inside = collections.Counter(triples), set()
        for j, x in enumerate(triples):
            if often[x] > 1:
                inside |= {j, j + 1, j + 2}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        want.append([i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)])
    got, _ = rules_weak.score_rules(df)
    assert collect(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert got.where("kept and base_failed").count() == 0
    assert rules_weak.score_rules(df.limit(0))[0].count() == 0


def test_personal_data_keeps_base_spans(spark, corpus):
    rows, df = corpus
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, match):
        d = [int(x) for x in match if x.isdigit()][::-1]
        luhn = (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    got = {r.doc_id: r for r in pii_weak.find_personal_data(df.where("doc_id is not null"), Kept(spark, "pii")).collect()}
    for i, t, *_ in rows:
        if i is not None:
            base = [f"{k}:{m.start()}:{m.end()}" for k in patterns for m in re.finditer(patterns[k], t or "") if valid(k, m[0])]
            assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, base, got[i].spans)
            assert set(base) <= set(got[i].spans.split(",")) | {""}
    secret = next(i for i, t, *_ in rows if t and t.startswith("password"))
    assert got[secret].spans.count("secret:") == 2
    clean = {r.doc_id: r.text for r in pii_weak.redact(df.where("doc_id is not null")).collect()}
    assert "0030ef" not in clean[secret] and "[SECRET]" in clean[secret]
    assert all(clean[i] == t for i, t, *_ in rows if i is not None and not got[i].spans)
    assert pii_weak.find_personal_data(df.limit(0), Kept(spark, "pii")).count() == 0


def test_chat_round_trip(spark):
    tricky = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\n\\b"), (1, 1, "assistant", "a\n\\b"), (2, 0, "user", None), (2, None, None, "x"), (None, 5, "we:ird #", tricky), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat_fsm.read_back(chat_fsm.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-7].order_ok and not got[1].order_ok and not got[2].order_ok
    assert chat_fsm.read_back(chat_fsm.format_chats(df.limit(0))).count() == 0


def test_cube_mix_is_balanced(spark, corpus):
    rows, df = corpus
    assert cube_mix.cube_mix(df).count() == len(rows)
    assert cube_mix.cube_mix(df.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.lit("b")).alias("source"))
    mixes = [sorted(map(tuple, cube_mix.cube_mix(many, block_rows=256).collect()), key=repr) for _ in range(2)]
    assert mixes[0] == mixes[1]
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for doc_id, source, size, source_size, target, copies in mixes[0]:
        assert 0 <= copies <= 2
        by[source][0] += size * copies
        by[source][1:] = target, source_size
    total = sum(x[2] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - 1.5 * total) < 1e-6 and all(x[1] <= 2 * x[2] + 1e-9 and abs(x[0] - x[1]) <= 60 for x in by.values())


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0] * 16), (1001, None), (1002, [float("nan")] * 16), (None, [1.0] * 16), (1003, [None] * 16), (1004, []), (1020, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann_crosspoly.nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    ids, unit = list(range(400)) + [1020], np.vstack([x, x[:1]])
    unit_hits = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = unit @ unit[ids.index(q)]
        best = sorted((i for i in ids if i != q), key=lambda i: (-s[ids.index(i)], i))[:10]
        assert len(got[q]) == 10 and q not in got[q]
        unit_hits += len(set(best) & set(got[q]))
    assert unit_hits / (10 * len(got)) >= 0.9 and set(got) == {i for i in ids if i % 20 == 0}
    few = df.where("vec_id < 8")
    assert ann_crosspoly.nearest(few, F.col("vec_id") % 20 == 0).count() == 7
    assert ann_crosspoly.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_language_and_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", "de"), (-3, "123 !", "fr"), (None, "the the", None)], "doc_id long, text string, lang string")
    found = langid_kn.identify_languages(docs.select("doc_id", "text", "lang").unionByName(extra)).join(docs.select("doc_id", "lang"), "doc_id", "left")
    assert found.where("doc_id < 0 and lang_pred = 'und' and score = 0").count() == 3
    assert found.where("held_out and doc_id >= 0").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    scored = quality_mil.score_quality(docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text")), labels)
    assert scored.where("score between 0 and 1").count() == docs.count() + 4
    right = scored.join(labels, "doc_id").where("held_out").agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    assert quality_mil.score_quality(docs.limit(5), labels.limit(0)).where("score = 0.5").count() == 5


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    for a, b in edges * 3:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {n: new if r == old else r for n, r in root.items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Kept(spark, "test"), "c").collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
