"""HTML extraction, token alignment and conversation repair against brute force, with edge rows."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaudit.llm import chat_repair, html_suffix, token_align
from plaudit.llm.common import Kept

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def clash(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- conversation repair --------------------------------------------------------------------

def cheapest_by_search(rows):
    """Least (cost, audit) by trying every sequence of edits, a cost at a time, with strings in place of weights."""
    machine = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    layers = {0: {(0, "start"): {""}}}
    for cost in itertools.count():
        todo = [(node, audit) for node, audits in layers.get(cost, {}).items() for audit in audits]
        seen = set(todo)
        while todo:
            (i, state), audit = todo.pop()
            ways = [(3, i, machine[state][r], "I") for r in "ua" if r in machine[state]]
            if i < len(rows):
                initial, fault = rows[i]
                more = 3 if fault == "truncated" else 0
                ways.append((4, i + 1, state, "D"))
                if fault not in ("blank", "duplicate"):
                    ways += [(more, i + 1, machine[state][initial], "K")] if initial in machine[state] else []
                    ways += [(3 + more, i + 1, machine[state][r], "R") for r in "ua" if r in machine[state]]
            for extra, j, to, letter in ways:
                if extra:
                    layers.setdefault(cost + extra, {}).setdefault((j, to), set()).add(audit + letter)
                elif (((j, to), audit + letter)) not in seen:
                    seen.add(((j, to), audit + letter))
                    todo.append(((j, to), audit + letter))
        ends = [audit for (i, state), audit in seen if i == len(rows) and state in ("start", "a")]
        if ends:
            return cost, min(ends)


def test_cheapest_edits_equal_search():
    rng = random.Random(4)
    for n in [0, 0, 1, 1, 1, 2, 2, 2] + [3, 4, 5] * 25:
        rows = [(rng.choice("suuaaax"), rng.choice([None] * 5 + ["blank", "duplicate", "truncated", "truncated"])) for _ in range(n)]
        assert chat_repair.cheapest(rows) == cheapest_by_search(rows), rows


def test_repair_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(40), None, -5]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]),
                         rng.choice([None, "", " \n", "Yes.", "No", "Well? ", "A.b!c", "same.", "same."])))
    rows += [rows[3], rows[3]]
    drop_all = next(c for c in range(1000, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((drop_all, 0, "user", "gone."))
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "gone", "kind", "copy", "position")
    want = []
    for conv in dict.fromkeys(r[0] for r in rows):
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort()
        faults = []
        for k, (_, _, role, text) in enumerate(after):
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in [x[2:] for x in after[:k]] else None if body[-1] in ".!?" else "truncated")
        cost, audit = cheapest_by_search([(x[2][0], f) for x, f in zip(after, faults)])
        said, left = [], list(after)
        for letter in audit:
            _, _, role, text = (0, 0, "", "") if letter == "I" else left.pop(0)
            if letter != "D":
                if letter != "K":
                    role = "assistant" if said and said[-1][0] == "u" else "user"
                said.append(f"{role}:{text}")
        known = {x[1] for x in after if x[0]}
        illegal = sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        want.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(said).encode()).hexdigest()))
    assert rows_of(chat_repair.repair_digest(chat_repair.damaged(df))) == sorted(want, key=repr)
    whole = chat_repair.repair(chat_repair.damaged(df)).where("conv_id = 7").orderBy("position").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in whole).encode()).hexdigest() == next(w[-1] for w in want if w[0] == 7)
    assert chat_repair.repair_digest(chat_repair.damaged(df.limit(0))).count() == 0


def test_long_conversation_repair(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(3000)]
    got = chat_repair.repair_digest(chat_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.cost > 0 and len(got.audit) > 2500


# ---- token alignment ------------------------------------------------------------------------

def alignment_by_hand(rows):
    a_side, b_side = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_side.encode_special_tokens = True
    byte_of = {c: b for c, b in zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)])}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in byte_of)}
    held, counts = [], {}
    for doc_id, text in rows:
        one = None
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a_bytes = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
                spans = [[(sum(map(len, x[:k])), sum(map(len, x[:k + 1]))) for k in range(len(x))] for x in (a_bytes, b_bytes)]
                links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                groups = ";".join("|".join(",".join(str(i) for i, (s, e) in zip(ids, side) if low < e <= high) for ids, side in ((a, spans[0]), (b, spans[1]))) for low, high in zip([0, *cuts], cuts))
                one = len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest()
                for pair in set(links):
                    counts[pair] = counts.get(pair, 0) + 1
        held.append((doc_id, one))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, one[0], one[1], one[2], len(one[3]), sum(counts[p] == best[p[0]] for p in one[3]), sum(counts[p] for p in one[3]), one[4]) if one else (i, 0, 0, 0, 0, 0, 0, "") for i, one in held), key=repr)


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = "the tokeniser überall naïve 12345 don't  spaces\n\nlines 中文字 😀 <|endoftext|> <s> </s> <0x41> don’t ͸ x=1; CamelCase café".split(" ")
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(1, 60)) for _ in range(30)] + ["", None, " ", "\n", "▁ low line", "a" * 500, "tab\tand\r\nreturn", "\x00 nul", "  two before"]
    rows = list(enumerate(texts)) + [(100, texts[0]), (101, texts[0]), (None, texts[1]), (None, None), (3, texts[2])]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "key", "n_a", "block", "pairs", "documents", "count")
    want = alignment_by_hand(rows)
    for size in (4 << 20, 300):
        assert rows_of(token_align.align_documents(df, A_PATH, B_PATH, Kept(spark, "test"), size)) == want
    monkeypatch.setattr(token_align, "PART_CHARS", 40)
    aligner = token_align.load(A_PATH, B_PATH)
    long = " ".join(rng.choice(["alpha", "beta", "gamma delta,", "x1"]) for _ in range(400))
    assert len(aligner.parts(long)) > 10
    one = aligner.encode([long])[0]
    assert one[0].tolist() == aligner.a.encode(" " + long).ids and one[1].tolist() == aligner.b.encode(long)
    assert token_align.align_documents(df.limit(0), A_PATH, B_PATH, Kept(spark, "test")).count() == 0


# ---- HTML extraction ------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p {{}}</style><script>var x = "</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home {n}</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Head &amp; line {n}</h1><p>by someone</p></header><p>First <b>bold</b> te<i>xt</i><br>goes&nbsp;on {n} &lt;tag&gt; &#x41; &copy<p>Second
 paragraph<ul><li>one<li>two</ul><aside>side</aside><form>mail <input></form><p>Last <span class="ad">buy</span> words.</p>
<section id="comments"><article class="reply"><p>First!</p></article></section></article><div class="sidebar">More</div><footer>&copy; 2024</footer>"""


def test_marked_articles(spark):
    text = "Head & line {n}\nFirst bold text goes on {n} <tag> A ©\nSecond paragraph\none\ntwo\nLast words."
    rows = [(n, f"http://h{n % 2}.example/{n}", PAGE.format(n=n, t=f"T{n}")) for n in range(6)] + [(3, "http://h1.example/3", PAGE.format(n=3, t="T3"))]
    rows += [(None, None, None), (None, "x", ""), (9, "http://e.example", "no markup at all"), (10, None, "<article>open end <p>a < b & c <!-- gone"),
             (11, "http://e.example/2", "<form><div><article>in a form</article></div></form>"), (12, "u", "<main><p>main part</p><nav>menu</nav></main> tail"), (13, "u", "</p></div>stray")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "row", "host", "version", "texts", "text")
    want = {9: "no markup at all", 10: "open end\na < b & c", 11: "in a form", 12: "main part", 13: "stray"}
    want = sorted(((i, u, t, len(t)) for i, u, h in rows for t in [want[i] if i in want else text.format(n=i) if h else ""]), key=repr)
    assert rows_of(html_suffix.extract(df)) == want
    assert html_suffix.extract(df.limit(0)).count() == 0


def test_host_repeats_leave_open_blocks(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    banner, small, shared = prose(14), prose(3), prose(30)
    bodies = [[prose(20), prose(12)] for _ in range(5)]
    page = lambda title, body: f"<title>{title}</title><div>{banner}</div><div>{small}</div>" + "".join(f"<p>{p}</p>" for p in body) + f"<div>{prose(2)} {banner}</div>"
    rows = [(n, "https://host.example/a", page(f"t{n}", bodies[n])) for n in range(5)]
    rows += [(5, "https://host.example/copy", page("t0", bodies[0]))]                      # a version of page 0: its article is no repeat
    rows += [(6, "https://other.example/", f"<title>x</title><div>{banner}</div><p>{shared}</p>")]  # once on its host: stays
    rows += [(7, "https://third.example/1", f"<title>y</title><p>{shared}</p>"), (8, "https://third.example/2", f"<title>z</title><p>{shared}</p>")]  # all covered: stays
    got = {r.page_id: r.text for r in html_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(5):
        assert got[n] == "\n".join(bodies[n])
    assert got[5] == "\n".join(bodies[0]) and got[6] == f"{banner}\n{shared}" and got[7] == got[8] == shared


def test_repeated_suffixes_equal_sorted_array(spark):
    """The distributed depth-limited array marks what a plain suffix array per host marks."""
    rng = random.Random(1)
    pages = [(f"h{rng.randrange(2)}", v, [rng.choice("ab") for _ in range(rng.randint(0, 40))]) for v in range(8)]
    suffix = lambda words, i: html_suffix._windows(words[i:i + html_suffix.LONG])[0]
    array = sorted((h, tuple(w[i:i + html_suffix.LONG]), v, suffix(w, i)) for h, v, w in pages for i in range(len(w) - html_suffix.LONG + 1))
    want = {(a[0], a[3]) for a, b in zip(array, array[1:]) if a[:2] == b[:2] and a[2] != b[2]}
    df = spark.createDataFrame([(h, v, html_suffix._windows(w)) for h, v, w in pages], "host string, version long, suffixes array<long>")
    assert {tuple(r) for r in html_suffix.repeated_suffixes(df).collect()} == want and want


def test_suffixes_are_sorted_by_their_tokens(spark):
    """The host's suffix array is in token order, neighbours' common prefixes are measured, and repeats are what brute force finds."""
    rng = random.Random(4)
    pages = [(f"h{rng.randrange(2)}", v, [rng.choice("ab") for _ in range(rng.randint(0, 40))]) for v in range(9)]
    df = spark.createDataFrame([(h, v, html_suffix._windows(w), w) for h, v, w in pages], "host string, version long, suffixes array<long>, words array<string>")
    array = [(r.host, tuple(r.tokens), r.version) for r in html_suffix.suffix_array(df.repartition(3), "words").collect()]
    assert array == sorted(array) and all(len(t) == html_suffix.LONG for _, t, _ in array)
    seen = {}
    for h, v, w in pages:
        for i, name in enumerate(html_suffix._windows(w)):
            seen.setdefault((h, tuple(w[i:i + html_suffix.LONG]), name), set()).add(v)
    assert {(h, t) for h, t, _ in array} == {k[:2] for k in seen}
    got = [tuple(r) for r in html_suffix.repeated_suffixes(df.repartition(3), "words").collect()]
    assert len(got) == len(set(got)) and set(got) == {(h, name) for (h, _, name), of in seen.items() if len(of) > 1}
    lists = pa.array([["a", "b"], ["a", "c"], ["a", "c"]])
    assert html_suffix.common_prefixes(lists).tolist() == [0, 1, 2] and html_suffix.common_prefixes(lists[1:]).tolist() == [0, 2]


def test_article_text_is_no_repeat(spark):
    """Pages without a marked article keep text that their host marks as an article elsewhere, though it repeats."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    article, notice, lines = [prose(20), prose(2), prose(9), prose(3)], prose(12), [prose(6) for _ in range(5)]
    body = "".join(f"<p>{p}</p>" for p in article)
    copy = lambda n: f"<title>copy {n}</title><div>{notice}</div>{body}<div>{lines[n]}</div><div>{notice}</div>"
    rows = [(0, "http://a.example/0", f"<title>whole</title><div>{notice}</div><article>{body}</article><div>{notice}</div>")]
    rows += [(n, f"http://a.example/{n}", f"<title>{n}</title><div>{notice}</div><article>{quoted}</article>") for n, quoted in ((7, notice), (8, lines[0]))]
    rows += [(n, f"http://a.example/{n}", copy(n)) for n in (1, 2)] + [(2, "http://A.example/2", copy(2)), (None, "http://a.example/x", copy(1))]
    rows += [(n, f"http://b.example/{n}", copy(n)) for n in (3, 4)]  # no article is marked on this host
    rows += [(9, "http://a.example/9", None)]
    whole = "\n".join(article)
    want = [(0, whole), (7, notice), (8, lines[0]), (1, f"{whole}\n{lines[1]}"), (2, f"{whole}\n{lines[2]}"), (2, f"{whole}\n{lines[2]}"), (None, f"{whole}\n{lines[1]}"), (3, lines[3]), (4, lines[4]), (9, "")]
    for parts in (1, 5):
        got = html_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts))
        assert sorted(((r.page_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_article_suffixes_equal_brute_force(spark):
    """Of the repeats asked for, those that more marked pages have in the article than outside, all words of all articles read."""
    rng = random.Random(6)
    pages = [(f"h{rng.randrange(2)}", [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 16))) for _ in range(4)], rng.random() < 0.8) for _ in range(14)]
    tags = lambda marked: ("article", "div", "nav", "article") if marked else ("div", "div", "nav", "p")
    rows = [(h, "".join(f"<{tag}>{text}</{tag}>" for tag, text in zip(tags(marked), texts))) for h, texts, marked in pages] + [("h0", None)]
    votes = {}
    for h, texts, marked in pages:
        if marked and any((texts[0], texts[3])):
            for of, vote in (((0, 3), 1), ((1, 2), -1)):
                for name in set(html_suffix._windows([w for i in of for w in texts[i].split()])):
                    votes[h, name] = votes.get((h, name), 0) + vote
    asked = sorted(votes)[::2] + [(h, n) for h in ("h0", "h1", "h2") for n in (-5, 0, 7)] + [("h2", sorted(votes)[0][1])]
    given = spark.createDataFrame([(0, *r) for r in rows], "page long, host string, html string").repartition(3)
    got = [tuple(r) for r in html_suffix.article_suffixes(given, given.mapInArrow(html_suffix._streams, html_suffix.STREAM), spark.createDataFrame(asked, "host string, suffix long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k in asked if votes.get(k, 0) > 0} and got
    assert min(votes.values()) < 0 and 0 in votes.values()


def test_main_text_leaves_marked_articles_whole():
    """Repeats cover open blocks by tokens; article text in them, and a marked article, is never covered."""
    open_, words = [(html_suffix.OPEN, " ".join("abcdefghij")), (html_suffix.CLOSED, "menu"), (html_suffix.OPEN, "k l")], [(0, False), (2, False)]
    assert html_suffix.main_text(open_, words) == "k l" and html_suffix.main_text(open_, []) == "a b c d e f g h i j\nk l"
    assert html_suffix.main_text(open_, [(0, True), *words]) == "a b c d e f g h i j\nk l"
    assert html_suffix.main_text([(html_suffix.KEPT, "x y"), *open_], words) == "x y" and html_suffix.main_text([(html_suffix.GONE, "x")], []) == ""
