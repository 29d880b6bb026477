"""Language models tell languages of one script apart, whatever the script."""

import random

import numpy as np
from pyspark.sql import functions as F

from plaudit.llm import langid_kn


def test_languages_of_one_script(spark):
    """Each pair uses the same words with every letter five code points on, or with another vowel sign: five symbols for all letters cannot tell them apart."""
    rng = random.Random(4)
    words = [[rng.randrange(12) for _ in range(rng.randint(2, 7))] for _ in range(150)]
    letters = {"cyrillic": 0x430, "han": 0x4E10, "hangul": 0xAC00, "greek": 0x3B1}
    spell = {}
    for script, first in letters.items():
        spell[f"{script}1"] = lambda w, first=first: "".join(chr(first + x) for x in w)
        spell[f"{script}2"] = lambda w, first=first: "".join(chr(first + x + 5) for x in w)
    spell["sign1"] = lambda w: "".join(chr(0x915 + x) + "ि" for x in w)
    spell["sign2"] = lambda w: "".join(chr(0x915 + x) + "ु" for x in w)
    rows = [(i, " ".join(spell[lang](rng.choice(words)) for _ in range(12)), lang) for i, lang in enumerate(list(spell) * 30)]
    got = langid_kn.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    lang = {i: name for i, _, name in rows}
    assert len(got) > 50 and all(r.lang_pred == lang[r.doc_id] for r in got)
    upper = spark.createDataFrame([(i, t.upper(), name) for i, t, name in rows if name == "cyrillic1"], "doc_id long, text string, lang string")
    both = langid_kn.identify_languages(upper.withColumn("doc_id", F.lit(None).cast("long")).unionByName(spark.createDataFrame([(i, t, name) for i, t, name in rows if name == "cyrillic2"], upper.schema)))
    assert both.where("lang_pred = 'cyrillic1'").count() == 30


def test_probabilities_add_up():
    data = "abra cadabra, ça été Ünïcödé 中文 中国 हिन्दी".encode()
    texts = np.frombuffer(data * 3, np.uint8)
    left, gram, hashes, _ = langid_kn.grams(texts, np.array([0, len(data), 2 * len(data), 3 * len(data)]))
    order, at = langid_kn.runs(hashes)
    first, n = order[at], np.diff(np.append(at, len(order)))
    assert n.sum() == len(hashes) and len(set(hashes.tolist())) == len(at)
    symbols = np.unique(gram & ((1 << langid_kn.BITS) - 1))
    model = langid_kn.kneser_ney(left[first], gram[first], n, len(symbols) + 1)
    every = np.append(symbols, 0x10FFFF)  # and one that no text has
    for i in range(0, len(gram), 7):
        g = (gram[i] >> langid_kn.BITS << langid_kn.BITS) | every
        ll = np.full(len(g), left[i])
        assert abs(np.exp(model.logs(ll, g, langid_kn.long_hash(ll, g))).sum() - 1) < 1e-5
