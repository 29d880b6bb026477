"""Rule reliabilities come from the table: the constants weigh as much as ten rows."""

import math
import random

from pyspark.sql import functions as F

from plaudit.llm import rules_weak


def test_weights_follow_the_votes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    texts = [prose(80) for _ in range(300)] + [" ".join("#*$" if rng.random() < 0.3 else w for w in prose(80).split()) for _ in range(40)]
    texts += [" ".join([prose(3)] * 25) for _ in range(30)] + [prose(80).upper().replace(" ", "!! ") for _ in range(20)]
    scored, model = rules_weak.score_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = scored.select(*rules_weak.RULES, F.col("posterior").alias("p"), "doc_id").orderBy("doc_id").collect()
    yes, no = sum(r.p for r in rows), sum(1 - r.p for r in rows)
    for rule, weights in zip(rules_weak.RULES, model.weights):
        for vote in {r[rule] for r in rows}:
            good, bad = (max((sum(p for r in rows if r[rule] == vote for p in [r.p if side == 0 else 1 - r.p]) + 10 * rules_weak.START[side][vote + 1]) / (all_ + 10), 1e-4)
                         for side, all_ in enumerate((yes, no)))
            assert abs(weights[vote + 1] - math.log(good / bad)) < 0.1, (rule, vote)
    assert [r.p >= 0.5 for r in rows] == [True] * 300 + [False] * 90
