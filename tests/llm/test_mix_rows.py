"""Documents taken by the mix, row by row."""

import collections

from plaudit.llm import cube_mix


def test_each_row_has_its_own_copies(spark):
    """Null and shared ids, and equal rows: every source meets its target, and no row is taken more often than the cap allows."""
    rows = [((None, 7, i)[i % 3], "w " * (i % 20 + 1) + f"t{i}", ("a", "b", None)[i // 3 % 3], f"l{i}") for i in range(600)]
    rows += [(None, "same words here", "a", "x")] * 40 + [(None, None, "a", "y"), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = [tuple(r) for r in cube_mix.mixed_documents(df, ratio=1.4, weights=(1,)).collect()]
    again = [tuple(r) for r in cube_mix.mixed_documents(df.repartition(3), ratio=1.4, weights=(1,)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    words = lambda r: len((r[1] or "").split())
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        size[r[2]] += words(r)
    for r in got:
        taken[r[2]] += words(r)
    # by water filling every source shares alike unless its cap holds
    target = {r.source: r.target for r in cube_mix.cube_mix(df, ratio=1.4, weights=(1,)).collect()}
    assert all(abs(taken[s] - target[s]) <= 42 for s in size), (taken, target)
    many, have = collections.Counter(got), collections.Counter(rows)
    assert all(n <= 2 * have[r] for r, n in many.items())
