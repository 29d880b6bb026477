"""Repeated windows are counted exactly when hashes share their upper bits."""

from plaudit.llm.rules_weak import with_repeated_words


def test_windows_that_share_upper_hash_bits(spark):
    a, b, c = 0x1234567890000001, 0x1234567890000002, -0x1234567890000001
    rows = [(1, [a, b, a]), (2, [a, b, a, b]), (3, [a, b]), (4, [c, 5, 6, 7, c, b]), (5, []), (6, [b, a, c, b, c])]
    got = with_repeated_words(spark.createDataFrame(rows, "id long, triples array<bigint>"), "triples", "n").collect()
    assert {r.id: r.n for r in got} == {1: 5, 2: 6, 3: 0, 4: 6, 5: 0, 6: 7}
