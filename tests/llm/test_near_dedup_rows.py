"""Which rows stay when near duplicates go: repeated rows, ids with several texts, null ids, clashing columns."""

import random

from symweave.llm import near_dedup

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def text_of(rng, n=40):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


def test_one_row_of_each_group(spark):
    rng = random.Random(11)
    a, b, c, d, e = (text_of(rng) for _ in range(5))
    rows = [(5, a), (5, b), (7, a), (7, a.upper()), (None, c), (None, d), (8, c), (9, e), (9, e), (9, e + " end"), (1, None), (1, None), (2, ""), (2, " "), (None, "")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, _d int, _h int, component int")
    left = near_dedup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    nine = next(t for i, t in found if i == 9)
    assert nine in (e, e + " end")
    assert found == sorted([(5, a), (5, b), (8, c), (None, d), (9, nine), (1, None), (2, ""), (2, " "), (None, "")], key=str)
    assert near_dedup.drop_near_duplicates(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(12)
    long = text_of(rng, 60_000)
    frame = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 500_000), (4, "x" * 500_000 + "y")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(frame, 80).collect()) == [1, 3, 4]


def test_hubs(spark):
    rows = [(k, bytes([n]), [n, n], d, bytes([c])) for k, n, d, c in [(1, 1, 5, 1), (1, 2, 9, 1), (1, 3, 9, 3), (1, 4, 2, 4), (2, 5, 1, 5), (2, 6, 1, 5)]]
    members = spark.createDataFrame(rows, "key bigint, node binary, sig array<bigint>, degree bigint, c binary")
    first = {(r.key, bytes(r.a), tuple(r.x), bytes(r.d)) for r in near_dedup.hubs_of(members).collect()}
    assert first == {(1, b"\x02", (2, 2), b"\x01"), (2, b"\x05", (5, 5), b"\x05")}
    further = [(r.key, bytes(r.a)) for r in near_dedup.hubs_of(members, 3).collect()]
    assert len(further) == len(set(further)) and further and set(further) <= {(1, b"\x03"), (1, b"\x04")}
