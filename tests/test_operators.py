"""Fixtures, error cases and random blocks for the sequence operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.functions import entropy_codes as codes
from symweave.operators import dictionary, ordered, pairs, stats, transforms, tree


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_block_transforms_round_trip(block):
    last, row = transforms.sort_rotations(block)
    rotations = sorted(block[i:] + block[:i] for i in range(len(block)))
    assert (last, row) == (bytes(r[-1] for r in rotations), rotations.index(block))
    assert transforms.unsort_rotations(last, row) == block
    assert transforms.move_from_front(transforms.move_to_front(block)) == block


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_coders_round_trip(block):
    counts = [block.count(bytes([s])) for s in range(256)]
    lengths = codes.huffman_lengths(counts)
    assert sum(2.0**-n for n in lengths if n) <= 1
    assert codes.huffman_decode(codes.huffman_encode(block, lengths), lengths, len(block)) == block
    f = codes.quantise(counts, 12)
    assert sum(f) == 4096
    assert codes.rans_decode(codes.rans_encode(block, f), f, len(block)) == block
    g = codes.quantise(counts, 9)
    assert codes.tans_decode(*codes.tans_encode(block, g, 9), g, 9, len(block)) == block


def test_fixtures():
    assert transforms.sort_rotations(b"banana") == (b"nnbaaa", 3)
    assert list(transforms.move_to_front(b"bananaaa")) == [98, 98, 110, 1, 1, 1, 0, 0]
    assert codes.huffman_lengths([40, 35, 20, 5]) == [1, 2, 3, 3]
    assert codes.huffman_lengths([0, 7]) == [0, 1]
    limited = codes.huffman_lengths([2**k for k in range(17)], 15)  # the shortest are made longer first, so none is near the limit
    assert limited[:6] == [6] * 6 and limited[-3:] == [3, 2, 2] and sum(2.0**-n for n in limited) <= 1
    assert max(codes.huffman_lengths([2**k for k in range(40)], 24)) <= 24 and sum(2.0**-n for n in codes.huffman_lengths([2**k for k in range(40)], 24)) <= 1
    for bad in (lambda: codes.rans_encode(b"b", [4096]), lambda: transforms.sort_rotations(b""), lambda: transforms.unsort_rotations(b"a", 1), lambda: codes.quantise([0], 4)):
        with pytest.raises((ValueError, IndexError)):
            bad()


def test_as_of_with_ties(spark):
    random.seed(3)
    values = sorted(random.randrange(50) for _ in range(80))
    index = spark.createDataFrame(list(enumerate(values)), "idx bigint, v bigint")
    found = {r[0]: (r[1], r[2]) for r in ordered.as_of(index, spark.range(-2, 55).toDF("probe")).collect()}
    for p in range(-2, 55):
        upto = [i for i, v in enumerate(values) if v <= p]
        assert found[p] == (next((i for i, v in enumerate(values) if v >= p), 80), upto[-1] if upto else 80)


def test_trees(spark):
    index = tree.tree_index(spark.createDataFrame(list(enumerate([2, 2, 1, 0, 0, 0])), "node bigint, degree bigint"))
    assert [r["first_child"] for r in index.orderBy("node").collect()] == [1, 3, 5, None, None, None]
    assert [r["parent"] for r in tree.parents(index).orderBy("node").collect()] == [None, 0, 0, 1, 1, 2]
    assert [r["child"] for r in tree.child_at(index, 1).orderBy("node").collect()] == [2, 4, None, None, None, None]
    for bad in ([0, 1], [3, 0], [0, 0]):
        with pytest.raises(ValueError):
            tree.tree_index(spark.createDataFrame(list(enumerate(bad)), "node bigint, degree bigint"))


def test_dictionary_counts(spark):
    words = spark.createDataFrame([(w,) for w in ("acted", "baked", "biked", "hiked", "liked")], "s string")
    assert tuple(dictionary.trie_counts(words).first()) == (25, 24)
    assert tuple(dictionary.minimal_counts(words).first()) == (9, 12)
    with pytest.raises(ValueError):
        dictionary.front_coded(words, 0)


def test_merges_and_quantised(spark):
    docs = spark.createDataFrame([("aax",), ("yaa",), ("aax",), ("yaa",), (None,)], "text string")
    assert pairs.learn_merges(docs, "text", 1) == [(97, 97, 256)]
    counts = spark.createDataFrame([(0, 3), (1, 1)], "sym bigint, freq bigint")
    assert [r["quantised"] for r in stats.quantised_frequencies(counts, 10).orderBy("sym").collect()] == [768, 256]
