"""Bit readers and writers, and serialised structures: round trips, point lookups, sizes and damaged blobs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.functions import blobs, entropy_codes
from symweave.functions.bits import BitReader, BitWriter
from symweave.operators import pairs

NUMBERS = st.lists(st.integers(0, 2**45), min_size=1, max_size=150).map(sorted)
WORDS = st.lists(st.binary(max_size=6), min_size=1, max_size=60, unique=True).map(sorted)


def test_bits():
    out = BitWriter()
    for value, n in ((0b1101, 4), (0xBEEF, 16), (1, 1), (7, 0), ((1 << 63) - 1, 63)):
        out.write(value, n)
    assert out.at == 84
    part = BitReader(out.finish())
    assert [part.read(n) for n in (4, 16, 1, 0, 63)] == [0b1101, 0xBEEF, 1, 0, (1 << 63) - 1]
    with pytest.raises(EOFError):
        part.read(5)
    assert (part.at, part.remaining(), part.bytes_read(), part.at_end()) == (84, 4, 11, False)
    part.align()
    assert part.at_end()
    part.seek(4)
    assert part.read(16) == 0xBEEF
    assert [BitReader(b"\xa5").read(1)] + [b for b in map(int, "0100101")] == [1, 0, 1, 0, 0, 1, 0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=600))
def test_bit_vector(bits):
    blob = blobs.pack_bit_vector(bits)
    n = len(bits)
    assert len(blob) == 12 + -(-n // 8) + 4 * -(-n // 256) + -(-n // 64)
    assert blobs.read_bit_vector(blob).tolist() == bits
    for at in range(0, n + 3, 7):
        assert blobs.rank_in(blob, at) == sum(bits[:at])
    for bit in (0, 1):
        places = [i for i, b in enumerate(bits) if b == bit]
        assert [blobs.select_in(blob, i, bit) for i in range(0, n, 29)] == [places[i] if i < len(places) else n for i in range(0, n, 29)]


@settings(max_examples=80, deadline=None)
@given(NUMBERS, WORDS, st.integers(1, 9))
def test_round_trips(numbers, words, size):
    assert blobs.read_sorted(blobs.pack_sorted(numbers)).tolist() == numbers
    assert blobs.read_deltas(blobs.pack_deltas(numbers, size)) == numbers
    assert blobs.read_strings(blobs.pack_strings(words, size)) == words
    symbols = [v % 251 for v in numbers]
    assert blobs.read_symbols(blobs.pack_symbols(symbols)).tolist() == symbols
    states = blobs.automaton(words)
    for compact in (False, True):
        assert blobs.read_automaton(blobs.pack_automaton(states, compact), compact) == states
    known = set(words)
    for p in {w[:k] for w in words for k in range(len(w) + 1)} | {b"?", b""}:
        assert blobs.accepts(states, p) == (p in known)


def test_fixtures():
    assert [blobs.leb128(v).hex() for v in (624485, 0, 127, 128, 16384)] == ["e58e26", "00", "7f", "8001", "808001"]
    states = blobs.automaton(sorted(w.encode() for w in ("acted", "baked", "biked", "hiked", "liked")))
    assert (len(states), sum(len(e) for _, e in states)) == (9, 12)
    assert len(blobs.pack_automaton(states, True)) < len(blobs.pack_automaton(states))
    assert len(blobs.pack_tree([2, 2, 2, 0, 0, 0, 0])) < 200 and len(blobs.pack_deltas([3 * i for i in range(100)])) < 400
    assert len(blobs.pack_sorted([100 * i for i in range(1000)], 4)) < 5 * 1125
    block = bytes(0 if i % 4 == 0 else 1 for i in range(200))
    freqs = entropy_codes.quantise([50, 150], 12)
    assert len(blobs.pack_rans(block, freqs)) < 200 and blobs.read_rans(blobs.pack_rans(block, freqs), 200) == block
    for bad in ((blobs.pack_sorted, []), (blobs.pack_sorted, [2, 1]), (blobs.pack_tree, []), (blobs.pack_tree, [0, 1]), (blobs.pack_symbols, []), (blobs.pack_deltas, [1, 0]), (blobs.pack_strings, [b"b", b"a"]), (blobs.pack_strings, []), (blobs.automaton, [b"b", b"a"]), (blobs.automaton, [b"a", b"a"]), (blobs.pack_lengths, [16])):
        with pytest.raises(ValueError):
            bad[0](bad[1])
    with pytest.raises(ValueError):
        blobs.pack_deltas([1], 0)
    with pytest.raises(ValueError):
        blobs.pack_sorted([2**20], 2)


def test_damaged():
    rng = random.Random(1)
    numbers = sorted(rng.randrange(10**6) for _ in range(300))
    words = sorted({bytes(rng.choice(b"abc") for _ in range(1 + rng.randrange(6))) for _ in range(90)})
    states, lengths = blobs.automaton(words), entropy_codes.huffman_lengths([1 + i * i for i in range(40)]) + [0] * 216
    forms = [(blobs.pack_sorted(numbers), blobs.read_sorted), (blobs.pack_deltas(numbers), blobs.read_deltas), (blobs.pack_strings(words), blobs.read_strings), (blobs.pack_tree([2, 1, 0, 0]), blobs.read_tree), (blobs.pack_symbols([n % 9 for n in numbers]), blobs.read_symbols), (blobs.pack_automaton(states), blobs.read_automaton), (blobs.pack_lengths(lengths), blobs.read_lengths), (blobs.pack_merges([(97, 98), (256, 97)]), blobs.read_merges), (blobs.pack_bit_vector(np.arange(300) % 3 == 0), blobs.read_bit_vector)]
    for blob, read in forms:
        assert blobs.valid(read, blob) and blobs.valid(read, None) is None
        assert not blobs.valid(read, b"") and not blobs.valid(read, blob[:-1]) and not blobs.valid(read, blob + b"\0")
        for _ in range(80):
            hurt = bytearray(blob)
            hurt[rng.randrange(len(hurt))] ^= 1 << rng.randrange(8)
            assert blobs.valid(read, bytes(hurt)) in (True, False)
    assert not blobs.valid(blobs.read_rotations, b"\x05\0\0\0abc") and not blobs.valid(blobs.read_rotations, b"\0\0\0\0")
    assert not blobs.valid(blobs.read_automaton, blobs.pack_automaton([(False, [(97, 0)])]))


def test_merges():
    merges = [(97, 97, 256), (256, 98, 257)]
    assert pairs.apply_merges(b"aaabaab", merges) == [256, 97, 98, 257]
    assert pairs.expand_tokens([256, 97, 98, 257], merges) == b"aaabaab"
    with pytest.raises(ValueError):
        pairs.expand_tokens([300], merges)
