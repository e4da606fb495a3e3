"""Serialised structures, one block each: little-endian integers, bits from the most significant one.

Each read_* function takes back what its pack_* function wrote, and packs again what it read: bytes that differ from
that are malformed and raise ValueError. valid() makes a yes or no of it, for filters over untrusted blobs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Any

import numpy as np

from symweave.functions import entropy_codes
from symweave.functions.bits import BitReader, BitWriter, pack_fields, unpack_fields

#: First byte of a compact automaton; superblock and block sizes of a bit vector. Fixed values of the formats.
COMPACT, SUPER, BLOCK = 0xDA, 256, 64


def _ints(values: Any, width: int) -> bytes:
    try:
        return b"".join(int(v).to_bytes(width, "little") for v in values)
    except OverflowError as e:
        raise ValueError("a number is negative or too wide for its field") from e


class _Cursor:
    def __init__(self, blob: bytes):
        self.blob, self.at = blob, 0

    def take(self, n: int) -> bytes:
        if n > len(self.blob) - self.at:
            raise ValueError("the blob ends early")
        self.at += n
        return self.blob[self.at - n : self.at]

    def int(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def ints(self, count: int, width: int) -> list[int]:
        data = self.take(count * width)
        return [int.from_bytes(data[i : i + width], "little") for i in range(0, len(data), width)]

    def rest(self) -> bytes:
        return self.take(len(self.blob) - self.at)


def _same(blob: bytes, again: bytes, value: Any) -> Any:
    if blob != again:
        raise ValueError("the blob contradicts itself")
    return value


def pack_bit_vector(bits: Any, idx: int = 4) -> bytes:
    """Bit count, ones, superblocks, the bits, ones before each superblock, and before each block in its superblock."""
    bits = np.asarray(bits, np.uint8)
    before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
    supers, blocks = np.arange(0, len(bits), SUPER), np.arange(0, len(bits), BLOCK)
    inside = before[blocks] - before[blocks // SUPER * SUPER]
    return _ints([len(bits), before[-1], len(supers)], idx) + np.packbits(bits).tobytes() + _ints(before[supers], idx) + inside.astype(np.uint8).tobytes()


def read_bit_vector(blob: bytes, idx: int = 4) -> np.ndarray:
    part = _Cursor(blob)
    n = part.ints(3, idx)[0]
    bits = np.unpackbits(np.frombuffer(part.take(-(-n // 8)), np.uint8))[:n]
    return _same(blob, pack_bit_vector(bits, idx), bits)


def rank_in(blob: bytes, at: int, idx: int = 4) -> int:
    """Ones before bit at (no more than all of them), from the counts and at most one block of a valid bit vector."""
    part = _Cursor(blob)
    n, ones, supers = part.ints(3, idx)
    if at >= n:
        return ones
    bits = part.take(-(-n // 8))
    over = _Cursor(part.take(supers * idx)[at // SUPER * idx :]).int(idx)
    first = at // BLOCK * BLOCK
    part_of_block = int.from_bytes(bits[first // 8 : first // 8 + 8].ljust(8, b"\0"), "big") >> (BLOCK - (at - first))
    return over + part.rest()[at // BLOCK] + part_of_block.bit_count()


def select_in(blob: bytes, i: int, bit: int = 1, idx: int = 4) -> int:
    """Place of the i-th bit of that value, by halving over rank_in(); the bit count if there is none."""
    low, high = 0, _Cursor(blob).int(idx)
    n = high
    while low < high:
        middle = (low + high) // 2
        ones = rank_in(blob, middle + 1, idx)
        if (ones if bit else middle + 1 - ones) > i:
            high = middle
        else:
            low = middle + 1
    return min(low, n)


def pack_sorted(values: Any, width: int = 8, idx: int = 4) -> bytes:
    """Ascending numbers, each split in low bits and a unary high part; ValueError for none, or for a descent."""
    v = np.asarray(values, np.int64)
    if not len(v) or v[0] < 0 or (np.diff(v) < 0).any():
        raise ValueError("values must be there, ascending and not negative")
    if int(v[-1]) >> 8 * width:
        raise ValueError("a value is too wide for its field")
    universe = min(int(v[-1]) + 1, (1 << 8 * width) - 1)
    low = max(0, (universe // len(v)).bit_length() - 1)
    high = np.zeros(len(v) + (int(v[-1]) >> low) + 1, np.uint8)
    high[(v >> low) + np.arange(len(v))] = 1
    lows = pack_fields(v & ((1 << low) - 1), low) if low else b""
    return _ints([len(v)], idx) + _ints([universe], width) + bytes([low]) + lows + pack_bit_vector(high, idx)


def read_sorted(blob: bytes, width: int = 8, idx: int = 4) -> np.ndarray:
    part = _Cursor(blob)
    n, _, low = part.int(idx), part.int(width), part.int(1)
    if low > 62:
        raise ValueError("too many low bits")
    lows = part.take(-(-n * low // 8))
    ones = np.flatnonzero(read_bit_vector(part.rest(), idx))
    if len(ones) != n:
        raise ValueError("the high parts are of another count")
    v = (ones - np.arange(n)) << low | unpack_fields(lows, low, n)
    return _same(blob, pack_sorted(v, width, idx), v)


def pack_tree(degrees: Any, idx: int = 4) -> bytes:
    """Child counts in breadth-first order, in unary after the bits 1 and 0; ValueError if they make no tree."""
    d = np.asarray(degrees, np.int64)
    n = len(d)
    if not n or (d < 0).any() or d.sum() != n - 1 or (np.cumsum(d)[:-1] < np.arange(1, n)).any():
        raise ValueError("these degrees make no tree")
    bits = np.ones(2 * n + 1, np.uint8)
    bits[np.concatenate([[1], 1 + np.cumsum(d + 1)])] = 0
    return _ints([n], idx) + pack_bit_vector(bits, idx)


def read_tree(blob: bytes, idx: int = 4) -> np.ndarray:
    part = _Cursor(blob)
    part.int(idx)
    degrees = np.diff(np.flatnonzero(read_bit_vector(part.rest(), idx) == 0)) - 1
    return _same(blob, pack_tree(degrees, idx), degrees)


def pack_symbols(symbols: Any, sym: int = 1, idx: int = 4) -> bytes:
    """One bit vector for each bit of the symbols, the highest first; each is in the stable order of the bits above."""
    s = np.asarray(symbols, np.int64)
    if not len(s) or s.min() < 0:
        raise ValueError("symbols must be there and not negative")
    depth = max(1, int(s.max()).bit_length())
    out = [_ints([len(s)], idx), bytes([depth]), _ints([s.max()], sym)]
    for level in range(depth):
        ordered = s[np.argsort(s >> (depth - level), kind="stable")]
        bits = pack_bit_vector(ordered >> (depth - 1 - level) & 1, idx)
        out += [_ints([len(bits)], idx), bits]
    return b"".join(out)


def read_symbols(blob: bytes, sym: int = 1, idx: int = 4) -> np.ndarray:
    part = _Cursor(blob)
    n, depth, _ = part.int(idx), part.int(1), part.int(sym)
    if depth > 8 * sym or n > 8 * len(blob):
        raise ValueError("more levels than a symbol has bits, or fewer bits than symbols")
    s = np.zeros(n, np.int64)
    for _ in range(depth):
        bits = read_bit_vector(part.take(part.int(idx)), idx)
        if len(bits) != n:
            raise ValueError("a level is of another length")
        order = np.argsort(s, kind="stable")
        s[order] = s[order] * 2 + bits
    return _same(blob, pack_symbols(s, sym, idx), s)


def leb128(value: int) -> bytes:
    """Groups of seven bits, the lowest first; all but the last have the high bit set."""
    out = bytearray()
    while value >= 128:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_leb128(part: _Cursor) -> int:
    blob, at, value = part.blob, part.at, 0
    for shift in range(0, 70, 7):
        if at == len(blob):
            raise ValueError("the blob ends early")
        b = blob[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            part.at = at
            return value
    raise ValueError("a number of more than ten bytes")


def is_leb128(data: bytes) -> bool:
    """Whether the bytes are one number in its shortest form, and nothing else."""
    try:
        part = _Cursor(data)
        return leb128(read_leb128(part)) == data
    except ValueError:
        return False


def pack_deltas(values: Any, block: int = 64, width: int = 8, idx: int = 4, offset: int = 4) -> bytes:
    """Count, block size, each block's first number, where its differences begin, and the differences."""
    v = [int(x) for x in values]
    if block <= 0 or any(a > b for a, b in zip(v, v[1:])):
        raise ValueError("blocks must not be empty, and values ascend")
    parts = [b"".join(leb128(b - a) for a, b in zip(v[i : i + block], v[i + 1 : i + block])) for i in range(0, len(v), block)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[: len(parts)]
    return _ints([len(v)], idx) + _ints([block], 2) + _ints(v[::block], width) + _ints(starts, offset) + b"".join(parts)


def read_deltas(blob: bytes, width: int = 8, idx: int = 4, offset: int = 4) -> list[int]:
    part = _Cursor(blob)
    n, block = part.int(idx), part.int(2)
    if not block:
        raise ValueError("empty blocks")
    blocks = -(-n // block)
    anchors = part.ints(blocks, width)
    part.ints(blocks, offset)
    v: list[int] = []
    for i in range(blocks):
        v.append(anchors[i])
        for _ in range(min(block, n - i * block) - 1):
            v.append(v[-1] + read_leb128(part))
    return _same(blob, pack_deltas(v, block, width, idx, offset), v)


def delta_at(blob: bytes, i: int, width: int = 8, idx: int = 4, offset: int = 4) -> int:
    """The i-th number of a valid blob by pack_deltas(), from its block alone; IndexError beyond the last."""
    part = _Cursor(blob)
    n, block = part.int(idx), part.int(2)
    if not 0 <= i < n:
        raise IndexError("no such place")
    blocks, at = -(-n // block), i // block
    anchors, starts = part.take(blocks * width), part.take(blocks * offset)
    value = int.from_bytes(anchors[at * width : (at + 1) * width], "little")
    part.take(int.from_bytes(starts[at * offset : (at + 1) * offset], "little"))
    short = blob[part.at : part.at + i % block]
    if len(short) == i % block and short.isascii():  # each number has one byte
        return value + sum(short)
    for _ in range(i % block):
        value += read_leb128(part)
    return value


def pack_strings(strings: list[bytes], bucket: int = 16, idx: int = 4, length: int = 2) -> bytes:
    """Count, bucket size, buckets, where each begins in the blob; a bucket has one whole string, then what each next
    one shares with the one before, its rest's length and the rest. ValueError for none, a descent, or a long string."""
    if not strings or bucket <= 0 or any(a > b for a, b in zip(strings, strings[1:])):
        raise ValueError("strings must be there and ascend, and buckets not be empty")
    parts = []
    for i in range(0, len(strings), bucket):
        first, *others = strings[i : i + bucket]
        out, before = [_ints([len(first)], length), first], first
        for s in others:
            shared = next((k for k, (a, b) in enumerate(zip(before, s)) if a != b), min(len(before), len(s)))
            out += [_ints([shared, len(s) - shared], length), s[shared:]]
            before = s
        parts.append(b"".join(out))
    head = 2 * idx + 2 + len(parts) * idx
    starts = head + np.concatenate([[0], np.cumsum([len(p) for p in parts])])[: len(parts)]
    return _ints([len(strings)], idx) + _ints([bucket], 2) + _ints([len(parts)], idx) + _ints(starts, idx) + b"".join(parts)


def read_strings(blob: bytes, idx: int = 4, length: int = 2) -> list[bytes]:
    part = _Cursor(blob)
    n, bucket, buckets = part.int(idx), part.int(2), part.int(idx)
    if not bucket or buckets != -(-n // bucket):
        raise ValueError("the counts contradict each other")
    part.ints(buckets, idx)
    out: list[bytes] = []
    for i in range(n):
        shared = part.int(length) if i % bucket else 0
        out.append((out[-1][:shared] if shared else b"") + part.take(part.int(length)))
    return _same(blob, pack_strings(out, bucket, idx, length), out)


def string_at(blob: bytes, i: int, idx: int = 4, length: int = 2) -> bytes:
    """The i-th string of a valid blob by pack_strings(), from its bucket alone; IndexError beyond the last."""
    part = _Cursor(blob)
    n, bucket, buckets = part.int(idx), part.int(2), part.int(idx)
    if not 0 <= i < n:
        raise IndexError("no such place")
    part.at = int.from_bytes(part.take(buckets * idx)[i // bucket * idx :][:idx], "little")
    out = b""
    for k in range(i % bucket + 1):
        shared = part.int(length) if k else 0
        out = out[:shared] + part.take(part.int(length))
    return out


def header(blob: bytes, kind: str) -> dict[str, int]:
    """The numbers that begin a blob of that kind, without reading the rest."""
    fields = {"deltas": ((4, "count"), (2, "block")), "strings": ((4, "count"), (2, "bucket"), (4, "buckets")), "tree": ((4, "count"),), "rotations": ((4, "row"),)}[kind]
    part = _Cursor(blob)
    found = {name: part.int(width) for width, name in fields}
    return found | ({"count": len(blob) - 4} if kind == "rotations" else {})


State = tuple[bool, list[tuple[int, int]]]


def automaton(words: list[bytes]) -> list[State]:
    """Minimal automaton of strictly ascending words: (final, edges as (byte, state)) by state, the root first.

    Prefixes with the same ending words are one state: each is named, the longest first, by whether it is a word and
    by its edges to states already named.
    """
    if not words or any(a >= b for a, b in zip(words, words[1:])):
        raise ValueError("words must be there and strictly ascend")
    kids: dict[bytes, dict[int, bytes]] = {w: {} for w in words}
    for w in words:
        for i in range(len(w)):
            kids.setdefault(w[:i], {})[w[i]] = w[: i + 1]
    members, names, name = set(words), {}, {}
    for p in sorted(kids, key=len, reverse=True):
        form = (p in members, tuple((c, name[q]) for c, q in sorted(kids[p].items())))
        name[p] = names.setdefault(form, len(names))
    forms, place, queue = list(names), {name[b""]: 0}, [name[b""]]
    for at in queue:
        for _, to in forms[at][1]:
            if to not in place:
                place[to] = len(place)
                queue.append(to)
    return [(forms[at][0], [(c, place[to]) for c, to in forms[at][1]]) for at in queue]


def pack_automaton(states: list[State], compact: bool = False, idx: int = 4) -> bytes:
    """States, edges, where each state's edges begin (compact: how many it has), final marks (compact: bits, the lowest
    first), and the edges as label and target."""
    degrees = [len(e) for _, e in states]
    finals = np.array([f for f, _ in states], np.uint8)
    head = _ints([len(states), sum(degrees)], idx)
    edges = b"".join(bytes([c]) + _ints([to], idx) for _, e in states for c, to in e)
    if compact:
        return bytes([COMPACT]) + head + _ints(degrees, 2) + np.packbits(finals, bitorder="little").tobytes() + edges
    return head + _ints(np.cumsum([0, *degrees])[:-1], idx) + finals.tobytes() + edges


def read_automaton(blob: bytes, compact: bool = False, idx: int = 4) -> list[State]:
    """The states; labels ascend, targets exist, and no path comes back to where it was."""
    part = _Cursor(blob)
    if compact and part.int(1) != COMPACT:
        raise ValueError("another first byte")
    n, total = part.ints(2, idx)
    if compact:
        starts = np.cumsum([0, *part.ints(n, 2)]).tolist()
        finals = np.unpackbits(np.frombuffer(part.take(-(-n // 8)), np.uint8), bitorder="little")[:n].tolist()
    else:
        starts, finals = [*part.ints(n, idx), total], list(part.take(n))
    edges = [(part.int(1), part.int(idx)) for _ in range(min(total, len(blob)))]
    states = [(bool(f), edges[a:b]) for f, a, b in zip(finals, starts, starts[1:])]
    waiting = [0] * n
    for _, e in states:
        if any(a >= b for (a, _), (b, _) in zip(e, e[1:])) or any(to >= n for _, to in e):
            raise ValueError("labels descend, or a target is missing")
        for _, to in e:
            waiting[to] += 1
    free = [i for i, w in enumerate(waiting) if not w]
    for at in free:
        for _, to in states[at][1]:
            waiting[to] -= 1
            if not waiting[to]:
                free.append(to)
    if not n or len(free) != n:
        raise ValueError("no states, or a cycle")
    return _same(blob, pack_automaton(states, compact, idx), states)


def follow(states: list[State], word: bytes) -> int | None:
    """The state that word leads to from the root."""
    at: int | None = 0
    for c in word:
        if at is None:
            return None
        at = dict(states[at][1]).get(c)
    return at


def accepts(states: list[State], word: bytes) -> bool:
    at = follow(states, word)
    return at is not None and states[at][0]


def pack_lengths(lengths: list[int], field: int = 4, head: int = 16) -> bytes:
    """Prefix code table: symbols up to the last one with a code, and their code lengths."""
    used = max((s + 1 for s, n in enumerate(lengths) if n), default=0)
    if used >> head or any(n >> field for n in lengths):
        raise ValueError("too many symbols, or too long codes")
    out = BitWriter()
    for value, n in [(used, head), *((n, field) for n in lengths[:used])]:
        out.write(value, n)
    return out.finish()


def read_lengths(blob: bytes, symbols: int = 256, field: int = 4, head: int = 16) -> list[int]:
    """Code lengths by symbol; ValueError also where no prefix code has them."""
    part = BitReader(blob)
    try:
        used = part.read(head)
        if used > symbols:
            raise ValueError("more symbols than there are")
        lengths = [part.read(field) for _ in range(used)] + [0] * (symbols - used)
    except EOFError as e:
        raise ValueError("the blob ends early") from e
    if sum(1 << (64 - n) for n in lengths if n) > 1 << 64:
        raise ValueError("no prefix code has these lengths")
    return _same(blob, pack_lengths(lengths, field, head), lengths)


def pack_merges(merges: list[tuple[int, int]], count: int = 2, sym: int = 2) -> bytes:
    """Merge count, then the left and right symbol of each merge in order."""
    return _ints([len(merges)], count) + _ints([s for m in merges for s in m], sym)


def read_merges(blob: bytes, count: int = 2, sym: int = 2) -> list[tuple[int, int]]:
    part = _Cursor(blob)
    flat = part.ints(2 * part.int(count), sym)
    merges = list(zip(flat[::2], flat[1::2]))
    return _same(blob, pack_merges(merges, count, sym), merges)


def pack_rotations(last: bytes, row: int, idx: int = 4) -> bytes:
    """Row of the block among its sorted rotations, then their last column."""
    if not 0 <= row < len(last):
        raise ValueError("no such row")
    return _ints([row], idx) + last


def read_rotations(blob: bytes, idx: int = 4) -> tuple[bytes, int]:
    part = _Cursor(blob)
    row, last = part.int(idx), part.rest()
    return _same(blob, pack_rotations(last, row, idx), (last, row))


def pack_rans(block: bytes, freqs: list[int], scale_bits: int = 12) -> bytes:
    """State, words, scale, symbols, frequencies, then 16-bit words in the order of decoding. The word count has 16 bits
    and a frequency too, so longer texts go in several blocks."""
    if not block or not 2 <= scale_bits <= 15:
        raise ValueError("an empty block, or a scale outside 2 to 15")
    payload = entropy_codes.rans_encode(block, freqs, scale_bits)
    state, words = payload[:4], payload[6:]
    return state + _ints([len(words) // 2, scale_bits], 2) + _ints([len(freqs)], 4) + _ints(freqs, 2) + words


def read_rans(blob: bytes, count: int) -> bytes:
    """count symbols of a blob by pack_rans()."""
    part = _Cursor(blob)
    state, words, scale_bits, symbols = part.take(4), part.int(2), part.int(2), part.int(4)
    freqs = part.ints(symbols, 2)
    if part.at + 2 * words != len(blob) or not 2 <= scale_bits <= 15:
        raise ValueError("another number of words, or a scale outside 2 to 15")
    return entropy_codes.rans_decode(state + struct.pack("<H", scale_bits) + part.rest(), freqs, count)


def pack_tans(block: bytes, freqs: list[int], scale_bits: int = 10) -> bytes:
    """State, bits, scale, symbols, frequencies, then the bits in the order of decoding."""
    if not block:
        raise ValueError("an empty block")
    state, bits = entropy_codes.tans_encode(block, freqs, scale_bits)
    data = np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()
    return _ints([state, len(bits)], 4) + _ints([scale_bits], 2) + _ints([len(freqs)], 4) + _ints(freqs, 2) + data


def read_tans(blob: bytes, count: int) -> bytes:
    """count symbols of a blob by pack_tans()."""
    part = _Cursor(blob)
    (state, n), scale_bits, symbols = part.ints(2, 4), part.int(2), part.int(4)
    freqs = part.ints(symbols, 2)
    data = part.rest()
    if len(data) != -(-n // 8) or scale_bits > 16 or state >= 1 << scale_bits:
        raise ValueError("another number of bits, or a state outside the table")
    bits = "".join(format(b, "08b") for b in data)[:n]
    return entropy_codes.tans_decode(state, bits, freqs, scale_bits, count)


def valid(read: Callable[..., Any], blob: bytes | None, **sizes: int) -> bool | None:
    """Whether read takes the blob; null for null."""
    if blob is None:
        return None
    try:
        read(blob, **sizes)
    except ValueError:
        return False
    return True
