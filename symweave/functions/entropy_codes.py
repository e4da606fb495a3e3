"""Prefix and range coders of symbol blocks: canonical Huffman codes, rANS and tANS."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Sequence

import numpy as np


def huffman_lengths(freqs: list[int], limit: int = 15) -> list[int]:
    """Code length of each symbol, 0 for those that don't occur; a single symbol gets length 1.

    Merges go by weight, then by age. Lengths beyond the limit are cut to it, the shortest are made longer until the
    code fits, and what room is left goes to the longest; symbols keep their order by length, then frequency.
    """
    active = [(f, s) for s, f in enumerate(freqs) if f]
    lengths = [0] * len(freqs)
    if len(active) == 1:
        lengths[active[0][1]] = 1
        return lengths
    heap = [(f, i, (s,)) for i, (f, s) in enumerate(active)]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        (fa, _, a), (fb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (fa + fb, age, a + b))
        age += 1
    if max(lengths, default=0) > limit:
        order = sorted(active, key=lambda x: (lengths[x[1]], -x[0], x[1]))
        at = Counter(min(n, limit) for n in lengths if n)
        room = (1 << limit) - sum(k << (limit - n) for n, k in at.items())
        while room < 0:
            n = min(n for n, k in at.items() if k and n < limit)
            at[n], at[n + 1], room = at[n] - 1, at[n + 1] + 1, room + (1 << (limit - n - 1))
        for n in range(limit, 1, -1):
            fit = min(at[n], room >> (limit - n))
            at[n], at[n - 1], room = at[n] - fit, at[n - 1] + fit, room - (fit << (limit - n))
        for n, (_, s) in zip(sorted(at.elements()), order, strict=True):
            lengths[s] = n
    return lengths


def canonical_codes(lengths: list[int]) -> list[int]:
    """Consecutive codes in the order of length, then symbol."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def huffman_encode(block: Sequence[int], lengths: list[int]) -> bytes:
    """The block's codes one after another, padded with zero bits; symbols without a code are left out."""
    codes = canonical_codes(lengths)
    bits = "".join(format(codes[b], f"0{lengths[b]}b") for b in block if lengths[b])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""


def _symbols(out: list[int], alphabet: int) -> bytes | list[int]:
    """Symbols of at most eight bits as bytes, wider ones as numbers."""
    return bytes(out) if alphabet <= 256 else out


def huffman_decode(payload: bytes, lengths: list[int], count: int) -> bytes | list[int]:
    """count symbols (as numbers if there are more than 256); ValueError for bits that are no code."""
    table = {(n, c): s for s, (n, c) in enumerate(zip(lengths, canonical_codes(lengths), strict=True)) if n}
    bits, at, out, longest = "".join(format(b, "08b") for b in payload), 0, [], max(lengths, default=0)
    while len(out) < count:
        for n in range(1, longest + 1):
            if at + n <= len(bits) and (s := table.get((n, int(bits[at : at + n], 2)))) is not None:
                out.append(s)
                at += n
                break
        else:
            raise ValueError("these bits are no code")
    return _symbols(out, len(lengths))


def quantise(freqs: list[int], scale_bits: int) -> list[int]:
    """Counts scaled to sum to exactly 2^scale_bits; see operators.stats.quantised_frequencies."""
    scale, total = 1 << scale_bits, sum(freqs)
    active = [s for s, f in enumerate(freqs) if f]
    if not total or len(active) > scale:
        raise ValueError("no symbols, or more than the scale has room for")
    out = [max(1, (f * scale + total // 2) // total) if f else 0 for f in freqs]
    spare = scale - sum(out)
    if spare > 0:
        out[max(active, key=lambda s: (freqs[s], -s))] += spare
    for _ in range(-spare):
        out[max((s for s in active if out[s] > 1), key=lambda s: (out[s], -s))] -= 1
    return out


def _starts(freqs: list[int]) -> list[int]:
    return np.concatenate([[0], np.cumsum(freqs)]).tolist()


def rans_encode(block: Sequence[int], freqs: list[int], scale_bits: int = 12) -> bytes:
    """32-bit state, 16-bit words in the order of decoding; freqs sum to 2^scale_bits. Unseen symbols raise ValueError."""
    start, state, words = _starts(freqs), 1 << 16, []
    for b in reversed(block):
        f = freqs[b]
        if not f:
            raise ValueError("a symbol of frequency 0")
        if state >= f << (32 - scale_bits):
            words.append(state & 0xFFFF)
            state >>= 16
        state = (state // f << scale_bits) + start[b] + state % f
    return struct.pack("<IH", state, scale_bits) + np.array(words[::-1], "<u2").tobytes()


def rans_decode(payload: bytes, freqs: list[int], count: int) -> bytes | list[int]:
    """count symbols of what rans_encode() gave."""
    state, scale_bits = struct.unpack_from("<IH", payload)
    if sum(freqs) != 1 << scale_bits:
        raise ValueError("these frequencies do not fit the payload")
    words, at, start = np.frombuffer(payload, "<u2", offset=6).tolist(), 0, _starts(freqs)
    symbol = np.repeat(np.arange(len(freqs)), freqs).tolist()
    out, mask = [], (1 << scale_bits) - 1
    for _ in range(count):
        slot = state & mask
        s = symbol[slot]
        out.append(s)
        state = freqs[s] * (state >> scale_bits) + slot - start[s]
        if state < 1 << 16:
            if at >= len(words):
                raise ValueError("the payload ends early")
            state = state << 16 | words[at]
            at += 1
    return _symbols(out, len(freqs))


def tans_table(freqs: list[int], scale_bits: int) -> list[tuple[int, int, int]]:
    """(symbol, bits, base) of each state, symbols spread by a step that visits every state."""
    size = 1 << scale_bits
    if sum(freqs) != size:
        raise ValueError("frequencies must sum to the table size")
    step, at, spread = (size >> 1) + (size >> 3) + 3, 0, [0] * size
    taken = [False] * size
    for s, f in enumerate(freqs):
        for _ in range(f):
            while taken[at]:
                at = (at + 1) % size
            spread[at], taken[at] = s, True
            at = (at + step) % size
    seen, out = list(freqs), []
    for s in spread:
        reduced = seen[s]
        seen[s] += 1
        bits = scale_bits - (reduced.bit_length() - 1)
        out.append((s, bits, (reduced << bits) - size))
    return out


def tans_encode(block: Sequence[int], freqs: list[int], scale_bits: int = 10) -> tuple[int, str]:
    """Final state and the bits in the order of decoding."""
    back: dict[int, list[tuple[int, int, int]]] = {}
    for state, (s, bits, base) in enumerate(tans_table(freqs, scale_bits)):
        back.setdefault(s, []).append((base, bits, state))
    slot = {s: {base + k: (state, bits, k) for base, bits, state in rows for k in range(1 << bits)} for s, rows in back.items() if s in set(block)}
    state, out = 0, []
    for b in reversed(block):
        if b not in slot:
            raise ValueError("a symbol of frequency 0")
        state, bits, k = slot[b][state]
        out.append(format(k, f"0{bits}b") if bits else "")
    return state, "".join(reversed(out))


def tans_decode(state: int, bits: str, freqs: list[int], scale_bits: int, count: int) -> bytes | list[int]:
    """count symbols of what tans_encode() gave."""
    table, at, out = tans_table(freqs, scale_bits), 0, []
    for _ in range(count):
        s, n, base = table[state]
        out.append(s)
        if at + n > len(bits):
            raise ValueError("the payload ends early")
        state = base + (int(bits[at : at + n], 2) if n else 0)
        at += n
    return _symbols(out, len(freqs))
