"""Reversible transforms of byte blocks: block sorting and move-to-front, many blocks at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symweave.operators.batches import bounded

#: Blocks that map_blocks() hands on at a time.
BLOCKS = 16


def sort_rotations(block: bytes) -> tuple[bytes, int]:
    """Last column of the sorted cyclic rotations and the first row that equals the block, by prefix doubling."""
    s = np.frombuffer(block, np.uint8)
    n = len(s)
    if not n:
        raise ValueError("an empty block has no rotations")
    rank, step = s.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
        if step >= n or rank.max() == n - 1:
            break
    order = np.argsort(rank, kind="stable")
    return s[order - 1].tobytes(), int((rank < rank[0]).sum())


def unsort_rotations(last: bytes, row: int) -> bytes:
    """The block, by following each symbol of the last column to its place in the first."""
    s = np.frombuffer(last, np.uint8)
    if not len(s) or not 0 <= row < len(s):
        raise ValueError("no such row")
    follow = np.argsort(s, kind="stable")
    out, at = np.empty(len(s), np.uint8), int(follow[row])
    steps = follow.tolist()
    for i in range(len(s)):
        out[i] = s[at]
        at = steps[at]
    return out.tobytes()


def move_to_front(block: bytes) -> bytes:
    """Each byte's place in the list of bytes by recency."""
    recent, out = bytearray(range(256)), bytearray()
    for b in block:
        i = recent.index(b)
        out.append(i)
        if i:
            del recent[i]
            recent.insert(0, b)
    return bytes(out)


def move_from_front(places: bytes) -> bytes:
    """The inverse of move_to_front()."""
    recent, out = bytearray(range(256)), bytearray()
    for i in places:
        b = recent[i]
        out.append(b)
        if i:
            del recent[i]
            recent.insert(0, b)
    return bytes(out)


def symbols_to_front(symbols: list[int], alphabet: int = 1 << 16) -> list[int]:
    """move_to_front() for an alphabet of any size."""
    recent: list[int] = []  # symbols seen so far; those not seen keep their order behind them
    out = []
    for s in symbols:
        if not 0 <= s < alphabet:
            raise ValueError("a symbol outside the alphabet")
        i = recent.index(s) if s in recent else s + sum(r > s for r in recent)
        out.append(i)
        if i < len(recent) and recent[i] == s:
            del recent[i]
        recent.insert(0, s)
    return out


def symbols_from_front(places: list[int], alphabet: int = 1 << 16) -> list[int]:
    """The inverse of symbols_to_front()."""
    recent = list(range(alphabet))
    out = []
    for i in places:
        if not 0 <= i < alphabet:
            raise ValueError("a place outside the alphabet")
        out.append(recent[i])
        recent.insert(0, recent.pop(i))
    return out


def map_blocks(df: DataFrame, column: str, out: dict[str, str], fn: Callable[[Any], tuple]) -> DataFrame:
    """df without column, with the columns of out (name: type) that fn gives for each block: bytes, or a list from an array
    column; null for null. A worker has BLOCKS blocks as Python objects at a time."""
    names = [f.name for f in df.schema if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        for batch in (whole.slice(at, BLOCKS) for whole in batches for at in range(0, whole.num_rows, BLOCKS)):
            values = batch.column(column).to_pylist()
            rows = [(None,) * len(out) if v is None else fn(v.encode() if isinstance(v, str) else v) for v in values]
            made = [pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, *out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column]
    return bounded(df).mapInArrow(run, ", ".join([*fields, *(f"`{k}` {t}" for k, t in out.items())]))
