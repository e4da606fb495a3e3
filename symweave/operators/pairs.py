"""Byte-pair merges learned from a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _merged(tokens: np.ndarray, row: np.ndarray, left: int, right: int, token: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' tokens one after another, with every (left, right) of one row, from the left and without overlap, as token."""
    hit = np.flatnonzero((tokens[:-1] == left) & (tokens[1:] == right) & (row[:-1] == row[1:]))
    if left == right and len(hit):  # of a run of overlapping ones, every other
        run = np.concatenate([[0], np.cumsum(np.diff(hit) != 1)])
        hit = hit[(np.arange(len(hit)) - np.searchsorted(run, run)) % 2 == 0]
    if not len(hit):
        return tokens, row
    tokens, keep = tokens.copy(), np.ones(len(tokens), bool)
    tokens[hit], keep[hit + 1] = token, False
    return tokens[keep], row[keep]


def pair_counts(docs: DataFrame, text: str, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(l, r, n): adjacent pairs within each text's tokens by merges, overlapping ones counted; summed in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t or "").encode() for t in batch.column(0).to_pylist()]
            tokens = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
            for merge in merges:
                tokens, row = _merged(tokens, row, *merge)
            same = row[:-1] == row[1:]
            pairs, n = np.unique((tokens[:-1] << 32 | tokens[1:])[same], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n, pa.int64())], ["l", "r", "n"])

    return docs.select(text).mapInArrow(count, "l bigint, r bigint, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n"))


def learn_merges(docs: DataFrame, text: str, merges: int, least: int = 2) -> list[tuple[int, int, int]]:
    """(left, right, token) in order: each round merges the most frequent pair, of several the smallest; tokens from
    256. A round is one aggregate over the texts, with the merges so far applied anew, so that nothing is kept between
    rounds; one row comes to the driver."""
    found: list[tuple[int, int, int]] = []
    for i in range(merges):
        best = pair_counts(docs, text, list(found)).orderBy(F.desc("n"), "l", "r").first()
        if best is None or best["n"] < max(1, least):
            break
        found.append((best["l"], best["r"], 256 + i))
    return found


def apply_merges(block: bytes, merges: list[tuple[int, int, int]]) -> list[int]:
    """The block's tokens: each merge in order, from the left and without overlap."""
    tokens = list(block)
    for left, right, token in merges:
        if left not in tokens or right not in tokens:
            continue
        out, at = [], 0
        while at < len(tokens):
            hit = tokens[at] == left and at + 1 < len(tokens) and tokens[at + 1] == right
            out.append(token if hit else tokens[at])
            at += 1 + hit
        tokens = out
    return tokens


def expand_tokens(tokens: list[int], merges: list[tuple[int, int, int]]) -> bytes:
    """The inverse of apply_merges(); ValueError for a token that no merge made."""
    spelled = {i: bytes([i]) for i in range(256)}
    for left, right, token in merges:
        spelled[token] = spelled[left] + spelled[right]
    try:
        return b"".join(spelled[t] for t in tokens)
    except KeyError as e:
        raise ValueError("a token that no merge made") from e
