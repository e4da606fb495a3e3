"""What Python workers get and hold at a time: Arrow batches of bounded size, texts as bytes, counts that are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Size of the Arrow batches that Spark hands to Python workers.
BATCH_BYTES = "4m"
#: Numbers that are counted at a time.
PIECE = 1 << 18
#: Rows of counts that a worker keeps, so that it gives each value seldom.
KEPT = 1 << 19
#: Numbers that an array of few numbers counts as.
LEAST = 64


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python workers in Arrow batches of BATCH_BYTES from now on: Spark's default of 64 MB
    takes much of an executor's memory where all its cores have one. A session's own setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def bodies(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without a copy; none for null."""
    for value in column:
        yield np.frombuffer(value.as_buffer() if value.is_valid else b"", np.uint8)


def _merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values in order with the sums of their counts."""
    if len(tables) == 1:
        return tables[0]
    values, n = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(n, first)


def tallied(numbers: Iterator[tuple[str | None, np.ndarray]], piece: int = PIECE, kept: int = KEPT) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, places in keys, values, counts) of the numbers of each key; a value may come again with a further count.

    Numbers wait until there are piece of them; their counts are kept and merged until kept rows do not get fewer by that.
    """
    waiting: dict[str | None, list[np.ndarray]] = {}
    tables: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    n_waiting = n_rows = 0

    def count() -> int:
        more = 0
        for key, parts in waiting.items():
            tables.setdefault(key, []).append(np.unique(np.concatenate(parts), return_counts=True))
            more += len(tables[key][-1][0]) + LEAST
        waiting.clear()
        return more

    def merge() -> int:
        for key, parts in tables.items():
            tables[key] = [_merged(parts)]
        return sum(len(parts[0][0]) + LEAST for parts in tables.values())

    def given() -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        keys, found = list(tables), [parts[0] for parts in tables.values()]
        tables.clear()
        return keys, np.repeat(np.arange(len(keys)), [len(v) for v, _ in found]), *(np.concatenate(x) for x in zip(*found, strict=True))

    for key, part in numbers:
        waiting.setdefault(key, []).append(part)
        n_waiting += len(part) + LEAST
        if n_waiting >= piece:
            n_rows, n_waiting = n_rows + count(), 0
            if n_rows >= kept and (n_rows := merge()) > kept // 2:
                yield given()
                n_rows = 0
    count()
    if tables:
        merge()
        yield given()
