"""Ordered sequences: global running sums in two phases, row indexes, and counted byte grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators.batches import PIECE, bodies, bounded, tallied

#: Ranges that a global order is cut into; the table of their totals has no more rows than this.
RANGES = 64


#: Strings that are looked at, in the mean, to cut an order of strings into ranges.
SAMPLED_STRINGS = 4096

#: Rows of counts in a batch that a Python worker gives back.
ROWS = 1 << 16


def _cuts(df: DataFrame, by: str, ranges: int) -> list:
    """Values that cut the order of a column into ranges of like shares: approximate quantiles, of strings those of a
    sample by hash. They decide where rows go, never what comes out."""
    if df.schema[by].dataType.simpleString() != "string":
        return sorted(set(df.select(F.percentile_approx(F.col(by), [i / ranges for i in range(1, ranges)], 1000).alias("q")).first()["q"] or []))
    n = df.count()
    part = F.pmod(F.xxhash64(by), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLED_STRINGS / max(n, 1))))
    seen = sorted((r[0] for r in df.select(by).where(F.col(by).isNotNull() & part).distinct().limit(4 * SAMPLED_STRINGS).collect()), key=str.encode)
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}, key=str.encode) if seen else []


def with_range(df: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """df with _range: the number of cuts of by that are at or below it, so that ranges hold like shares."""
    cuts = _cuts(df, by, ranges)
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    bounds = F.array(*(F.lit(c) for c in cuts))
    return df.withColumn("_range", F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(by))), F.lit(0)))


def running_sums(df: DataFrame, by: list[str], values: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """df with a column for each of values: its sum over all rows before this one in the order of by (ascending, total).

    Rows are dealt by ranges of the first column; all sums run within a range in one pass, and each range's starts come
    from a table of at most as many rows as there are ranges. No task sees all rows, unlike with an unpartitioned window.
    """
    dealt = with_range(df.withColumns({f"_v_{k}": v for k, v in values.items()}), by[0], ranges)
    totals = dealt.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in values))
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *(F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)).alias(f"_l_{k}") for k in values))
    joined = local.join(F.broadcast(starts), "_range")
    return joined.select(*df.columns, *((F.col(f"_s_{k}") + F.col(f"_l_{k}")).alias(k) for k in values))


def running_sum(df: DataFrame, by: list[str], value: Column, out: str, ranges: int = RANGES) -> DataFrame:
    """df with out: the sum of value over all rows before this one, as running_sums()."""
    return running_sums(df, by, {out: value}, ranges)


def row_index(df: DataFrame, by: list[str], out: str = "idx", ranges: int = RANGES) -> DataFrame:
    """df with out: the 0-based place of each row in the order of by."""
    return running_sum(df, by, F.lit(1).cast("long"), out, ranges)


def gram_counts(df: DataFrame, group: str, text: str, size: int) -> DataFrame:
    """(group, gram, n): occurrences of each run of size bytes (1 to 7, packed big-endian) within single texts.

    Counted in pieces with sorted arrays, whose counts are merged and summed; what is shuffled is distinct grams, not bytes.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, np.ndarray]]:
        for batch in batches:
            for key, b in zip(batch.column(0).to_pylist(), bodies(batch.column(1)), strict=True):
                for at in range(0, len(b) - size + 1, PIECE):
                    part = b[at : at + PIECE + size - 1].astype(np.int64)
                    gram = np.zeros(len(part) - size + 1, np.int64)
                    for k in range(size):
                        gram = gram * 256 + part[k : len(part) - size + 1 + k]
                    yield key, gram

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, values, n in tallied(grams(batches)):
            names = pa.array(keys, pa.string())
            for at in range(0, len(values), ROWS):
                part = slice(at, at + ROWS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(places[part])), pa.array(values[part]), pa.array(n[part], pa.int64())], ["grp", "gram", "n"])

    counted = bounded(df.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("body"))).mapInArrow(count, "grp string, gram bigint, n bigint")
    return counted.groupBy("grp", "gram").agg(F.sum("n").alias("n")).withColumnRenamed("grp", group)


def _top_code_point(b: np.ndarray) -> int:
    """The largest code point of UTF-8: the largest byte leads it, and only what that byte leads is decoded."""
    lead, top = int(b.max()), 0
    if lead < 0x80:
        return lead
    more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
    for start in range(0, len(b), PIECE):
        at = np.flatnonzero(b[start : start + PIECE] == lead) + start
        code = np.full(len(at), lead & (0x3F >> more), np.int64)
        for k in range(1, more + 1):
            code = code << 6 | b.take(at + k, mode="clip") & 0x3F
        top = max(top, int(code.max(initial=0)))
    return top


def top_code_points(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, code): the largest code point of the texts of each batch and group, so that a group may come again; none for
    groups without characters."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top: dict[str | None, int] = {}
            for key, b in zip(batch.column(0).to_pylist(), bodies(batch.column(1)), strict=True):
                if len(b):
                    top[key] = max(top.get(key, 0), _top_code_point(b))
            yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.string()), pa.array(list(top.values()), pa.int64())], ["grp", "code"])

    rows = bounded(df.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("body")))
    return rows.mapInArrow(find, "grp string, code bigint").withColumnRenamed("grp", group)
