"""Sorted integers: indexes, successor and predecessor as as-of joins, split high and low bits, block-wise deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators.sequence import row_index, running_sum


def sorted_index(df: DataFrame, value: str, ties: list[str] | None = None) -> DataFrame:
    """(idx, v): values in ascending order with their 0-based place."""
    rows = df.select(F.col(value).cast("long").alias("v"), *(F.col(t) for t in ties or []))
    return row_index(rows, ["v", *(ties or [])], "idx").select("idx", "v")


def as_of(values: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, successor, predecessor): the first index with v >= probe and the last with v <= probe, else the count.

    values: idx, v; probes: probe. Both are merged in one order and counted in two phases, without a range join: a
    probe comes before equal values for the successor and after them for the predecessor.
    """
    n = values.count()
    probes = probes.select("probe").distinct()
    kinds = F.explode(F.array(F.lit(0), F.lit(2))).alias("kind")
    each = values.groupBy("v").agg(F.count("*").alias("n"))  # a value with very many ties is one row
    both = each.select("v", F.lit(1).alias("kind"), "n").unionByName(probes.select(F.col("probe").alias("v"), kinds, F.lit(0).cast("long").alias("n")))
    counted = running_sum(both, ["v", "kind"], F.col("n"), "before").where("kind <> 1")
    sides = counted.groupBy(F.col("v").alias("probe")).agg(F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("successor"), F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("upto"))
    return sides.select("probe", "successor", F.when(F.col("upto") == 0, n).otherwise(F.col("upto") - 1).alias("predecessor"))


def low_bits(n: int, largest: int) -> int:
    """Width of the low part: floor(log2(universe div n)), 0 if that is at most 1; the universe is one past the largest."""
    share = (largest + 1) // max(n, 1)
    return share.bit_length() - 1 if share > 1 else 0


def split_parts(index: DataFrame, width: int) -> DataFrame:
    """(idx, v, low, high_pos): the low bits, and where the one-bit of the high part stands."""
    low = F.col("v").bitwiseAND(F.lit((1 << width) - 1))
    return index.select("idx", "v", low.alias("low"), (F.shiftright("v", width) + F.col("idx")).alias("high_pos"))


def deltas(index: DataFrame, block: int = 64) -> DataFrame:
    """(idx, v, block, anchor, delta): differences within blocks; the first of a block is its anchor and has none."""
    if block <= 0:
        raise ValueError("block size must be positive")
    rows = index.withColumn("block", F.expr(f"idx div {block}"))
    w = Window.partitionBy("block").orderBy("idx")
    return rows.select("idx", "v", "block", F.first("v").over(w).alias("anchor"), (F.col("v") - F.lag("v").over(w)).alias("delta"))


def restored(encoded: DataFrame) -> DataFrame:
    """(idx, v): anchors plus running deltas of their block."""
    w = Window.partitionBy("block").orderBy("idx")
    return encoded.select("idx", (F.col("anchor") + F.sum(F.coalesce("delta", F.lit(0))).over(w)).alias("v"))


def leb128_length(value: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def leb128_hex(value: Column) -> Column:
    """The LEB128 bytes of a number below 2^63, as hex: 7-bit groups, least first, the top bit on all but the last."""
    n = leb128_length(value)
    group = lambda i: F.floor(value / F.pow(F.lit(128), i)).cast("long").bitwiseAND(127)
    byte = lambda i: F.lpad(F.hex(group(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), byte), "")


def leb128_value(encoded: Column) -> Column:
    """The number below 2^63 that hex bytes encode, or null where they aren't one whole number of at most nine bytes."""
    count = F.floor(F.length(encoded) / 2)
    byte = lambda i: F.conv(F.substring(encoded, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    place = F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0)).cast("long"))
    digits = F.transform(place, lambda i: byte(i.cast("int")))
    ends = F.transform(place, lambda i: (byte(i.cast("int")) < 128) == (i == count - 1))
    total = F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda a, d: F.shiftleft(a, 7) + d.bitwiseAND(127))
    sound = (F.length(encoded) > 0) & (F.length(encoded) % 2 == 0) & (count <= 9) & F.forall(ends, lambda e: e) & F.when(count > 1, F.element_at(digits, -1) > 0).otherwise(True)
    return F.when(sound, total)
