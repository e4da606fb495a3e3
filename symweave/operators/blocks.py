"""Ordered values cut into blocks of bounded size, each serialised by itself."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators.transforms import map_blocks


def in_blocks(index: DataFrame, at: str, value: str, size: int) -> DataFrame:
    """(block, items): the values of size places in a row, in their order, as one array."""
    if size <= 0:
        raise ValueError("block size must be positive")
    rows = index.select(F.expr(f"`{at}` div {size}").alias("block"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("x"))
    return rows.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.v).alias("items"))


def packed(blocks: DataFrame, pack: Callable[[Any], bytes]) -> DataFrame:
    """(block, blob): each block's items by a pack function of functions.blobs."""
    return map_blocks(blocks, "items", {"blob": "binary"}, lambda items: (pack(items),))


def checked(blobs: DataFrame, read: Callable[[bytes], Any]) -> DataFrame:
    """blobs with valid: whether the read function of functions.blobs takes the blob."""
    from symweave.functions.blobs import valid

    return map_blocks(blobs.withColumn("_blob", F.col("blob")), "_blob", {"valid": "boolean"}, lambda blob: (valid(read, bytes(blob)),))


def served(blocks: DataFrame, pack: Callable[[Any], bytes], out: dict[str, str], fn: Callable[[bytes], tuple], read: Callable[[bytes], Any] | None = None) -> DataFrame:
    """(block, valid, out): what map_blocks() by fn gives for packed() blobs, with read also checked(); valid only with read.

    A step of its own for each would take a Python worker for each step in every task.
    """
    from symweave.functions.blobs import valid

    def run(items: Any) -> tuple:
        blob = pack(items)
        return *((valid(read, blob),) if read else ()), *fn(blob)

    return map_blocks(blocks, "items", ({"valid": "boolean"} if read else {}) | out, run)
