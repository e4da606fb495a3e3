"""Block functions under names that Spark SQL knows, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from symweave.functions import blobs
from symweave.operators import transforms


def _each(fn, kind: str):
    @pandas_udf(kind)
    def run(block: pd.Series) -> pd.Series:
        return block.map(lambda b: None if b is None else fn(bytes(b)))

    return run


def _unsorted(last: pd.Series, row: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or pd.isna(i) else transforms.unsort_rotations(bytes(b), int(i)) for b, i in zip(last, row)])


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session and gives their names: sw_bwt_last, sw_bwt_row, sw_bwt_inverse, sw_mtf,
    sw_mtf_inverse, sw_leb128_valid. Null gives null; empty blocks have no rotations and fail."""
    found = {
        "sw_bwt_last": _each(lambda b: transforms.sort_rotations(b)[0], "binary"),
        "sw_bwt_row": _each(lambda b: transforms.sort_rotations(b)[1], "bigint"),
        "sw_bwt_inverse": pandas_udf(_unsorted, "binary"),
        "sw_mtf": _each(transforms.move_to_front, "binary"),
        "sw_mtf_inverse": _each(transforms.move_from_front, "binary"),
        "sw_leb128_valid": _each(blobs.is_leb128, "boolean"),
    }
    for name, fn in found.items():
        spark.udf.register(name, fn)
    return list(found)
