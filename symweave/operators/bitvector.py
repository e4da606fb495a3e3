"""Bit vectors and symbol sequences: rank, select, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators.sequence import RANGES, running_sums, with_range


def bit_index(df: DataFrame, order: str, bit: str = "bit", ranges: int = RANGES) -> DataFrame:
    """(pos, bit, rank1, rank0): the vector in the order of a unique column, with ones and zeros before each place."""
    rows = df.select(F.col(order).alias("_o"), F.col(bit).cast("int").alias("bit"))
    ranked = running_sums(rows, ["_o"], {"pos": F.lit(1).cast("long"), "rank1": F.col("bit").cast("long")}, ranges)
    return ranked.select("pos", "bit", "rank1", (F.col("pos") - F.col("rank1")).alias("rank0"))


def rank_at(index: DataFrame, probes: DataFrame, probe: str) -> DataFrame:
    """Adds rank1 and rank0 at each probed position, which is clamped to the length; an empty vector gives 0."""
    n, ones = index.agg(F.count("*"), F.coalesce(F.sum("bit"), F.lit(0))).first()
    found = probes.join(index.select(F.col("pos").alias("_p"), "rank1", "rank0"), F.col(probe) == F.col("_p"), "left").drop("_p")
    return found.withColumn("rank1", F.coalesce("rank1", F.lit(ones))).withColumn("rank0", F.coalesce("rank0", F.lit(n - ones)))


def ones_between(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds ones to ranges (start, stop): the one bits from start to before stop, both clamped to the length."""
    upto = rank_at(index, ranges.select(F.col("start").alias("_at")).union(ranges.select("stop")).distinct(), "_at").select("_at", "rank1")
    first, last = upto.toDF("_a", "_ra"), upto.toDF("_b", "_rb")
    found = ranges.join(first, F.col("start") == F.col("_a")).join(last, F.col("stop") == F.col("_b"))
    return found.select(*ranges.columns, F.greatest(F.col("_rb") - F.col("_ra"), F.lit(0)).alias("ones"))


def select_at(index: DataFrame, probes: DataFrame, probe: str, bit: int = 1) -> DataFrame:
    """Adds pos: where the probe-th one (or zero) is, the length if there are fewer."""
    n = index.count()
    rank = "rank1" if bit else "rank0"
    places = index.where(F.col("bit") == bit).select(F.col(rank).alias("_i"), "pos")
    return probes.join(places, F.col(probe) == F.col("_i"), "left").select(*probes.columns, F.coalesce("pos", F.lit(n)).alias("pos"))


def symbol_index(df: DataFrame, order: str, symbol: str, ranges: int = RANGES) -> DataFrame:
    """(pos, sym, occ): the sequence with, for each place, how often its symbol came before.

    Occurrences are summed by range and symbol first: a symbol with most of the rows is still spread over the ranges.
    """
    dealt = with_range(df.select(F.col(order).alias("_o"), F.col(symbol).alias("sym")), "_o", ranges)
    totals = dealt.groupBy("_range", "sym").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("sym").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_symbol = totals.select(F.col("_range").alias("_r"), F.col("sym").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = totals.groupBy("_range").agg(F.sum("_n").alias("_m")).select(F.col("_range").alias("_q"), F.coalesce(F.sum("_m").over(first), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_o")) - 1
    inside = F.row_number().over(Window.partitionBy("_range", "sym").orderBy("_o")) - 1
    joined = dealt.withColumn("_place", place).withColumn("_local", inside).join(F.broadcast(of_range), F.col("_range") == F.col("_q"))
    joined = joined.join(of_symbol, (F.col("_range") == F.col("_r")) & F.col("sym").eqNullSafe(F.col("_s")))
    return joined.select((F.col("_first") + F.col("_place")).alias("pos"), "sym", (F.col("_start") + F.col("_local")).alias("occ"))


def symbol_rank(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds rank to probes (sym, at): occurrences of sym before place at. As-of within each symbol, by one window."""
    kept = index.select("sym", F.col("pos").alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_row"))
    asked = probes.withColumn("_row", F.monotonically_increasing_id())
    both = kept.unionByName(asked.select("sym", "at", F.lit(0).alias("_kind"), "_row"))
    ranked = running_sum_by(both, "sym", ["at", "_kind"])
    return ranked.where("_kind = 0").select("sym", "at", F.col("_sum").alias("rank"))


def running_sum_by(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """df with _sum: rows of _kind 1 before this one, by key, in two phases as running_sum()."""
    dealt = with_range(df, by[0])
    totals = dealt.groupBy("_range", key).agg(F.sum("_kind").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_range").alias("_r"), F.col(key).alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_kind").over(inside), F.lit(0))
    joined = dealt.withColumn("_local", local).join(starts, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("_sum", F.col("_start") + F.col("_local")).drop("_range", "_r", "_k", "_start", "_local")


def symbol_select(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds pos to probes (sym, i): the place of the i-th occurrence of sym, the length if there are fewer."""
    n = index.count()
    places = index.select(F.col("sym").alias("_s"), F.col("occ").alias("_i"), "pos")
    return probes.join(places, (F.col("sym") == F.col("_s")) & (F.col("i") == F.col("_i")), "left").select("sym", "i", F.coalesce("pos", F.lit(n)).alias("pos"))
