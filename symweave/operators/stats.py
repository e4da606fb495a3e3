"""Entropy and conditional frequency models over byte sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.entropy_codes import quantise
from symweave.operators.sequence import gram_counts


def _entropy_of(n: str) -> Column:
    """Entropy in bits of counts, as an aggregate: log2(N) - sum(n log2 n) / N."""
    total = F.sum(n)
    return F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total


def entropy(df: DataFrame, group: str, text: str, order: int = 0) -> DataFrame:
    """(group, h): entropy of the next byte given the order before it.

    Order 1 is the conditional entropy over adjacent pairs; from 2 on, the entropy of (order+1)-grams less that of
    order-grams, which take their own sample counts. 0 for sequences too short.
    """
    if order == 0:
        out = gram_counts(df, group, text, 1).groupBy(group).agg(_entropy_of("n").alias("h"))
    elif order == 1:
        pairs = gram_counts(df, group, text, 2)
        context = Window.partitionBy(group, F.shiftright("gram", 8))
        each = pairs.withColumn("c", F.sum("n").over(context))
        out = each.groupBy(group).agg((F.sum(F.col("n") * F.log2(F.col("c") / F.col("n"))) / F.sum("n")).alias("h"))
    else:
        long, short = (gram_counts(df, group, text, k).groupBy(group).agg(_entropy_of("n").alias(f"h{k}")) for k in (order + 1, order))
        out = short.join(long, group, "left").select(group, (F.coalesce(f"h{order + 1}", F.lit(0.0)) - F.col(f"h{order}")).alias("h"))
    groups = df.select(F.col(group).cast("string").alias(group)).distinct()
    return groups.join(out, groups[group].eqNullSafe(out[group]), "left").select(groups[group], F.coalesce("h", F.lit(0.0)).alias("h"))


def entropy_report(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, h0, h1, total_symbols, unique_symbols, theoretical_min_bytes)."""
    counts = gram_counts(df, group, text, 1).groupBy(group).agg(F.sum("n").alias("total_symbols"), F.count("*").alias("unique_symbols"))
    h0, h1 = entropy(df, group, text, 0).withColumnRenamed("h", "h0"), entropy(df, group, text, 1).withColumnRenamed("h", "h1")
    out = h0.join(h1, group).join(counts, group)
    return out.withColumn("theoretical_min_bytes", F.ceil(F.round(F.col("h0") * F.col("total_symbols") / 8, 6)).cast("long"))


def per_position_entropy(df: DataFrame, text: str) -> DataFrame:
    """(position, h): entropy of the byte at each offset, over the strings that are long enough."""
    byte = F.regexp_extract_all(F.hex(F.encode(F.col(text), "UTF-8")), F.lit("(..)"))
    counts = df.select(F.posexplode(byte).alias("position", "sym")).groupBy("position", "sym").agg(F.count("*").alias("n"))
    return counts.groupBy("position").agg(_entropy_of("n").alias("h")).select(F.col("position").cast("long").alias("position"), "h")


def context_model(df: DataFrame, group: str, text: str, order: int) -> DataFrame:
    """(group, context, sym, freq, total, cum_freq, prob_raw) of an order 0 to 4 model.

    context packs the bytes before sym big-endian (0 at order 0); cum_freq sums the frequencies of smaller symbols in
    the context; prob_raw is the Q16.16 probability, (freq << 16) div total. Texts no longer than order give nothing.
    """
    grams = gram_counts(df, group, text, order + 1)
    rows = grams.select(group, F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("sym"), F.col("n").alias("freq"))
    context = Window.partitionBy(group, "context")
    below = context.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("freq").over(context)).withColumn("cum_freq", F.coalesce(F.sum("freq").over(below), F.lit(0)))
    return rows.withColumn("prob_raw", F.expr("(freq * 65536) div total"))


def symbol_bits(values: Column) -> Column:
    """Bits of the smallest unsigned type that holds the largest of values, as an aggregate; at least 1."""
    return F.greatest(F.lit(1), F.length(F.bin(F.max(values)))).cast("long")


def quantised_frequencies(counts: DataFrame, scale_bits: int) -> DataFrame:
    """(sym, freq, quantised): counts scaled to sum to exactly 2^scale_bits, each at least 1.

    Rounded shares come first. What is missing all goes to the largest count (smallest symbol of several); what is too
    much is taken in single steps from the largest quantised value (smallest symbol of several) above 1. The alphabet
    bounds the table (2^16 rows), so the steps run in one place.
    """
    rows = sorted((r["sym"], r["freq"]) for r in counts.where("freq > 0").collect())
    out = quantise([f for _, f in rows], scale_bits)
    return counts.sparkSession.createDataFrame([(s, f, q) for (s, f), q in zip(rows, out, strict=True)], "sym bigint, freq bigint, quantised bigint")


def context_counts(model: DataFrame, group: str) -> DataFrame:
    """(group, contexts): the different contexts that context_model() saw."""
    return model.groupBy(group).agg(F.count_distinct("context").alias("contexts"))


def cumulative_frequency(model: DataFrame, group: str, probes: DataFrame) -> DataFrame:
    """Adds cum_freq to probes (group, context, sym): the frequencies of smaller symbols in the context, whether or not
    the symbol itself was seen; 0 in a context that was not. At most an alphabet's rows meet for a probe."""
    asked = probes.withColumn("_row", F.monotonically_increasing_id())
    seen = model.select(F.col(group).alias("_g"), F.col("context").alias("_c"), F.col("sym").alias("_s"), "freq")
    met = asked.join(seen, F.col(group).eqNullSafe(F.col("_g")) & (F.col("context") == F.col("_c")) & (F.col("_s") < F.col("sym")), "left")
    return met.groupBy("_row", *probes.columns).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("cum_freq")).drop("_row")
