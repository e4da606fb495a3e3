"""Sorted string dictionaries: membership, prefixes, front coding, trie and minimal automaton counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators.sequence import row_index
from symweave.sources.scratch import removed, written


def contains(words: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, found): whether the dictionary (s) has the probe; an equi-join."""
    known = words.select(F.col("s").alias("_s")).distinct()
    return probes.select("probe").distinct().join(known, F.col("probe") == F.col("_s"), "left").select("probe", F.col("_s").isNotNull().alias("found"))


def has_prefix(words: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, found): whether a member starts with the probe. Members' prefixes are cut to the probes' lengths and
    joined by equality; the empty prefix is always there."""
    asked = probes.select("probe").distinct()
    lengths = [r[0] for r in asked.select(F.length("probe").alias("n")).where("n > 0").distinct().collect()]  # a few numbers
    wanted = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("s"))
    cut = words.select("s").distinct().select(F.explode(F.transform(wanted, lambda n: F.substring("s", F.lit(1), n))).alias("_p")).distinct()
    return asked.join(cut, F.col("probe") == F.col("_p"), "left").select("probe", (F.col("_p").isNotNull() | (F.col("probe") == "")).alias("found"))


def find(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, idx): the first index of an equal string, else null."""
    first = index.groupBy("s").agg(F.min("idx").alias("idx"))
    return probes.select("probe").distinct().join(first, F.col("probe") == F.col("s"), "left").select("probe", "idx")


def string_index(df: DataFrame, column: str) -> DataFrame:
    """(idx, s): distinct strings in byte order."""
    rows = df.select(F.col(column).alias("s")).where("s is not null").distinct()
    return row_index(rows, ["s"], "idx").select("idx", "s")


def front_coded(index: DataFrame, bucket: int = 16) -> DataFrame:
    """(idx, s, bucket, shared, suffix): what a string shares with the one before it in its bucket, in characters, and
    the rest. The first of a bucket is whole."""
    if bucket <= 0:
        raise ValueError("bucket size must be positive")
    rows = index.withColumn("bucket", F.expr(f"idx div {bucket}"))
    before = F.lag("s").over(Window.partitionBy("bucket").orderBy("idx"))
    rows = rows.withColumn("_b", F.coalesce(before, F.lit("")))
    same = F.expr("aggregate(sequence(1, greatest(1, least(length(s), length(_b)))), named_struct('n', 0, 'on', true), (a, i) -> named_struct('n', a.n + if(a.on and i <= least(length(s), length(_b)) and substring(s, i, 1) = substring(_b, i, 1), 1, 0), 'on', a.on and i <= least(length(s), length(_b)) and substring(s, i, 1) = substring(_b, i, 1)), a -> a.n)")
    rows = rows.withColumn("shared", same.cast("long"))
    return rows.select("idx", "s", "bucket", "shared", F.expr("substring(s, cast(shared as int) + 1)").alias("suffix"))


def front_coded_bytes(index: DataFrame, bucket: int = 16) -> DataFrame:
    """(idx, s, bucket, shared, suffix) as front_coded(), in bytes of UTF-8: shared counts bytes, suffix is their hex."""
    if bucket <= 0:
        raise ValueError("bucket size must be positive")
    rows = index.withColumn("bucket", F.expr(f"idx div {bucket}")).withColumn("_h", F.hex(F.encode("s", "UTF-8")))
    rows = rows.withColumn("_b", F.coalesce(F.lag("_h").over(Window.partitionBy("bucket").orderBy("idx")), F.lit("")))
    lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_h"), F.length("_b")) / 2).cast("int"))
    differs = F.filter(lengths, lambda i: F.substring("_h", i * 2 - 1, F.lit(2)) != F.substring("_b", i * 2 - 1, F.lit(2)))
    shortest = (F.least(F.length("_h"), F.length("_b")) / 2).cast("long")
    shared = F.when(shortest == 0, 0).when(F.size(differs) > 0, F.get(differs, F.lit(0)) - 1).otherwise(shortest).cast("long")
    return rows.withColumn("shared", shared).select("idx", "s", "bucket", "shared", F.expr("substring(_h, cast(2 * shared as int) + 1)").alias("suffix"))


def front_restored(coded: DataFrame) -> DataFrame:
    """(idx, s): strings rebuilt from their bucket's prefixes and suffixes alone."""
    each = coded.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("idx", "shared", "suffix"))).alias("rows"))
    fold = F.expr("aggregate(rows, cast(array() as array<struct<idx:bigint,s:string>>), (a, r) -> concat(a, array(named_struct('idx', r.idx, 's', concat(if(size(a) = 0, '', substring(element_at(a, -1).s, 1, cast(r.shared as int))), r.suffix)))))")
    return each.select(F.explode(fold).alias("r")).select("r.idx", "r.s")


def trie_counts(words: DataFrame) -> DataFrame:
    """(states, edges) of the prefix tree over bytes: distinct prefixes with the empty one, and one less."""
    hexed = words.select(F.hex(F.encode("s", "UTF-8")).alias("h")).distinct()
    prefixes = hexed.select(F.explode(F.expr("transform(sequence(0, length(h) div 2), i -> substring(h, 1, 2 * i))")).alias("p")).distinct()
    return prefixes.agg(F.count("*").alias("states")).select("states", (F.col("states") - 1).alias("edges"))


def minimal_counts(words: DataFrame) -> DataFrame:
    """(states, edges) of the minimal automaton: prefixes with equal sets of continuations are one state.

    Bottom-up by depth: a state's identity is a hash of whether it is final and of its sorted (byte, child identity)
    pairs. Each depth is one grouped aggregate; the number of rounds is the length of the longest word.
    """
    hexed = words.select(F.hex(F.encode("s", "UTF-8")).alias("h")).distinct()
    deepest = hexed.agg(F.max(F.length("h"))).first()[0] or 0
    prefixes = hexed.select(F.explode(F.expr("transform(sequence(0, length(h) div 2), i -> substring(h, 1, 2 * i))")).alias("p")).distinct()
    states = prefixes.join(hexed.select(F.col("h").alias("p"), F.lit(True).alias("final")), "p", "left").select("p", F.coalesce("final", F.lit(False)).alias("final"))
    states = written(states)
    below, seen = None, []
    for depth in range(deepest, -1, -2):
        now = states.where(F.length("p") == depth)
        if below is None:
            named = now.select("p", F.sha2(F.concat(F.col("final").cast("string"), F.lit("|")), 256).alias("id"), F.lit(0).cast("long").alias("edges"))
        else:
            kids = below.select(F.expr(f"substring(p, 1, {depth})").alias("p"), F.concat(F.expr(f"substring(p, {depth + 1}, 2)"), "id").alias("kid"))
            kids = kids.groupBy("p").agg(F.concat_ws(",", F.array_sort(F.collect_list("kid"))).alias("kids"), F.count("*").alias("edges"))
            named = now.join(kids, "p", "left").select("p", F.sha2(F.concat(F.col("final").cast("string"), F.lit("|"), F.coalesce("kids", F.lit(""))), 256).alias("id"), F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))
        below = written(named)
        seen.append(below)
    whole = written(reduce(DataFrame.unionByName, (x.select("id", "edges").distinct() for x in seen)).distinct()) if seen else None
    for table in [states, *seen]:
        removed(table)
    if whole is None:
        return words.sparkSession.createDataFrame([(0, 0)], "states bigint, edges bigint")
    return whole.agg(F.count("*").alias("states"), F.sum("edges").alias("edges"))
