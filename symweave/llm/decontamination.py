"""Benchmark decontamination: MinHash containment search for short items inside long documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import BROADCAST_ROWS, forget, small_enough, stored, unused


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Distinct runs of so many words, one space apart; empty if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    runs = F.transform(at, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of so many words, in their order; empty if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(at, lambda i: F.xxhash64(F.lit(width), *(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """(item_id, item_key, width, n, shingles, hashes) of each different item with words; the widths below width.

    Items of fewer than width words are one shingle of their own length.
    """
    found = items.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    short = sorted(r[0] for r in found.where(F.size("w") < width).select(F.size("w")).distinct().collect())
    shingles, hashes = shingles_of(F.col("w"), width), hashes_of(F.col("w"), width)
    for n in short:
        shingles = F.when(F.size("w") == n, shingles_of(F.col("w"), n)).otherwise(shingles)
        hashes = F.when(F.size("w") == n, hashes_of(F.col("w"), n)).otherwise(hashes)
    sets = found.select("item_id", F.least(F.size("w"), F.lit(width)).alias("width"), shingles.alias("shingles"), hashes.alias("hashes"))
    sets = sets.withColumn("shingles", F.array_sort("shingles")).dropDuplicates(["item_id", "shingles"])
    return sets.select("item_id", F.xxhash64("item_id", "shingles").alias("item_key"), "width", F.size("shingles").cast("long").alias("n"), "shingles", "hashes"), short


def item_sketches(sets: DataFrame, containment: float) -> DataFrame:
    """(item_key, h): the MinHash sketch of each item, its k smallest hashes under a permutation.

    Items are put in size partitions by the power of two of their shingle count; k is fixed by the partition's upper
    bound so that it exceeds the share of an item's shingles that a match may lack. A document that contains the item
    at the threshold must then hold one of them, so that the sketch loses no match.
    """
    upper = F.pow(F.lit(2), F.length(F.bin("n")))
    k = (F.floor((1 - containment) * upper + 1e-9) + 1).cast("int")
    ordered = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(7)).alias("p"), h.alias("h"))))
    return sets.select("item_key", F.explode(F.slice(ordered, F.lit(1), k)).alias("x")).select("item_key", F.col("x.h").alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5) -> DataFrame:
    """Items found in documents: doc_id, text_hash, item_id, n_shingles, n_shared, containment.

    A pair is given if the document holds at least that share of the item's distinct word shingles. Candidates are
    documents that hold a hash of the item's sketch; the shingles themselves of both texts confirm them. A passage that
    very many documents share gives one candidate a document.

    Each distinct text of a doc_id is a document of its own; repeated rows and repeated items count once. Null, empty
    and word-less texts hold nothing, and as items are nowhere. Texts are read whole, however long. A pair exactly at the
    threshold is given; there are no other ties. An empty table on either side gives no rows. Other columns, whatever
    their names, have no part. Sketches and candidates are broadcast only up to a checked number of rows and joined by
    shuffle beyond it.
    """
    sets, short = item_sets(items.select("item_id", "text"), width)
    sets = stored(sets)
    sketches = small_enough(stored(item_sketches(sets, containment)))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    words = words_of(F.col("text"))
    hashes = docs.select("doc_id", "text_hash", words.alias("w"))
    hashes = hashes.select("doc_id", "text_hash", F.explode(F.concat(hashes_of(F.col("w"), width), *(hashes_of(F.col("w"), n) for n in short))).alias("h"))
    candidates = stored(hashes.join(sketches, "h").select("doc_id", "text_hash", "item_key").distinct())
    of_doc = small_enough(candidates.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), 500_000)
    texts = docs.join(of_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), words_of(F.col("text")).alias("w"))
    widths = F.array(*(F.struct(F.lit(n).alias("width"), shingles_of(F.col("w"), n).alias("s")) for n in [width, *short]))
    texts = texts.select("_d", "_h", F.inline(widths)).withColumnRenamed("width", "_w")
    pairs = candidates.join(sets if sets.limit(BROADCAST_ROWS // 20 + 1).count() > BROADCAST_ROWS // 20 else F.broadcast(sets), "item_key")
    both = pairs.join(texts, F.expr("doc_id <=> _d and text_hash = _h and width = _w"))
    counted = both.select("doc_id", "text_hash", "item_id", "n", F.size(F.array_intersect("s", "shingles")).cast("long").alias("n_shared"))
    counted = counted.where(F.col("n_shared") >= F.lit(containment) * F.col("n") - 1e-9)
    out = stored(counted.select("doc_id", "text_hash", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")))
    forget(candidates, sets)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, width: int = 5) -> DataFrame:
    """docs without the rows whose text holds a benchmark item: all other rows, repeated ones too, and all columns."""
    d, h = unused("_d", docs), unused("_h", docs)
    bad = contaminated(docs, items, containment, width).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    return docs.join(small_enough(bad), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
