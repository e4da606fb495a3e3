"""Ordered trees in breadth-first order: navigation from degrees alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators.sequence import running_sum
from symweave.sources.scratch import removed, written


def tree_index(degrees: DataFrame) -> DataFrame:
    """(node, degree, first_child, last_child, is_leaf) from (node, degree); children are null for leaves.

    Raises ValueError unless the degrees are those of one tree: their sum is one less than the nodes, and every node
    but the last leaves a child to come.
    """
    summed = running_sum(degrees, ["node"], F.col("degree"), "before")
    n, total, broken = summed.agg(F.count("*"), F.sum("degree"), F.sum((F.col("before") + F.col("degree") < F.col("node") + 1).cast("int"))).first()
    if not n or total != n - 1 or broken > 1:
        raise ValueError("these degrees are not a tree")
    first = F.when(F.col("degree") > 0, F.col("before") + 1)
    return summed.select("node", "degree", first.alias("first_child"), (first + F.col("degree") - 1).alias("last_child"), (F.col("degree") == 0).alias("is_leaf"))


def parents(index: DataFrame) -> DataFrame:
    """(node, parent); the root has null. Children of one parent follow each other, and parents ascend with them: the
    r-th first child up to a node stands for the r-th inner node. No list of children is made, however many there are."""
    inner = index.where("not is_leaf").select("node", "first_child")
    ranked = running_sum(inner, ["node"], F.lit(1).cast("long"), "_r").select((F.col("_r") + 1).alias("_rank"), F.col("node").alias("parent"))
    firsts = inner.select(F.col("first_child").alias("_f"))
    flagged = index.select("node").join(firsts, F.col("node") == F.col("_f"), "left").select("node", F.col("_f").isNotNull().cast("long").alias("_is_first"))
    upto = running_sum(flagged, ["node"], F.col("_is_first"), "_before").select("node", (F.col("_before") + F.col("_is_first")).alias("_upto"))
    return upto.join(ranked, F.col("_upto") == F.col("_rank"), "left").select("node", "parent")


def siblings(index: DataFrame) -> DataFrame:
    """(node, next_sibling, prev_sibling) from tree_index(): the next and last number, unless a family begins there."""
    firsts = index.where("not is_leaf").select(F.col("first_child").alias("_f"))
    n = index.count()
    found = index.select("node").join(firsts, F.col("node") == F.col("_f"), "left").withColumnRenamed("_f", "_own")
    found = found.join(firsts, F.col("node") + 1 == F.col("_f"), "left")
    inside = F.col("node") > 0
    after = F.when(inside & (F.col("node") + 1 < n) & F.col("_f").isNull(), F.col("node") + 1)
    return found.select("node", after.alias("next_sibling"), F.when(inside & F.col("_own").isNull(), F.col("node") - 1).alias("prev_sibling"))


def child_at(index: DataFrame, k: int) -> DataFrame:
    """(node, child): the k-th child from 0, or null."""
    return index.select("node", F.when(F.col("degree") > k, F.col("first_child") + k).alias("child"))


def depth_and_size(parent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, depth) and (node, subtree_size), by pointer doubling: a tree of depth d takes log2(d) rounds.

    After round k a node knows its 2^k-th ancestor, the steps to it or the root, and the nodes less than 2^k below; those
    of the nodes exactly 2^k below are added next. A parent with very many children is pre-aggregated.
    """
    up = F.col("parent")
    now = written(parent.select("node", up.alias("up"), up.isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")))
    while now.where("up is not null").limit(1).count():
        far = now.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        below = now.where("up is not null").groupBy(F.col("up").alias("_b")).agg(F.sum("size").alias("_s"))
        further = now.join(far, F.col("up") == F.col("_n"), "left").join(below, F.col("node") == F.col("_b"), "left")
        later = written(further.select("node", F.col("_u").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size")))
        removed(now)
        now = later
    return now.select("node", "depth"), now.select("node", F.col("size").alias("subtree_size"))
