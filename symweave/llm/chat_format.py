"""Chat formatting: reply trees to conversations with a loss mask, by iterative self-joins. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.common import forget, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    r"""Every "<|" gets a backslash inside, and every "<\...\|" one more, so that no text holds a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def linear_messages(turns: DataFrame) -> DataFrame:
    """Turn-by-turn conversations as reply trees: each turn answers the one before it.

    Turns are ordered by turn, role, text, nulls first, so that ties and repeated rows have a defined place; each row
    stays a message of its own. A null conv_id is a conversation like any other.
    """
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    node = F.row_number().over(order).cast("long")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One message of each (conv_id, node): the first by parent, role, text and score, nulls first."""
    first = F.min(F.struct(*(x for c in ("parent", "role", "text", "score") for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c).alias(c)))))
    rows = messages.groupBy("conv_id", "node").agg(first.alias("m"))
    return rows.select("conv_id", "node", "m.parent", "m.role", "m.text", "m.score")


def chosen_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of the best branches: conv_id, leaf, branch, score, node, up (steps above the leaf).

    messages: conv_id, node, parent, score with (conv_id, node) unique. A branch's score is the sum over its path, a
    null score counts as 0; ties go to the smaller leaf. A parent that is null or missing makes a root; messages on or
    below a cycle are on no root-to-leaf path. Ancestors are found by pointer doubling: round k joins the table of
    2^k-th ancestors with itself, so a path of n messages takes log2(n) joins, each spread over conversation and node;
    conversations whose messages have all met their root take no part in further rounds.
    """
    nodes = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    linked = nodes.join(there, F.expr("conv_id <=> c and parent = n"), "left")
    live = stored(linked.select("conv_id", "node", F.col("n").alias("up"), "score"))
    answered = live.where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("n")).distinct()
    jumps, ended = [live], []
    limit = max(1, live.count()).bit_length() + 1
    while len(jumps) <= limit and live.where("up is not null").limit(1).count():
        far = live.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("score").alias("s"))
        further = live.where("up is not null").join(far, F.expr("conv_id <=> c and up = n"), "left")
        further = stored(further.select("conv_id", "node", F.col("u").alias("up"), F.expr("score + coalesce(s, 0)").alias("score")))
        rows = further.unionByName(live.where("up is null"))
        open_ = further.where("up is not null").select(F.col("conv_id").alias("c")).distinct()
        ended.append(rows.join(open_, F.expr("conv_id <=> c"), "left_anti"))
        live = stored(rows.join(open_, F.expr("conv_id <=> c"), "left_semi"))
        jumps.append(live)
        ended[-1] = stored(ended[-1])
        forget(further)
    whole = live.where("up is null")
    for part in ended:
        whole = whole.unionByName(part)
    leaves = whole.join(answered, F.expr("conv_id <=> c and node = n"), "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.asc("node"))
    leaves = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    paths = stored(leaves.select("conv_id", F.col("node").alias("leaf"), "branch", "score", "node", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        over = jump.where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("u"))
        above = paths.join(over, F.expr("conv_id <=> c and node = n"))
        above = above.select("conv_id", "leaf", "branch", "score", F.col("u").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        longer = stored(paths.unionByName(above))
        forget(paths)
        paths = longer
    for table in jumps + ended:
        forget(table)
    return paths


def format_reply_trees(messages: DataFrame, branches: int | None = 1, trained_role: str = "assistant", unique: bool = False) -> DataFrame:
    """Each chosen path as one conversation: conv_id, leaf, branch, score, n_turns, formatted, loss_spans.

    messages: conv_id, node, parent, role, text, score; other columns, whatever their names, are ignored. Null roles and
    texts are empty, null scores 0; conv_id may be null, messages with a null node are in no path. Messages that repeat a
    (conv_id, node) count once, as in distinct_messages(); unique says that there are none, which saves that step.
    Branches with equal scores go by their leaf. loss_spans: code point spans of formatted that hold a trained_role text,
    in order. An empty table gives no rows. One conversation is one output row, so its texts, however long, must fit a
    row; paths and scores are spread by message.
    """
    messages = messages.where("node is not null")
    messages = messages if unique else distinct_messages(messages)
    paths = chosen_paths(messages, branches)
    texts = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, F.expr("conv_id <=> c and node = n"))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    turns = turns.select("conv_id", "leaf", "branch", "score", "up", (F.col("role") == trained_role).alias("trained"), head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("stop", F.sum(F.length("piece").cast("long")).over(so_far) - len(END))
    turns = turns.withColumn("start", F.col("stop") - F.length("body"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "trained", "start", "stop")))
    out = turns.groupBy("conv_id", "leaf").agg(F.first("branch").alias("branch"), F.first("score").alias("score"), each.alias("each"))
    return out.select(
        "conv_id", "leaf", "branch", "score", F.size("each").cast("long").alias("n_turns"), F.concat_ws("", "each.piece").alias("formatted"),
        F.expr("transform(filter(each, x -> x.trained), x -> struct(x.start as start, x.stop as stop))").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both taken from formatted and its loss mask alone."""
    cut = F.split("formatted", r"<\|im_start\|>", -1)
    df = formatted.withColumn("_cut", F.slice(cut, F.lit(2), F.size(cut)))
    df = df.withColumn("_cut", F.transform("_cut", lambda x: F.split(F.substr(x, F.lit(1), F.length(x) - len(END)), r"<\|im_sep\|>", 2)))
    df = df.withColumn("turns", F.transform("_cut", lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text"))))
    under = F.expr("transform(loss_spans, s -> substring(formatted, cast(s.start as int) + 1, cast(s.stop - s.start as int)))")
    return df.withColumn("loss_text", F.concat_ws("", F.transform(under, unescaped))).drop("_cut")
