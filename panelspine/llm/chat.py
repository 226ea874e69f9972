"""Conversations from reply trees, with DataFrame functions only.

Messages form trees by parent. Every root-to-leaf path is one conversation.
Paths grow by self-joins that double their length: after round k a leaf has its
2^k lowest messages, one row each, so a chain of n turns takes log2(n) joins.

A path is written as turns ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles
and texts every ``<`` with k backslashes and ``|`` after it gets one backslash
more, so no control string can occur there and the text is found again exactly;
line breaks in roles are escaped alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

START, END = "<|im_start|>", "<|im_end|>"


def escape(s: Column) -> Column:
    return F.regexp_replace(s, r"<(\\*)\|", r"<\\$1|")


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"<\\(\\*)\|", r"<$1|")


def escape_role(s: Column) -> Column:
    """Roles stand on one line: backslash runs before n grow by one, and a line break becomes one."""
    return F.replace(F.regexp_replace(escape(s), r"(\\+)n", r"\\$1n"), F.lit("\n"), F.lit("\\n"))


def unescape_role(s: Column) -> Column:
    lone = F.regexp_replace(s, r"(?<!\\)\\n", "\n")
    return unescape(F.regexp_replace(lone, r"\\(\\+)n", "$1n"))


def _keyed(messages: DataFrame) -> DataFrame:
    """messages with the tree as a key that is never null, so that joins keep the null tree."""
    return messages.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.col("tree").alias("value")))


def _plain(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("tree", F.col("tree.value"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path) for every root-to-leaf path; path: array of nodes.

    messages: tree, node, parent, with one row per (tree, node). A message
    whose parent is null, absent or itself is a root. Messages in a cycle have
    no root and belong to no path. Null is a tree like any other. No rows: none.
    """
    rows = _paths(_keyed(messages)).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("up", "node")), asc=False).alias("p"))
    return _plain(rows.select("tree", "leaf", F.transform("p", lambda x: x["node"]).alias("path")))


def _paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up), a row for each message of each path; up is the
    number of steps from the leaf. The tree is keyed.

    jumps[k] leads from a message to its 2^k-th ancestor, as far as there is
    one; it is joined with itself until it is empty or only cycles are left.
    Leaves then take their ancestors in as many joins, each of which doubles the
    known part of every path, so no row holds more than one message.
    """
    own = messages.select("tree", "node", "parent")
    known = own.select("tree", F.col("node").alias("parent"))
    jump = stored(own.where("parent != node").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to")), "jumps")
    inner = jump.select("tree", F.col("to").alias("node")).distinct()
    jumps, left = [], jump.count()
    while left:
        jumps.append(jump)
        onward = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(onward, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")), "jumps")
        before, left = left, jump.count()
        if left == before:  # only cycles are left
            break
    leaves = own.join(inner, ["tree", "node"], "left_anti")
    if left:
        leaves = leaves.join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
    now = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        now = stored(now, "walked")
        higher = now.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        now = now.union(higher)
    return now


def conversations(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """One row per path: tree, leaf, rank, score, formatted, loss_spans.

    messages: tree, node, parent (bigint), role, text (null: empty), score
    (null: 0). A path's score is the mean of its messages' scores; paths of a
    tree are ranked by score, then by leaf; best keeps that many per tree.
    loss_spans are the (start, length) in code points of the assistant texts in
    formatted. Repeated (tree, node) rows count once, the least by content. Rows
    of a null tree form one tree. Texts of any length are kept whole; other
    columns are not read; no rows: none.
    """
    rows = messages.select("tree", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = stored(_keyed(rows).groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*"), "messages")
    walked = stored(_paths(rows), "walked")
    scored = walked.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
    ranked = scored.withColumn("rank", rank)
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
        walked = walked.join(ranked.select("tree", "leaf"), ["tree", "leaf"])
    turns = walked.join(rows.drop("score"), ["tree", "node"])
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    turns = turns.select("tree", "leaf", "up", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("body"), (F.length(role) + len(START) + 1).alias("before"), F.length(text).alias("n"), (F.col("role") == "assistant").alias("loss"))
    earlier = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("body")).over(earlier), F.lit(0)))
    built = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "body", "before", "n", "loss"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct((x["at"] + x["before"]).cast("int").alias("start"), x["n"].cast("int").alias("n")))
    out = built.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["body"]), "").alias("formatted"), spans.alias("loss_spans"))
    return _plain(out.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "formatted", "loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from (conv_id, formatted, loss_spans)."""
    parts = F.split("formatted", r"<\|im_start\|>")
    turns = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["n"]))), "")
    got = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """The digests of read_back for linear conversations (conv_id, turn, role, text).

    Each conversation is the reply tree whose messages answer the turn before.
    Rows of one turn are ordered by role and text and each count; a null turn
    comes first. Rows of a null conv_id are one conversation. Empty input: no rows.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
    made = stored(conversations(rows, best=1).select(F.col("tree").alias("conv_id"), "formatted", "loss_spans"), "formatted")
    return read_back(made)
