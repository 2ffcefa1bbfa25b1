"""Chat formatting: reply trees become conversations, one per chosen root-to-leaf path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import written

#: Fixed marks of the template: <s>role[INST]text[/INST]</s> for each turn.
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_MARK = r"(s>|/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """A backslash after the first sign of every mark inside a text; more where backslashes already stand there."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _MARK, "$1$2$3")


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, up steps above the leaf.

    messages: tree, node, parent (null: a root). Iterative self-joins that double their reach: after round r the jump
    table leads 2^r replies up and every leaf knows its 2^r lowest ancestors, so a chain of n replies takes log2(n)
    joins and no more rows than the paths have. A parent that doesn't exist makes its child a root. Replies that go in
    a circle have no root and no leaf below them ends: such leaves are left out.
    """
    nodes = messages.select("tree", "node", "parent").distinct()
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = nodes.join(known.distinct(), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above"))
    jump = written(jump, "jump")
    inner = jump.select("tree", F.col("above").alias("node")).distinct()
    leaf = nodes.join(inner, ["tree", "node"], "left_anti")
    paths = written(leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "paths")
    most, reach = nodes.count(), 1
    while reach <= most and not jump.isEmpty():
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        paths = written(paths.unionByName(further), "paths")
        second = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        jump = written(jump.join(second, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), "jump")
        reach *= 2
    if reach <= most:
        return paths
    endless = paths.join(jump.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_semi").select("tree", "leaf").distinct()
    return paths.join(endless, ["tree", "leaf"], "left_anti")


def chosen_paths(messages: DataFrame, branches: int) -> DataFrame:
    """The branches paths of each tree with the highest mean score, ties to the smaller leaf; null scores count as 0."""
    paths = root_to_leaf_paths(messages)
    scored = paths.join(messages.select("tree", "node", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")), ["tree", "node"])
    means = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    best = means.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    return paths.join(best.filter(F.col("branch") <= branches), ["tree", "leaf"])


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, mean, formatted, loss_spans): each chosen path as one text.

    messages: tree, node, parent, role, text, score; (tree, node) is unique. Null roles and texts are empty, control
    strings inside them are escaped reversibly. loss_spans are (start, length) in code points of formatted, one per
    assistant text in order. An empty table gives none; other columns of messages are not used.
    """
    turn = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen_paths(messages, branches).join(turn, ["tree", "node"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(OPEN))
    turns = turns.select(
        "tree", "leaf", "branch", "mean",
        F.struct((-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")).alias("turn"),
    )
    paths = turns.groupBy("tree", "leaf", "branch", "mean").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    tail = len(CLOSE + END)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin, length = state["at"] + F.char_length(t["head"]), F.char_length(t["text"]).cast("bigint")
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct((begin + length + tail).alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE + END))), "")
    return paths.select("tree", "leaf", "branch", "mean", text.alias("formatted"), F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), OPEN, 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)\A.*?\[INST\](.*)\[/INST\]\z", 1)).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
