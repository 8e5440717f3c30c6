"""Reply trees: enumerate root-to-leaf paths, rank branches, and format each chosen path as one conversation.

Paths come from iterative self-joins that double their reach: round k joins every message to the one 2^k
replies above it, so the number of rounds grows with the logarithm of the longest thread. A leaf then reaches each of
its ancestors once, over the binary digits of the distance. Joins are on the message, which is unique, so a
conversation with a third of all messages is spread; only a chosen path itself meets in one row. Every round
is written to the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import materialize

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def turns_as_trees(turns: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score) from a linear table (conv_id, turn, role, text).

    Each row replies to the one before it, by turn, role and text (nulls first); rows may repeat.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = turns.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _messages(trees: DataFrame) -> DataFrame:
    """One row per message, keyed by text so that a null conversation is one too; repeated messages count once."""
    key = F.coalesce(F.concat(F.lit("="), col("conv_id").cast("string")), F.lit(""))
    rows = trees.filter("node is not null").select(key.alias("conv"), "node", "parent", "role", "text", "score")
    best = rows.groupBy("conv", "node").agg(F.max(F.struct("parent", "role", "text", "score")).alias("m"))
    return best.select("conv", "node", "m.*")


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (conv, node, above): the message 2^k replies above, for each k; and the messages below a cycle."""
    known = messages.select(F.col("conv").alias("c"), F.col("node").alias("above"))
    up = messages.join(known, (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("above"))).select("conv", "node", "above")
    found: list[DataFrame] = []
    total = None
    while True:
        up = materialize(up, "jumps")
        n = up.count()
        if not n:
            return found, None
        total = n if total is None else total
        if 2 ** len(found) > total:  # longer than all replies: these run into a cycle
            return found, up.select("conv", "node")
        found.append(up)
        again = up.select(F.col("conv").alias("c"), F.col("node").alias("middle"), F.col("above").alias("top"))
        joined = up.join(again, (F.col("conv") == F.col("c")) & (F.col("above") == F.col("middle")))
        up = joined.select("conv", "node", F.col("top").alias("above"))


def paths(trees: DataFrame) -> DataFrame:
    """(conv, leaf, node, distance): every leaf with itself and all its ancestors.

    A message whose parent is null or missing is a root. Messages that lead into a cycle of replies have no
    root and are left out.
    """
    return _paths(materialize(_messages(trees), "messages"))


def _paths(messages: DataFrame) -> DataFrame:
    jumps, cyclic = _jumps(messages)
    nodes = messages.select("conv", "node")
    if cyclic is not None:
        nodes = nodes.join(cyclic, ["conv", "node"], "left_anti")
    if not jumps:
        return nodes.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    parents = jumps[0].select("conv", F.col("above").alias("node")).distinct()
    leaves = nodes.join(parents, ["conv", "node"], "left_anti")
    reached = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("conv").alias("c"), F.col("node").alias("from"), "above")
        further = reached.join(step, (F.col("conv") == F.col("c")) & (F.col("node") == F.col("from")))
        further = further.select("conv", "leaf", F.col("above").alias("node"), (F.col("distance") + 2**k).alias("distance"))
        reached = materialize(reached.unionByName(further), "paths")
    return reached


def escaped(text: Column, in_line: bool = False) -> Column:
    """Reversible; the result has no control string, and no line break if `in_line`."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if in_line else out


def unescaped(text: Column) -> Column:
    parts = F.transform(
        F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    )
    return F.array_join(parts, "\\")


def _marked(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped(role, in_line=True), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def formatted_branches(trees: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, formatted, loss_spans): a row per chosen branch.

    `trees` has conv_id, node (integer), parent, role, text, score. Branches of a conversation are ranked by the mean
    score of their messages (null is 0; ties: the smaller leaf); the best `branches` are formatted, all by
    default. `loss_spans` are the assistant's texts in the formatted one, as code points [begin, end).
    Null texts and roles are empty, rows without a node go, repeated messages count once, a null conversation is
    one, and an empty table gives none.
    """
    kind = trees.schema["conv_id"].dataType
    messages = materialize(_messages(trees), "messages")
    steps = _paths(messages)
    if branches is not None:
        scored = steps.join(messages.select("conv", "node", "score"), ["conv", "node"])
        means = scored.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
        best = Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf")
        chosen = means.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches).select("conv", "leaf")
        steps = steps.join(chosen, ["conv", "leaf"], "left_semi")
    told = steps.join(messages, ["conv", "node"])
    marked = _marked(F.col("role"), F.col("text"))
    length = F.length(escaped(F.col("text")))
    turn = F.struct(
        (-F.col("distance")).alias("at"),
        marked.alias("marked"),
        F.length(marked).alias("size"),
        F.when(F.col("role") == ASSISTANT, length).alias("loss"),
    )
    rows = told.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    none = F.expr("cast(array() as array<struct<begin:int,end:int>>)")

    def walk(state: Column, t: Column) -> Column:
        end = state["size"] + t["size"] - len(END) - 1
        span = F.array(F.struct((end - t["loss"]).alias("begin"), end.alias("end")))
        spans = F.when(t["loss"].isNotNull(), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["size"] + t["size"]).alias("size"), spans.alias("spans"))

    spans = F.aggregate("turns", F.struct(F.lit(0).alias("size"), none.alias("spans")), walk)["spans"]
    place = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    return rows.select(
        F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind).alias("conv_id"),
        "leaf",
        F.row_number().over(place).alias("rank"),
        "score",
        F.array_join("turns.marked", "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    bodies = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.lit(2**31 - 2))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        begin = F.length(role) + 2
        text = F.substr(body, begin, F.length(body) - begin - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    parts = F.transform(spans, lambda s: unescaped(F.substr(formatted, s["begin"] + 1, s["end"] - s["begin"])))
    return F.array_join(parts, "")
