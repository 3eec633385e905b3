"""Reply trees to conversations, with DataFrame functions only.

A thread is a tree of messages. Self-joins double the reach of every parent link until all of them
end at a root, adding up scores on the way: as many joins as the depth has binary digits. A leaf's
branch score is the sum of its path. Leaves are ranked within their root, and only the chosen ones are
expanded to their paths, again by doubling. Each path becomes one text.

The template writes a turn as ``<|im_start|>role LF text <|im_end|> LF``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark; a role's line break
becomes ``\\n``. ``unescape`` undoes it exactly. ``loss_spans`` are the places, in code points, of
the texts that a model is trained on.

Defined results: a message whose parent is missing is a root; null roles and texts are empty; rows
that repeat a message id count once, the one with the smallest (parent, role, text) staying;
branches of equal score rank by the smaller leaf id; links that form a circle raise an error; an
empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import written

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up) of the ancestors 1, 2, 4, ... steps up, and (node, root, score) of every node.

    ``links`` has node, up (null at a root) and score.
    """
    state = written(links.select("node", "up", F.col("node").alias("last"), F.col("score").cast("double").alias("score")), "tree")
    steps, n, ended = [], state.count(), state.where("up IS NULL")
    state = state.where("up IS NOT NULL")
    while state.limit(1).count():
        if 1 << len(steps) > 2 * n:
            raise ValueError("messages answer each other in a circle")
        steps.append(state.select("node", "up"))
        above = state.unionAll(ended).select(F.col("node").alias("__node"), F.col("up").alias("__up"), F.col("last").alias("__last"), F.col("score").alias("__score"))
        joined = state.join(above, F.col("up") == F.col("__node"))  # only messages that have not reached their root
        state = written(joined.select("node", F.col("__up").alias("up"), F.col("__last").alias("last"), (F.col("score") + F.col("__score")).alias("score")), "tree")
        ended = ended.unionAll(state.where("up IS NULL"))
        state = state.where("up IS NOT NULL")
    return steps, ended.select("node", F.col("last").alias("root"), "score")


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """(path, root, rank, score, place, node, role, text): the turns of the ``best`` branches of every thread.

    ``messages`` needs node, parent, role, text and score; ids are of one sortable type. ``path`` is
    the id of a branch's leaf, ``place`` counts its turns from the leaf upwards.
    """
    rows = messages.select("node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    keep = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("node", "m.*")
    keep = written(keep, "messages")
    known = keep.select(F.col("node").alias("up"))
    links = keep.select("node", F.col("parent").alias("up"), "score")
    links = links.join(known, "up", "left_semi").select("node", "up", "score").unionAll(links.join(known, "up", "left_anti").select("node", F.lit(None).cast(dict(keep.dtypes)["node"]), "score"))
    steps, roots = _jumps(links)
    inner = keep.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = roots.join(inner, "node", "left_anti")
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("score"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("node").alias("path"), "root", "rank", "score", F.lit(0).alias("place"), "node")
    for k, step in enumerate(steps):
        up = step.select(F.col("node").alias("__node"), F.col("up").alias("__up"))
        further = chosen.join(up, F.col("node") == F.col("__node")).select("path", "root", "rank", "score", (F.col("place") + (1 << k)).alias("place"), F.col("__up").alias("node"))
        chosen = written(chosen.unionAll(further), "paths")
    return chosen.join(keep.select("node", "role", "text"), "node")


def format_branches(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(path, root, rank, score, n_turns, formatted, loss_spans) of each branch, one text per branch."""
    pieces = F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("at"), _escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == trained_role).alias("trained"))))
    rows = turns.groupBy("path", "root", "rank", "score").agg(pieces.alias("t"))
    turn = lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END))
    span = lambda acc, x: F.struct(
        (acc["end"] + F.length(turn(x))).alias("end"),
        F.when(x["trained"], F.concat(acc["spans"], F.array(F.struct((acc["end"] + len(START) + F.length(x["role"]) + 1).alias("start"), F.length(x["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return rows.select(
        "path", "root", "rank", "score", F.size("t").alias("n_turns"),
        F.array_join(F.transform("t", turn), "").alias("formatted"),
        F.aggregate("t", start, span)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    body = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(body, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def as_tree(turns: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees: every turn answers the one before it.

    Turns of a conversation that share a number are ordered by role and text; rows that repeat are turns of their own.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order).cast("bigint"))
    key = lambda at: F.struct(F.col("conv_id").alias("conv_id"), at.alias("at"))
    return rows.select(key(F.col("at")).alias("node"), F.when(F.col("at") > 1, key(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
