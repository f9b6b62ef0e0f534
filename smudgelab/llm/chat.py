"""Conversations as reply trees: best branches, formatted for training.

A conversation is a tree of rows, each with the row it replies to. Self-joins that
double their reach find every leaf's score (the sum over its path) in as many rounds as
the depth has binary digits; leaves are ranked, and the same links, followed back from the
chosen leaves, give the rows of each chosen path. A tree's rows are brought together only
as the one conversation they become.

The template marks the turns, and a backslash breaks every control string (and every
backslash) inside a text, so any text can be read back exactly. Positions under the loss
mask are counted from the start of their turn, in code points.

Defined results: a null text or role is empty; rows of one conversation with equal
order are told apart by role and text, exact repeats both stay; a reply to a row that
doesn't exist starts a tree of its own; rows of a null conversation form one. Rows that
reply to each other in a circle have no root: they are on no path.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smudgelab.llm.common import stored

#: The template (fixed values). A turn of any other role states it between ROLE marks.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
}
OTHER = ("<<ROLE ", ">>\n", "\n<</ROLE>>")
#: A control string starts here; inside a text it is broken after its first character.
CONTROL = r"(<(?=/?s>|</?(?:SYS|ROLE))|\[(?=/?INST\]))"
TURN = (
    r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>\n.*?\n<</SYS>>|<<ROLE .*?>>\n.*?\n<</ROLE>>"
)


def escaped(text: Column) -> Column:
    """The text with a backslash before each backslash and inside each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def escaped_role(role: Column) -> Column:
    """As ``escaped``; the end of a role mark is broken, too."""
    return F.regexp_replace(escaped(role), ">(?=>)", r">\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def in_order(df: DataFrame, conv_col: str, order_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows of linear conversations as trees: each row replies to the one before."""
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(order_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(
        "conv_id",
        place.cast("long").alias("node"),
        F.when(place > 1, place - 1).cast("long").alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, leaf, node, depth) of the best root-to-leaf paths of each tree.

    ``nodes`` (stored) has conv_id, node (unique in its conversation), parent, score. Branches
    rank by the sum of their scores, larger first, ties to the smaller leaf.
    """
    slim = nodes.select("conv_id", "node", "parent", "score")
    longest = slim.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    exists = slim.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    jump = slim.join(
        exists, slim["conv_id"].eqNullSafe(exists["c"]) & (slim["parent"] == exists["n"]), "left"
    ).select(
        "conv_id", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")
    )
    jumps = [stored(jump, "jumps")]
    for _ in range(ceil(log2(max(2, longest)))):
        # total and depth cover the rows from node up to, not including, ``up``.
        # Rows that have reached the root are done; only the others look further up.
        low, high = jumps[-1].where("up is not null"), jumps[-1].select(
            F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("further"),
            F.col("total").alias("more"), F.col("depth").alias("deeper"),
        )
        jump = low.join(high, low["conv_id"].eqNullSafe(high["c"]) & (low["up"] == high["n"]), "left").select(
            "conv_id", "node", F.col("further").alias("up"),
            (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"),
        )
        jumps.append(stored(jump.unionByName(jumps[-1].where("up is null")), "jumps"))
    parents = slim.select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).where("p is not null").distinct()
    done = jumps[-1].where("up is null")  # rows in a circle never get there
    leaves = done.join(
        parents, done["conv_id"].eqNullSafe(parents["c"]) & (done["node"] == parents["p"]), "left_anti"
    )
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node"))
    paths = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select(
        "conv_id", "branch", F.col("node").alias("leaf"), "node", "depth"
    )
    for jump in reversed(jumps[:-1]):
        # Every row found so far also leads to the one 2^k rows above it.
        step = jump.select(
            F.col("conv_id").alias("c"), F.col("node").alias("n"), "up", F.col("depth").alias("steps")
        ).where("up is not null")
        found = paths.join(step, paths["conv_id"].eqNullSafe(step["c"]) & (paths["node"] == step["n"]), "left")
        here = F.struct("node", "depth")
        above = F.struct(F.col("up").alias("node"), (F.col("depth") - F.col("steps")).alias("depth"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))
        paths = found.select("conv_id", "branch", "leaf", F.explode(both).alias("x")).select(
            "conv_id", "branch", "leaf", "x.node", "x.depth"
        )
    return paths


def _opening(role: Column) -> Column:
    other = F.concat(F.lit(OTHER[0]), escaped_role(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def _closing(role: Column) -> Column:
    other = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def formatted(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: conv_id, branch, formatted, loss_mask.

    ``loss_mask`` has (turn, start, length) of what the loss covers: the assistant's
    texts, in the order of turns; start counts from the turn's first code point.
    """
    other = nodes.select(
        F.col("conv_id").alias("c"), F.col("node").alias("n"), "role",
        F.length(_opening(F.col("role"))).alias("start"),
        F.length(escaped(F.col("text"))).alias("length"),
        F.concat(_opening(F.col("role")), escaped(F.col("text")), _closing(F.col("role"))).alias("turn"),
    )
    rows = paths.join(other, paths["conv_id"].eqNullSafe(other["c"]) & (paths["node"] == other["n"]))
    turns = rows.groupBy("conv_id", "branch", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn", "role", "start", "length"))).alias("turns")
    )
    mask = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.struct(
                i.cast("int").alias("turn"), t["start"].alias("start"), t["length"].alias("length"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
        lambda m: m["loss"],
    )
    return turns.select(
        "conv_id",
        "branch",
        "leaf",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(mask, lambda m: F.struct(m["turn"], m["start"], m["length"])).alias("loss_mask"),
    )


def turns_of(formatted_col: Column) -> Column:
    """The formatted turns, cut at their marks."""
    return F.regexp_extract_all(formatted_col, F.lit(TURN), 0)


def read_turn(turn: Column) -> Column:
    """(role, text) of one formatted turn."""
    is_other = turn.startswith(OTHER[0])
    role = unescaped(F.regexp_extract(turn, r"(?s)^<<ROLE (.*?)>>\n", 1))
    begin = F.length(F.regexp_extract(turn, r"(?s)^<<ROLE .*?>>\n", 0))
    end = F.lit(len(OTHER[2]))
    for name, (opening, closing) in MARKS.items():
        match = ~is_other & turn.startswith(opening)
        role = F.when(match, F.lit(name)).otherwise(role)
        begin = F.when(match, F.lit(len(opening))).otherwise(begin)
        end = F.when(match, F.lit(len(closing))).otherwise(end)
    text = F.substring(turn, begin + 1, F.length(turn) - begin - end)
    return F.struct(role.alias("role"), unescaped(text).alias("text"))


def format_conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Ranks the branches of each reply tree and formats the best ones."""
    nodes = stored(nodes, "nodes")
    return formatted(nodes, best_paths(nodes, branches))
