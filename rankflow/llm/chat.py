"""Chat formatting of reply trees.

Messages name the message they answer.  Iterated self-joins double the distance
each message can look up its tree, so a tree of any depth is climbed in as many
joins as its depth has binary digits; the same jump tables then list, for the
chosen leaves only, every message between root and leaf.  Branches are ranked
by the sum of their messages' scores, and each chosen path becomes one text.

The template writes a turn as ``<s>[INST]role[/INST]text</s>``.  Control strings
inside roles and texts are broken up by a backslash, and backslashes doubled,
so that reading back is exact.  The loss mask lists the spans of assistant texts.

Defined cases: null roles and texts count as empty; a message whose parent is
null or missing is a root; messages on a cycle have no root and are on no path;
a null tree id is a tree like any other; equal scores are ranked by message id.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.plans import cut
from rankflow.plans.shared import null_safe

# The control strings of the template and of common templates beside it.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN_START, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """Double backslashes, then put one behind the first character of every control string."""
    first = "".join(sorted({"\\" + c[0] for c in CONTROLS}))
    rest = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in c[1:]) for c in CONTROLS)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([{first}])(?=(?:{rest}))", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\?)", "$1")


def best_paths(messages: DataFrame, score: str = "score", per_tree: int = 1) -> DataFrame:
    """Messages of the best root-to-leaf paths: tree, branch (rank from 1), place (from 0), node.

    ``messages`` has tree, node, parent and the score column; nodes are unique within a tree.
    """
    nodes = cut(messages.select("tree", "node", "parent", F.col(score).cast("double").alias("total")), "nodes")
    parents = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    jumps = null_safe(nodes, parents, ["tree", "parent"]).select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"),
        F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(1).cast("bigint").alias("steps"),
    )
    jumps = cut(jumps, "jumps")
    climbing, finished = jumps.filter("up IS NOT NULL"), jumps.filter("up IS NULL")
    tables, open_before = [], None
    while (still_open := climbing.count()) not in (0, open_before):
        # Only messages that have not reached their root climb on; each round doubles the distance.
        open_before = still_open
        tables.append(climbing)
        above = climbing.unionByName(finished).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_t"), F.col("steps").alias("_s"))
        higher = null_safe(climbing, above, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"),
            (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"),
        )
        higher = cut(higher, "jumps")
        climbing, finished = higher.filter("up IS NOT NULL"), finished.unionByName(higher.filter("up IS NULL"))
    answered = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.lit(True).alias("known")).distinct()
    leaves = null_safe(finished, answered, ["tree", "node"]).filter("known IS NULL")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= per_tree)
    paths = cut(chosen.select("tree", "branch", F.col("steps").alias("size"), "node", F.lit(0).cast("bigint").alias("back")), "paths")
    for k, table in enumerate(tables):
        ups = table.select("tree", "node", "up")
        higher = null_safe(paths, ups, ["tree", "node"], "inner").select(
            "tree", "branch", "size", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = cut(paths.unionByName(higher), "paths")
    return paths.select("tree", "branch", (F.col("size") - 1 - F.col("back")).alias("place"), "node")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: tree, branch, formatted, loss_spans (start and end in code points)."""
    texts = messages.select(
        "tree", "node",
        escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
    )
    turns = null_safe(paths, texts, ["tree", "node"], "inner")
    # A path becomes one row, so its turns have to meet in one task.
    rows = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "learn"))).alias("turns"))
    head = len(TURN_START) + len(ROLE_END)

    def put(state: Column, turn: Column) -> Column:
        start = state["at"] + head + F.length(turn["role"])
        end = start + F.length(turn["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(TURN_END)).alias("at"),
            F.when(turn["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    written = F.transform("turns", lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit(ROLE_END), t["text"], F.lit(TURN_END)))
    return rows.select(
        "tree", "branch", F.array_join(written, "").alias("formatted"),
        F.aggregate("turns", empty, put)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: str = "formatted") -> Column:
    """The turns of a formatted text as (role, text), unescaped."""
    parts = F.split(F.col(formatted), "</s>")
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(TURN_START) + 1))
        at = F.instr(inner, ROLE_END)
        return F.struct(
            unescape(F.substr(inner, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(inner, at + len(ROLE_END))).alias("text"),
        )

    return F.transform(turns, turn)


def masked_texts(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["end"] - s["start"])))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the row of the turn before.

    Rows of equal turn follow in order of role and text; null turns come first.
    """
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).alias("score"),
    )
