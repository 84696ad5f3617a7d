"""Chat formatting over reply trees, with DataFrame functions only.

Messages are nodes of trees.  Branches of a tree are ranked by the sum of their nodes' scores (ties to the lesser leaf).  Iterative
self-joins over node ids alone, without texts, sum the scores from each node up to its root: round k joins each node with
its 2^k-th ancestor, so a chain of n messages takes log2(n) rounds and every join key is a single node.  The same ancestors
then enumerate the root-to-leaf paths of the chosen branches only.  Texts are joined once, at the end: by a broadcast of the
chosen steps if they are at most BROADCAST_STEPS rows, else by a shuffle.  Each chosen path becomes one formatted conversation with the spans of its loss mask.

Template: ``<role>`` line feed, text, ``</turn>`` line feed for each turn.  In roles and texts ``&``, ``<`` and ``>`` are
written as entities, so control strings inside them stay text and reading back restores them.

A null text or role is empty, a null score 0.  A parent that does not exist makes its node a root.  Nodes that reach no root
(cycles) are on no path.  Nodes without a tree id form one tree, the null tree.  Of rows that repeat a tree and node, the one of least role and text
counts, with the least parent and score.  Texts of any length stay whole; a conversation is one row, so its length is bounded by what a
row may hold.  An empty table gives no conversations.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

END = "</turn>\n"
#: Rows up to which the chosen steps (five numbers each) are broadcast, about 16 MB.
BROADCAST_STEPS = 200_000


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def chain(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Nodes (tree, node, parent, role, text, score) of linear conversations: turns in order (ties by role, then text), each the reply to the one before."""
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _at(left: str, place: str, right: str) -> Column:
    """The condition that a place of left is a node of right, of the same tree."""
    return F.expr(f"{left}.tree <=> {right}.tree and {left}.{place} = {right}.node")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """(steps, ends, tables): steps[k] (tree, node, over, total) of the nodes that have a 2^k-th ancestor, over; ends (tree, node, total) of the nodes
    that reach a root, with the score of all nodes on the way; and the stored tables that both read.

    A node leaves the rounds once it has reached its root, so a round joins only the nodes deeper than the one before.
    nodes: (tree, node, parent, score), one row for each node.
    """
    known = nodes.select("tree", "node")
    first = nodes.alias("n").join(known.alias("p"), _at("n", "parent", "p"), "left").select("n.tree", "n.node", F.col("p.node").alias("over"), F.col("score").alias("total"))
    tables = [stored(first, "climb")]
    steps, ends, open_ = [], [tables[0].where("over is null")], tables[0].where("over is not null")
    left = open_.count()
    most = math.ceil(math.log2(left + 2)) + 1  # beyond, only cycles are left
    while left and len(steps) <= most:
        steps.append(open_)
        low, high = open_.alias("x"), reduce(DataFrame.unionByName, [open_, *ends]).alias("y")
        tables.append(stored(low.join(high, _at("x", "over", "y")).select("x.tree", "x.node", "y.over", (F.col("x.total") + F.col("y.total")).alias("total")), "climb"))
        ends.append(tables[-1].where("over is null"))
        open_ = tables[-1].where("over is not null")
        left = open_.count()
    return steps, reduce(DataFrame.unionByName, ends).drop("over"), tables


def paths(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """leaves (tree, leaf, ...) with node and up: the nodes of each one's way to the root with their distance from the leaf; stored."""
    held = [c for c in leaves.columns if c != "tree"]
    found = stored(leaves.withColumn("node", F.col("leaf")).withColumn("up", F.lit(0).cast("long")), "paths")
    for k, step in enumerate(steps):
        far = found.alias("a").join(step.alias("j"), _at("a", "node", "j")).select("a.tree", *(f"a.{c}" for c in held), F.col("j.over").alias("node"), (F.col("a.up") + (1 << k)).alias("up"))
        more = stored(found.unionByName(far), "paths")
        discard(found)
        found = more
    return found


def format_trees(nodes: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss) for the best ``branches`` paths of each tree, all if None.

    nodes: (tree, node, parent, role, text, score).  loss: spans (start, end) of the texts of loss_role in ``formatted``, in code points.
    """
    slim = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    slim = stored(slim.where("node is not null"), "nodes")
    ups, ends, tables = climb(slim)
    above = slim.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = ends.alias("n").join(above.alias("a"), _at("n", "node", "a"), "left_anti").select("tree", F.col("node").alias("leaf"), F.col("total").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches if branches is not None else F.lit(True))
    steps = paths(chosen, ups)
    for table in (slim, *tables):
        discard(table)
    small = steps.limit(BROADCAST_STEPS + 1).count() <= BROADCAST_STEPS
    placed = nodes.alias("n").join((F.broadcast(steps) if small else steps.hint("shuffle_merge")).alias("s"), _at("s", "node", "n"))
    turn = placed.select("s.tree", "s.leaf", "s.up", "s.rank", "s.score", F.coalesce("n.role", F.lit("")).alias("role"), F.coalesce("n.text", F.lit("")).alias("text"))
    path = Window.partitionBy("tree", "leaf")
    turn = turn.withColumn("last", F.lag("up").over(path.orderBy(F.desc("up"), "role", "text"))).where("last is null or last != up")
    turn = turn.withColumn("head", F.concat(F.lit("<"), escape(F.col("role")), F.lit(">\n"))).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size.cast("long")).over(path.orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    turn = turn.withColumn("start", before + F.length("head")).withColumn("end", F.col("start") + F.length("body"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("part"), (F.col("role") == loss_role).alias("learn"), "start", "end")))
    made = turn.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.count("*").alias("n_turns"), parts.alias("parts"))
    loss = F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return made.select("tree", "leaf", "rank", "score", "n_turns", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, turns, formatted_chars) for each formatted conversation: turns are (role, text, learned), learned being the text under the loss mask, null outside it.

    All from the row itself, without a shuffle: one pass over the turns carries the place in the text and the next span of the mask.
    """
    seen = formatted.select("tree", "leaf", "loss", F.length("formatted").cast("long").alias("formatted_chars"), F.filter(F.split("formatted", END), lambda p: p != "").alias("parts"))
    start = "cast(array(struct(0L as at, 0 as span)) as array<struct<at: bigint, span: int>>)"
    places = F.expr(
        f"""slice(aggregate(parts, {start}, (acc, p) -> concat(acc, array(struct(
            element_at(acc, -1).at + length(p) + {len(END)}L as at,
            element_at(acc, -1).span + if(get(loss, element_at(acc, -1).span).start < element_at(acc, -1).at + length(p) + {len(END)}L, 1, 0) as span)))), 1, size(parts))"""
    )

    def turn(part: Column, place: Column) -> Column:
        head = F.length(F.substring_index(part, ">\n", 1)) + 2
        text = F.substring(part, head + 1, F.length(part))
        span = F.get(F.col("loss"), place["span"])
        learned = F.when(span["start"] == place["at"] + head, F.substring(part, head + 1, (span["end"] - span["start"]).cast("int")))
        return F.struct(unescape(F.substring(part, F.lit(2), head - 3)).alias("role"), unescape(text).alias("text"), unescape(learned).alias("learned"))

    return seen.select("tree", "leaf", F.zip_with("parts", places, turn).alias("turns"), "formatted_chars")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, at, role, text, learned) for each turn of the formatted conversations, as ``read_turns`` has them."""
    return read_turns(formatted).select("tree", "leaf", F.posexplode("turns").alias("at", "turn")).select("tree", "leaf", "at", "turn.*")
