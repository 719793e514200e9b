"""Reply trees as conversations: paths by iterative self-joins, branches ranked, each path formatted with a loss mask.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.shared import written


@dataclass(frozen=True)
class Template:
    """Control strings around a turn. Text and role hold none of them once ``escaped``: ``<`` and ``[`` never occur there,
    so other templates' strings such as ``</s>`` and ``[INST]`` are harmless too."""

    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    learnt: str = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (node, up) of the ancestors 1, 2, 4, ... steps up, each by joining the last with itself.

    Also returns the nodes that are on a cycle or below one, if there are any.
    """
    known = nodes.select(F.col("node").alias("up"))
    step = written(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")).join(known, "up", "left_semi"), "up")
    tables, most = [], nodes.count().bit_length() + 1
    while step.limit(1).count():
        if len(tables) > most:
            return tables, step.select("node").distinct()
        tables.append(step)
        above = step.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        step = written(step.join(above, "up").select("node", F.col("higher").alias("up")), "up")
    return tables, None


def reply_paths(messages: DataFrame, keep: int | None = 1, node: str = "node", parent: str = "parent", score: str | None = None) -> DataFrame:
    """(root, leaf, rank, score, node, place) for the nodes of each root's ``keep`` best root-to-leaf paths (None: all).

    A leaf's ancestors come from joining it with the tables of ancestors 1, 2, 4, ... steps up, the longest first, so a
    path of n turns takes about log2(n) joins and every ancestor is met once. A branch's score is the sum of its
    messages' scores (null: 0); ties go to the smaller leaf. ``place`` counts from 0 at the root.

    A parent that is null or unknown makes a root; nodes on or below a cycle become roots of their own. Of rows with
    equal nodes the one with the smallest parent and score counts, rows with a null node are left out.
    """
    rows = messages.where(F.col(node).isNotNull()).select(
        F.col(node).alias("node"), F.col(parent).alias("parent"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    rows = written(rows.groupBy("node").agg(F.min(F.struct("parent", "score")).alias("s")).select("node", "s.parent", "s.score"), "nodes")
    tables, circular = _jumps(rows)
    if circular is not None:
        cut = rows.join(circular.withColumn("cut", F.lit(True)), "node", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent")))
        rows = written(cut.select("node", "parent", "score"), "nodes")
        tables, _ = _jumps(rows)
    inner = tables[0].select(F.col("up").alias("node")).distinct() if tables else rows.where("false").select("node")
    found = rows.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps"))
    for k in reversed(range(len(tables))):
        higher = found.join(tables[k], "node").select("leaf", F.col("up").alias("node"), (F.col("steps") + 2 ** k).alias("steps"))
        found = written(found.unionByName(higher), "paths")
    branches = found.join(rows.select("node", "score"), "node").groupBy("leaf").agg(
        F.sum("score").alias("score"), F.max("steps").alias("length"), F.max_by("node", "steps").alias("root"))
    order = [F.desc("score"), F.asc("leaf")]
    if keep is not None:  # first within a slice of a large tree, then within the tree
        slice_ = F.row_number().over(Window.partitionBy("root", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*order))
        branches = branches.withColumn("rank", slice_).where(F.col("rank") <= keep)
    branches = branches.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    if keep is not None:
        branches = branches.where(F.col("rank") <= keep)
    return found.join(branches, "leaf").select(
        "root", "leaf", "rank", "score", "node", (F.col("length") - F.col("steps")).alias("place"))


def formatted(turns: DataFrame, by: list[str], place: str, role: str, text: str, template: Template = Template()) -> DataFrame:
    """(by..., formatted, loss, n_turns): one string for each conversation, and the spans of it that are learnt from.

    ``loss`` lists (start, end) in code points, end exclusive, around each learnt turn's escaped text. Null roles and
    texts are empty. Equal places are ordered by role and text. One conversation is one value, by definition.
    """
    head = F.concat(F.lit(template.start), escaped(F.coalesce(F.col(role), F.lit(""))), F.lit(template.middle))
    body, rest = escaped(F.coalesce(F.col(text), F.lit(""))), F.lit(template.end)
    rows = turns.select(*by, F.col(place).alias("place"), F.coalesce(F.col(role), F.lit("")).alias("role"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy(*by).orderBy("place", "role", "body")
    size = F.length("head") + F.length("body") + len(template.end)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    start = F.col("before") + F.length("head")
    learnt = F.when(F.col("role") == template.learnt, F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    whole = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("k", F.concat("head", "body", rest).alias("turn"), learnt.alias("loss")))).alias("t"))
    return whole.select(
        *by, F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"), F.size("t").cast("long").alias("n_turns"))


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) turns of a formatted conversation, read back from the string alone."""
    parts = F.split(formatted, _quoted(template.start))

    def turn(x):
        body = F.substring_index(x, template.middle, -1)
        return F.struct(unescaped(F.substring_index(x, template.middle, 1)).alias("role"),
                        unescaped(F.substring_index(body, template.end, 1)).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  template: Template = Template()) -> DataFrame:
    """(conv, formatted, loss, n_turns) of flat conversations: each turn replies to the one before it.

    Turns are ordered by number (null first), role and text; repeated rows are turns of their own. Rows with a null
    conversation id form one conversation; any text is an id of its own, also one with colons or 'null'. No rows give no rows; extra columns are ignored.
    """
    key = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    flat = rows.select(key.alias("c"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
                       F.col(text).cast("string").alias("text"))
    seq = F.row_number().over(Window.partitionBy("c").orderBy("turn", "role", "text"))
    name = lambda k: F.concat_ws(":", k.cast("string"), "c")
    tree = written(flat.withColumn("k", seq).select(
        name(F.col("k")).alias("node"), F.when(F.col("k") > 1, name(F.col("k") - 1)).alias("parent"), "role", "text"), "turns")
    paths = reply_paths(tree)
    chosen = paths.join(tree.select("node", "role", "text"), "node").select(
        F.expr("substring(leaf, instr(leaf, ':') + 1)").alias("c"), "place", "role", "text")
    made = formatted(chosen, ["c"], "place", "role", "text", template)
    return made.select(F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(rows.schema[conv].dataType).alias(conv), "formatted", "loss", "n_turns")
