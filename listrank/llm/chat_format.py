"""Chat formatting of reply trees: paths from root to leaf by iterative self-joins, one conversation for each chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Replacements, in order; undone in reverse. Escaped text has neither "<" nor "#", so no marker can stand in it.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes(tree_id, node_id, parent_id, score), node_id unique in its tree: tree_id, leaf_id, node_id, position (0 at
    the root), branch_score, for the `branches` best leaves of each root.

    A self-join doubles the distance each round: (node, ancestor at 2^k, score between) joined with itself, so depth d
    takes log2(d) rounds. A leaf's score is the sum of scores on its path; ties go to the smaller leaf_id. The chosen
    paths are then filled in by the same jumps, largest first. Only ids and scores take part in the joins. A parent
    that is null, missing or the node itself makes a root; nodes on or below a cycle have no root and form no path. Rows without
    a node_id are no nodes: they are left out. A node_id that repeats in its tree raises."""
    n = F.col("score").cast("double")
    nodes = cut(nodes.select("tree_id", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), F.coalesce(n, F.lit(0.0)).alias("score")).where("node_id is not null"))
    if not nodes.groupBy("tree_id", "node_id").count().where("count > 1").isEmpty():
        raise ValueError("node_id must be unique in its tree")
    known = nodes.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"))
    linked = nodes.where("parent_id <> node_id").join(known, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("parent_id") == F.col("_n")), "left_semi")
    jumps = [cut(linked.select("tree_id", "node_id", F.col("parent_id").alias("up")))]
    # state: every node, the furthest ancestor known, its distance and the score of the nodes before it
    mine = jumps[0].select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), "up")
    state = nodes.join(mine, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n")), "left")
    state = cut(state.select("tree_id", "node_id", F.coalesce("up", "node_id").alias("top"), F.col("up").isNotNull().cast("long").alias("depth"), F.when(F.col("up").isNotNull(), F.col("score")).otherwise(0.0).alias("sum")))
    total = nodes.count()
    while True:
        step = 1 << (len(jumps) - 1)
        far = state.where(F.col("depth") == step)
        if step > total or far.isEmpty():
            break
        above = state.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("top").alias("_top"), F.col("depth").alias("_d"), F.col("sum").alias("_s"))
        nearer = state.where(F.col("depth") < step)
        further = far.join(above, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("top") == F.col("_n")))
        state = cut(nearer.unionByName(further.select("tree_id", "node_id", F.col("_top").alias("top"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("sum") + F.col("_s")).alias("sum"))))
        jumps.append(cut(state.where(F.col("depth") == 2 * step).select("tree_id", "node_id", F.col("top").alias("up"))))
    parents = linked.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p"))
    leaves = state.join(parents, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_p")), "left_anti")
    roots = nodes.join(linked.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n")), F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n")), "left_anti")
    roots = roots.select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), F.col("score").alias("root_score"))
    leaves = leaves.join(roots, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("top") == F.col("_n"))).withColumn("branch_score", F.col("sum") + F.col("root_score"))
    best = Window.partitionBy("tree_id", "top").orderBy(F.desc("branch_score"), "node_id")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches)
    paths = cut(chosen.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.col("depth").alias("position"), "branch_score"))
    for k in reversed(range(len(jumps))):
        hop = jumps[k].select(F.col("tree_id").alias("_t"), F.col("node_id").alias("_n"), "up")
        more = paths.join(hop, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n")))
        paths = cut(paths.unionByName(more.select("tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("position") - (1 << k)).alias("position"), "branch_score")))
    return paths


def format_paths(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """messages(tree_id, node_id, parent_id, role, text, score): one row per chosen path, with tree_id, leaf_id,
    branch_score, formatted, loss_spans.

    A turn is <turn>role, newline, text, </turn>, newline, with role and text escaped; unescape gives them back exactly.
    loss_spans are the texts of loss_role's turns as UTF-8 byte offsets into formatted, end exclusive. Null roles and
    texts are empty; an empty table gives an empty table; node_id is as reply_paths has it."""
    paths = reply_paths(messages.select("tree_id", "node_id", "parent_id", "score"), branches)
    texts = messages.select(F.col("tree_id").alias("_t"), F.col("node_id").cast("long").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("node_id") == F.col("_n")))
    head, body = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("tree_id", "leaf_id", "branch_score", "position", (F.col("role") == loss_role).alias("learn"), head.alias("head"), body.alias("body"))
    length = F.octet_length("head") + F.octet_length("body") + len(CLOSE)
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.octet_length("head"))
    turns = turns.groupBy("tree_id", "leaf_id").agg(F.max("branch_score").alias("branch_score"), F.sort_array(F.collect_list(F.struct("position", "learn", "start", F.octet_length("body").alias("n"), F.concat("head", "body", F.lit(CLOSE)).alias("turn")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["n"]).alias("end")))
    return turns.select("tree_id", "leaf_id", "branch_score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    bodies = F.transform(parts, lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1 - len(OPEN)))
    return F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(b, "\n", 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(2**31 - 1))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees that are chains: each row replies to the one before it in its conversation. Rows of
    one turn follow in order of role and text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").alias("tree_id"), place.cast("long").alias("node_id"), "role", "text")
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))
