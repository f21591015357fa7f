"""Chat formatting of reply trees, in DataFrame operations only.

Iterative self-joins enumerate every root-to-leaf path. Both the ancestor pointers and the paths
double in each round, so a tree of depth d takes log2(d) rounds, and the rows of a round never exceed
the rows of the paths themselves. Paths are ranked by score within their tree and each chosen one is
formatted as one conversation with the spans of its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialise

START, END = "<|im_start|>", "<|im_end|>"
END_PATTERN = r"<\|im_end\|>\n"


def escape(col: Column) -> Column:
    """Add one backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ...: no control string is left, and no text is lost."""
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def escape_role(col: Column) -> Column:
    """A role ends at the line end, so its own line ends are escaped as well."""
    return escape(F.replace(F.replace(col, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(col: Column) -> Column:
    return F.replace(F.replace(unescape(col), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_paths(links: DataFrame) -> DataFrame:
    """(tree, leaf, node, height) of every root-to-leaf path; height 0 is the leaf.

    `links` has tree, node, parent. A parent that is null or absent from the tree makes a root.
    Messages that hang below a cycle never reach a root and are on no path.
    """
    links = materialise(links.select("tree", "node", "parent"), "reply-links")
    n_messages = links.count()
    same_tree = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    jump = (
        links.where("parent is not null").alias("a")
        .join(links.select("tree", "node").alias("b"), same_tree("a", "b") & (F.col("a.parent") == F.col("b.node")), "left_semi")
        .select("tree", "node", F.col("parent").alias("above"))
    )
    jumps, reach = [], 1
    while True:
        jump = materialise(jump, "reply-jumps")
        if jump.isEmpty() or reach > n_messages:
            break
        jumps.append(jump)
        jump = (
            jump.alias("a")
            .join(jump.alias("b"), same_tree("a", "b") & (F.col("a.above") == F.col("b.node")))
            .select("a.tree", "a.node", "b.above")
        )
        reach *= 2
    # Pointers longer than the number of messages go round a cycle.
    endless = jump
    leaves = (
        links.alias("a")
        .join(links.alias("b"), same_tree("a", "b") & (F.col("a.node") == F.col("b.parent")), "left_anti")
        .alias("a")
        .join(endless.alias("b"), same_tree("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
    )
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    for k, jump in enumerate(jumps):
        paths = materialise(paths, "reply-paths") if k else paths
        further = (
            paths.alias("a")
            .join(jump.alias("b"), same_tree("a", "b") & (F.col("a.node") == F.col("b.node")))
            .select("a.tree", "a.leaf", F.col("b.above").alias("node"), (F.col("a.height") + 2**k).alias("height"))
        )
        paths = paths.unionByName(further)
    return paths


def with_node_ids(messages: DataFrame) -> DataFrame:
    """Messages without a node id get one of their own, which no message can name as its parent."""
    nameless = messages.where("node is null")
    if nameless.isEmpty():
        return messages
    number = F.row_number().over(Window.partitionBy("tree").orderBy("parent", "role", "text", "score"))
    kind = messages.schema["node"].dataType
    if isinstance(kind, StringType):
        own = F.concat(F.lit("\0"), number.cast("string"))
    else:
        least = messages.agg(F.least(F.min("node"), F.min("parent"), F.lit(0))).first()[0]
        own = (F.lit(least) - number).cast(kind)
    return messages.where("node is not null").unionByName(nameless.withColumn("node", own))


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, path_rank, path_score, n_turns, formatted, loss_spans.

    `messages` has tree, node, parent, role, text and score, node unique in its tree; other columns
    are not read. Null text or role: empty; null score: 0; a message with a null node is a node that
    nothing replies to. Nodes are whole numbers or texts. The score of a path is the mean of its
    messages; ties go to the smaller leaf. `loss_spans` are (start, length) in characters of
    `formatted`, one for each message of `loss_role`. An empty table gives no rows.
    """
    of_path = Window.partitionBy("tree", "leaf")
    best = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.asc("leaf"))
    wanted = messages.select("tree", "node", "parent", "role", "text", "score")
    messages = with_node_ids(materialise(wanted, "reply-messages"))
    # One write of the path rows: both the ranking and the formatting read them.
    paths = materialise(reply_paths(messages), "reply-paths")
    told = messages.select(
        "tree", "node", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    joined = paths.alias("p").join(
        told.alias("m"), F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node"))
    )
    turns = joined.select(
        "p.tree", "p.leaf", "p.height", "m.score",
        (F.col("m.role") == loss_role).alias("in_loss"),
        F.concat(F.lit(START), escape_role(F.col("m.role")), F.lit("\n")).alias("head"),
        escape(F.col("m.text")).alias("body"),
    ).withColumns({"turn": F.concat("head", "body", F.lit(END + "\n")), "body_chars": F.char_length("body").cast("long")})
    before = F.sum(F.char_length("turn").cast("long")).over(of_path.orderBy(F.desc("height")))
    placed = turns.withColumn("start", before - F.char_length(F.lit(END + "\n")) - F.col("body_chars"))
    span = F.when(F.col("in_loss"), F.struct(F.col("start"), F.col("body_chars").alias("length")))
    formatted = placed.groupBy("tree", "leaf").agg(
        F.avg("score").alias("path_score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "turn"))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    ranked = formatted.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= branches)
    return ranked.select(
        "tree", "leaf", "path_rank", "path_score", "n_turns", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse `formatted` again: adds turns (role, text) and loss_text, all text under the mask, unescaped."""
    pieces = F.split("formatted", END_PATTERN)
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            unescape_role(F.substring_index(p.substr(F.lit(len(START) + 1), F.char_length(p)), "\n", 1)).alias("role"),
            unescape(p.substr(F.instr(p, "\n") + 1, F.char_length(p))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def conversation_links(conversations: DataFrame) -> DataFrame:
    """A flat table of turns as trees of one branch: the parent of a turn is the turn before it.

    Rows that repeat a turn number follow each other by role and text; null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )
