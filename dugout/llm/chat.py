"""Chat formatting of reply trees, in DataFrame functions only.

*Paths*: iterative self-joins. Each round joins the table of (message, ancestor so many steps up, summed score)
with itself, doubling the steps; messages that have met their root leave the rounds. So a thread of n messages
takes log2(n) rounds, and no list of ancestors is built. *Branches*: a root's leaves are ranked by the mean score
of their path, ties to the smaller leaf; the first ``branches`` of them are kept. The kept leaves' paths are then
listed by the same doubled steps, each message once per path. *Format*: every turn is
``<turn>role\\ntext</turn>\\n``; in roles and texts ``\\`` becomes ``\\e``, ``<`` becomes ``\\l`` and, in roles, a
line feed becomes ``\\n``, so no text can end a turn or begin one, and the escapes can be undone. A conversation is
put together from pieces of ``PIECE`` turns. The loss mask is a list of spans over the output, in code points and
in UTF-8 bytes, of the texts of ``LEARNED`` roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dugout.llm.common import stored

PIECE = 256
LEARNED = ("assistant",)
OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def tree_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, leaf, id, depth): the messages of the best ``branches`` root-to-leaf paths of every tree.

    ``messages``: tree, id, parent, score. A parent that is null, or is not a message of the tree, makes a root; each
    root of a tree is ranked with the others. A null score counts as 0. Rows that repeat (tree, id) are one message,
    with the smallest parent and score. Messages in a cycle of parents hang on no root and are not returned.
    """
    nodes = messages.where("id is not null").groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.coalesce(F.min("score"), F.lit(0.0)).alias("score"))
    names = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    nodes = nodes.join(names, nodes["tree"].eqNullSafe(names["t"]) & (nodes["parent"] == names["p"]), "left")
    nodes = stored(nodes.select("tree", "id", F.col("p").alias("parent"), "score"), "messages")

    # up: the message 2**k steps above, and the summed score of the steps from the message to just below it.
    now = nodes.select("tree", "id", F.col("parent").alias("up"), "score", F.lit(1).cast("bigint").alias("steps"))
    done, levels = now.where("up is null").drop("up"), [nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("up"))]
    now = stored(now.where("up is not null"), "up")
    rooted = stored(done, "rooted")
    rounds = 0
    count = nodes.count()
    while not now.isEmpty() and 2**rounds <= count:
        above = rooted.select(F.col("tree").alias("t"), F.col("id").alias("u"), F.col("score").alias("s"), F.col("steps").alias("n"))
        higher = now.select(F.col("tree").alias("t"), F.col("id").alias("u"), F.col("up").alias("next"), F.col("score").alias("s"), F.col("steps").alias("n"))
        above = above.withColumn("next", F.lit(None).cast(nodes.schema["id"].dataType)).unionByName(higher)
        after = now.join(above, now["tree"].eqNullSafe(above["t"]) & (now["up"] == above["u"]))
        after = stored(after.select("tree", "id", F.col("next").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("steps") + F.col("n")).alias("steps")), "up")
        rooted = rooted.unionByName(after.where("up is null").drop("up"))
        now = after.where("up is not null")
        levels.append(now.select("tree", "id", "up"))
        rounds += 1

    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["id"] == parents["p"]), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "id"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= branches)
    path = stored(chosen.select("tree", "branch", F.col("id").alias("leaf"), "id"), "path")
    for up in reversed(levels):
        up = up.select(F.col("tree").alias("t"), F.col("id").alias("u"), F.col("up").alias("next"))
        step = path.join(up, path["tree"].eqNullSafe(up["t"]) & (path["id"] == up["u"])).select("tree", "branch", "leaf", F.col("next").alias("id"))
        path = stored(path.unionByName(step), "path")
    depth = rooted.select(F.col("tree").alias("t"), F.col("id").alias("u"), F.col("steps").alias("depth"))
    path = path.join(depth, path["tree"].eqNullSafe(depth["t"]) & (path["id"] == depth["u"]))
    return path.select("tree", "branch", "leaf", "id", "depth")


def format_paths(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(tree, branch, formatted, loss): one row per path; ``turns``: tree, branch, depth, role, text.

    Turns go by depth. A null role or text is empty. A path is put together piece by piece; ``loss`` is an array of
    (start, length, byte_start, byte_length), counted from 0.
    """
    rows = turns.select("tree", "branch", "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.select("tree", "branch", "depth", F.floor((F.col("depth") - 1) / PIECE).alias("piece"), F.col("role").isin(*learned).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "branch", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    rows = rows.withColumn("byte_at", F.coalesce(F.sum(F.octet_length("turn")).over(before), F.lit(0)) + F.octet_length("head"))
    span = F.struct(F.col("at").alias("start"), F.length("body").cast("bigint").alias("length"), F.col("byte_at").alias("byte_start"), F.octet_length("body").cast("bigint").alias("byte_length"))
    part = F.array_sort(F.collect_list(F.struct("depth", "turn", F.when(F.col("learned"), span).alias("span"))))
    pieces = rows.groupBy("tree", "branch", "piece").agg(part.alias("part"))
    pieces = pieces.select("tree", "branch", "piece", F.array_join(F.col("part.turn"), "").alias("text"), F.filter(F.col("part.span"), lambda s: s.isNotNull()).alias("spans"))
    before = Window.partitionBy("tree", "branch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).withColumn("byte_at", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length"), (s["byte_start"] + F.col("byte_at")).alias("byte_start"), s["byte_length"].alias("byte_length")))
    pieces = pieces.select("tree", "branch", F.struct("piece", "text", moved.alias("spans")).alias("p"))
    whole = pieces.groupBy("tree", "branch").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("tree", "branch", F.array_join(F.col("p.text"), "").alias("formatted"), F.flatten(F.col("p.spans")).alias("loss"))


def format_trees(messages: DataFrame, branches: int = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(tree, branch, formatted, loss): the best ``branches`` paths of every reply tree as conversations.

    ``messages``: tree, id, parent, score, role, text; see ``tree_paths`` and ``format_paths``. An empty table gives
    an empty result; other columns are not looked at.
    """
    paths = tree_paths(messages.select("tree", "id", "parent", "score"), branches)
    said = messages.where("id is not null").groupBy(F.col("tree").alias("t"), F.col("id").alias("i")).agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    turns = paths.join(said, paths["tree"].eqNullSafe(said["t"]) & (paths["id"] == said["i"]))
    return format_paths(turns.select("tree", "branch", "depth", "m.role", "m.text"), learned)


def linear(conversations: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of turns as reply trees of one branch: every row answers the one before it.

    Rows go by turn (nulls first), then role and text; each keeps a place of its own, so repeated turns and rows all
    stay. Places are counted inside blocks of turns and the blocks' sizes added up, so no conversation is numbered
    in one task.
    """
    rows = conversations.select(F.col(tree).alias("tree"), F.col(turn).cast("bigint").alias("turn"), "role", "text")
    rows = rows.withColumn("block", F.floor(F.col("turn") / PIECE))
    sizes = rows.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("tree").alias("t"), F.col("block").alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("tree", "block").orderBy("turn", "role", "text"))
    rows = rows.withColumn("inside", inside).join(sizes, F.col("tree").eqNullSafe(F.col("t")) & F.col("block").eqNullSafe(F.col("b")))
    place = F.col("before") + F.col("inside")
    return rows.select("tree", place.alias("id"), F.when(place > 1, place - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text), and ``learned_text``, the text under the loss mask, both unescaped."""
    # Every turn but the empty string before the first begins after OPEN; its end is CLOSE.
    turns = F.slice(F.split(F.col("formatted"), OPEN), F.lit(2), F.size(F.split(F.col("formatted"), OPEN)))
    body = F.transform(turns, lambda t: F.left(t, F.length(t) - len(CLOSE)))
    turns = F.transform(body, lambda t: F.struct(unescaped_role(F.substring_index(t, "\n", 1)).alias("role"), unescaped(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))
    # The bytes are bound once, so that a span costs its own length.
    spans = lambda b: F.transform("loss", lambda s: unescaped(F.decode(F.substr(b, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")), "utf-8")))
    learned = F.transform(F.array(F.encode("formatted", "utf-8")), lambda b: F.array_join(spans(b), ""))
    return formatted.withColumn("turns", turns).withColumn("learned_text", F.element_at(learned, 1))
