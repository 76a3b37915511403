"""Conversations from reply trees: rank the branches, format the chosen paths.

A message names the message it replies to.  Ancestors are found by self-joins
that double their reach each round, so a thread of n messages takes log2(n)
rounds; depth and summed score of the path to each message come with them.
Leaves are ranked by the mean score of their path, and only the chosen paths
are enumerated, back through the same doubled steps.

A formatted conversation is one text and the stretches of it under the loss
mask.  Control strings inside roles and texts are broken by a backslash, and
backslashes doubled, so the text can be read back exactly.

Defined results: NULL text or role is empty; of messages with one id in a tree the smallest counts; a
message whose parent is NULL, itself or missing starts a tree of its own; messages in a cycle
are refused; of equal scores the smaller id wins; a NULL tree is a tree.
One conversation is one row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import scratch, stored
from tallyweave.operators.lookup import lookup

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Control strings, each as its first character and the rest: the break goes between.
CONTROLS = [("<", "(/?s>)"), (r"\[", r"(/?INST\])"), ("<", "(</?SYS>>)")]
LEARNED = "assistant"


def number_turns(rows: DataFrame, tree: str, order: list[str], stretch: int = 256) -> DataFrame:
    """``rows`` with ``node``, their number from 0 in the tree by ``order``, and ``parent``, the one before.

    The first of ``order`` is a number; rows are sorted within stretches of it,
    so that no conversation is sorted as a whole.
    """
    dealt = rows.withColumn("_stretch", F.coalesce(F.floor(F.col(order[0]) / stretch), F.lit(-(2**62))))
    counts = dealt.groupBy(tree, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(tree, "_stretch").orderBy(*order)
    numbered = dealt.withColumn("_k", F.row_number().over(within) - 1)
    node = (F.col("_start") + F.col("_k")).cast("long")
    return (
        lookup(numbered, starts, [tree, "_stretch"])
        .withColumn("node", node)
        .withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))
        .drop("_start", "_k", "_stretch")
    )


def paths(messages: DataFrame, best: int = 1, most_rounds: int = 40) -> DataFrame:
    """(tree, path, position, role, text): the ``best`` root-to-leaf paths of each tree.

    ``messages``: tree string (not NULL), node, parent, role, text, score.
    """
    body = F.struct(*[F.col(c) for c in ("parent", "score", "role", "text")])
    whole = messages.groupBy("tree", "node").agg(F.min(body).alias("m")).select("tree", "node", "m.*")
    whole = stored(whole, "messages")
    ids = whole.select("tree", F.col("node").alias("up"))
    other = F.when(F.col("parent") != F.col("node"), F.col("parent"))
    steps = whole.select("tree", "node", other.alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    known = lookup(steps.where("up is not null"), ids, ["tree", "up"], "left_semi")
    steps = known.unionByName(
        lookup(steps, known.select("tree", "node"), ["tree", "node"], "left_anti").withColumn("up", F.lit(None).cast("bigint"))
    )
    # One table holds the steps of all rounds, by round.  Messages that have
    # reached their root are done; only the others go on to the next.
    spark, folder = messages.sparkSession, scratch(messages.sparkSession, "steps")
    kind = "tree string, node bigint, up bigint, total double, depth bigint, round int"

    def add(steps: DataFrame, turn: int) -> DataFrame:
        fields = kind.rsplit(",", 1)[0].split(", ")
        typed = steps.select(*[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in fields)])
        typed.write.parquet(f"{folder}/round={turn}")
        return spark.read.schema(kind).parquet(folder)

    table = add(steps.withColumn("depth", F.lit(1)), 0)
    levels = [table.where("round = 0 and up is not null")]
    while levels[-1].take(1):
        turn = len(levels)
        if turn > most_rounds:
            raise ValueError("messages reply to each other in a cycle")
        far = table.where((F.col("round") == turn - 1) | F.col("up").isNull()).select(
            "tree",
            F.col("node").alias("up"),
            F.col("up").alias("_up"),
            F.col("total").alias("_total"),
            F.col("depth").alias("_depth"),
        )
        steps = lookup(levels[-1].drop("round"), far, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("_up").alias("up"),
            (F.col("total") + F.col("_total")).alias("total"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        table = add(steps, turn)
        levels.append(table.where((F.col("round") == turn) & F.col("up").isNotNull()))
    done = table.where("up is null").drop("round")
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = lookup(done, parents, ["tree", "node"], "left_anti")
    # Spark limits each task's rows to ``best`` per tree before it shuffles them.
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= best)
    chosen = chosen.select("tree", "path", "node")
    for level in reversed(levels[:-1]):
        up = level.select("tree", "node", "up")
        # Paths may share a message; its step is looked up for each of them.
        chosen = lookup(chosen, up, ["tree", "node"]).select(
            "tree", "path", F.explode(F.array("node", "up")).alias("node")
        ).where("node is not null")
    placed = lookup(chosen, done.select("tree", "node", "depth"), ["tree", "node"])
    return lookup(placed, whole.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "path", (F.col("depth") - 1).alias("position"), "role", "text"
    )


def escaped(text: Column) -> Column:
    """Doubles backslashes, and breaks control strings with one."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for first, rest in CONTROLS:
        out = F.regexp_replace(out, f"({first}){rest}", r"$1\\$2")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, path, n_turns, text, loss): each path as one text, with the stretches to be learned.

    ``loss`` holds (start, length) in characters of the text of each assistant turn.
    """
    piece = F.struct(
        "position",
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.coalesce("role", F.lit("")) == LEARNED).alias("learned"),
    )
    gathered = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        size = F.length(p["body"])
        span = F.struct(begin.cast("int").alias("start"), size.cast("int").alias("length"))
        return F.struct(
            (begin + size + len(CLOSE)).cast("int").alias("at"),
            F.when(p["learned"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return gathered.select(
        "tree",
        "path",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("pieces", start, add)["spans"].alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as (role, text), unescaped."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescaped(F.substr(p, F.locate(MIDDLE, p) + len(MIDDLE))).alias("text"),
        ),
    )


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), ""
    )
