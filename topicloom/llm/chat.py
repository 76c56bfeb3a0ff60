"""Reply trees as chat texts: paths, the best branches, and a reversible template.

Every message knows the one it answers. Self-joins that double their reach find
each message's root and the score of the path down to it, in as many rounds as
the logarithm of the longest path. Leaves are ranked by the score of their path;
the same jumps list the messages of each chosen path, and each path becomes one
text, with the places of the texts that a model should learn to write.

Defined results: a NULL text or role is empty; rows with a NULL conversation are
one conversation; a message whose parent is not in its conversation is a root;
messages on a cycle have no root and are in no path; branches with equal scores
go by the leaf's number; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import ref
from topicloom.runtime import cut

# The template's control strings and what stands for them in a text.
# Every backslash of an escaped text starts one of these codes, so they can be
# undone one after the other, that of the backslash last.
HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _escape(c: Column, codes=ESCAPES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column, codes=ESCAPES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _nodes(messages: DataFrame, conv: str, msg: str, parent: str, score: str) -> DataFrame:
    """``c, m, up, score``; ``up`` is NULL for a root. Written."""
    c = F.coalesce(F.concat(F.lit("="), ref(conv).cast("string")), F.lit(""))
    rows = messages.select(
        c.alias("c"), ref(msg).alias("m"), ref(parent).alias("up"), ref(score).cast("double").alias("score")
    )
    known = rows.select("c", F.col("m").alias("up"), F.lit(True).alias("known"))
    rows = rows.join(known, ["c", "up"], "left")
    return cut(rows.select("c", "m", F.when(F.col("known"), F.col("up")).alias("up"), "score"))


def best_paths(
    messages: DataFrame, conv: str, msg: str, parent: str, score: str, branches: int = 1
) -> DataFrame:
    """``c, leaf, branch, m, depth``: the messages of the best paths of every tree.

    ``msg`` is a message's number in its conversation and ``parent`` that of the
    one it answers; ``depth`` counts from the root, 0.
    """
    nodes = _nodes(messages, conv, msg, parent, score)
    ends = F.col("up").isNull()
    step = nodes.withColumn("depth", F.when(ends, 0).otherwise(1))
    jumps, done, left = [], [], None
    while True:
        # What has reached its root stays out of later rounds, so these only hold what lies deep.
        done.append(step.where(ends))
        moving = step.where(~ends)
        # Every round finds the root of some message, but for those that only go round.
        before, left = left, moving.count()
        if not left or left == before:
            break
        jumps.append(moving.select("c", "m", "up"))
        over = _union([*done, moving]).select(
            "c", F.col("m").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("score").alias("add")
        )
        step = cut(
            moving.join(over, ["c", "up"]).select(
                "c", "m", F.col("up2").alias("up"),
                (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("add")).alias("score"),
            )
        )
    whole = _union(done)
    answered = nodes.select("c", F.col("up").alias("m")).where("m IS NOT NULL").distinct()
    leaves = whole.join(answered, ["c", "m"], "left_anti")
    rank = Window.partitionBy("c").orderBy(F.desc("score"), "m")
    best = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    paths = [cut(best.select("c", F.col("m").alias("leaf"), "branch", "m", "depth"))]
    for i, jump in enumerate(jumps):
        # The messages up to 2**i before the leaf are there; those of a depth of 2**i lead as many further.
        deep = _union(paths).where(F.col("depth") >= 1 << i)
        far = deep.join(jump, ["c", "m"])
        far = far.select("c", "leaf", "branch", F.col("up").alias("m"), (F.col("depth") - (1 << i)).alias("depth"))
        # Written: the plan would else hold all rounds before it twice.
        paths.append(cut(far))
    return _union(paths)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def format_paths(
    messages: DataFrame,
    conv: str,
    msg: str,
    parent: str,
    score: str,
    role: str,
    text: str,
    branches: int = 1,
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """``conv, branch, formatted, loss``: one text per chosen path, and its spans to learn.

    ``loss`` holds ``lo`` and ``hi`` in code points, one span per text of a role in ``learn``.
    """
    c = F.coalesce(F.concat(F.lit("="), ref(conv).cast("string")), F.lit(""))
    said = messages.select(
        c.alias("c"), ref(msg).alias("m"), ref(conv).alias("conv"),
        F.coalesce(ref(role), F.lit("")).alias("role"), F.coalesce(ref(text), F.lit("")).alias("text"),
    )
    rows = best_paths(messages, conv, msg, parent, score, branches).join(said, ["c", "m"])
    head = F.concat(F.lit(HEAD), _escape(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    rows = rows.withColumns({"head": head, "body": _escape(F.col("text"))})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    along = Window.partitionBy("c", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(along), F.lit(0))
    lo = start + F.char_length("head")
    rows = rows.withColumn("span", F.struct(lo.alias("lo"), (lo + F.char_length("body")).alias("hi")))
    span = F.when(F.col("role").isin(*learn), F.col("span"))
    turn = F.struct("depth", "piece", span.alias("span"))
    paths = rows.groupBy("c", "leaf", "branch").agg(
        F.first("conv").alias("conv"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    return paths.select(
        "conv",
        "branch",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.array_compact(F.col("turns.span")).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The roles and texts of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    said = F.transform(pieces, lambda p: F.substring(p, F.lit(len(HEAD) + 1), F.char_length(p)))

    def turn(p: Column) -> Column:
        at = F.locate(MIDDLE, p)
        return F.struct(
            _unescape(F.substring(p, F.lit(1), at - 1), ROLE_ESCAPES).alias("role"),
            _unescape(F.substring(p, at + len(MIDDLE), F.char_length(p))).alias("text"),
        )

    return F.transform(said, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss spans of a formatted conversation."""
    return F.transform(
        loss,
        lambda s: _unescape(F.substring(formatted, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))),
    )
