"""Chat formatting of reply trees.

Messages name the message they answer.  Root-to-leaf paths are enumerated by
iterative self-joins that double their reach: jump table k leads from a message to
its 2**k-th ancestor, and from the leaves the tables are applied from the longest
jump to the shortest, which visits every message of every path once.  Branches of
a tree are ranked by score, and the chosen paths are formatted as conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import written

# The template: <s>role, line end, text</s> per turn.  In texts and roles a backslash is put into every
# control string (also those of other templates), and one more into those that have some already.
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"(/?s>|/?INST\])"
_RAW, _ESCAPED = rf"([<\[])(\\*){_CONTROL}", rf"([<\[])\\(\\*){_CONTROL}"
_ESCAPED_RE = re.compile(_ESCAPED)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped(text: str) -> str:
    return _ESCAPED_RE.sub(r"\1\2\3", text)


def unescaped_role(role: str) -> str:
    return unescaped(role).replace("%0A", "\n").replace("%25", "%")


def paths(messages: DataFrame) -> DataFrame:
    """``leaf, message_id, up``: every message of every root-to-leaf path, ``up`` steps above the leaf.

    A message whose parent is not in the table is a root.  Messages on or above
    which replies run in a circle have no root and so no path.
    """
    ids = written(messages.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(F.min("parent_id").alias("parent_id")), "ids")
    real = ids.select(F.col("message_id").alias("parent_id"))
    jump = written(ids.join(real, "parent_id").select("message_id", F.col("parent_id").alias("to")), "jump")
    leaves = ids.select("message_id").join(jump.select(F.col("to").alias("message_id")).distinct(), "message_id", "left_anti")
    jumps, rows = [], jump.count()
    while rows:
        jumps.append(jump)
        second = jump.select(F.col("message_id").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(second, "to").select("message_id", F.col("far").alias("to")), "jump")
        last, rows = rows, jump.count()
        if rows == last:  # the rest never comes to a root
            leaves = leaves.join(jump.select("message_id"), "message_id", "left_anti")
            break
    reach = written(leaves.select(F.col("message_id").alias("leaf"), "message_id", F.lit(0).cast("long").alias("up")), "reach")
    for k in reversed(range(len(jumps))):
        further = reach.join(jumps[k], "message_id").select("leaf", F.col("to").alias("message_id"), (F.col("up") + (1 << k)).alias("up"))
        reach = written(reach.unionByName(further), "reach")
    return reach


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best branches of every tree, each formatted as one conversation.

    ``messages``: ``message_id`` (unique), ``parent_id``, ``role``, ``text``,
    ``score``.  A branch's score is the sum over its messages (null: 0), ties go to
    the smaller leaf id.  Returns ``root, leaf, branch`` (from 1), ``score``,
    ``n_turns``, ``formatted`` and ``loss`` (start and length, in code points, of
    every assistant text in ``formatted``).  Null roles and texts are empty; rows
    without an id are left out, as nothing can name them; of rows that share an id
    the path holds all; other columns are not read; no messages, no conversations.
    """
    own = messages.select("message_id", "parent_id", "role", "text", "score")
    reach = paths(own)
    scored = reach.join(own.select("message_id", "score"), "message_id").groupBy("leaf").agg(
        F.max_by("message_id", "up").alias("root"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score")
    )
    best = Window.partitionBy("root").orderBy(F.desc("score"), "leaf")
    chosen = written(scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches), "chosen")
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    turns = (
        reach.join(chosen.select("leaf"), "leaf", "left_semi")
        .join(own.select("message_id", (F.col("role") == "assistant").alias("learn"), role.alias("role"), text.alias("text")), "message_id")
        .select(
            "leaf", "up", "text", F.coalesce("learn", F.lit(False)).alias("learn"),
            F.concat(F.lit(OPEN), "role", F.lit("\n")).alias("head"),
        )
    )
    so_far = Window.partitionBy("leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("text") + len(CLOSE)
    turns = turns.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(so_far), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start"), F.length("text").cast("long").alias("length"))
    whole = turns.groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("start", F.concat("head", "text", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), span))).alias("loss"),
    )
    return whole.join(chosen, "leaf").select(
        "root", "leaf", "branch", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss",
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    found = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition("\n")
        found.append((unescaped_role(role), unescaped(text)))
    return found


def read_loss(formatted: str, loss: list[tuple[int, int]]) -> list[str]:
    """Texts under the loss mask."""
    return [unescaped(formatted[start : start + length]) for start, length in loss]
