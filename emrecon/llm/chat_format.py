"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins enumerate the paths from
each leaf to its root, the reach doubling in each round; a tree's branches are ranked by
the mean score of their messages, and each chosen path becomes one conversation.

A turn is ``[INST]role[/INST]text</s>``. In roles and texts a backslash is doubled and a
control string gets one backslash after its first character, so none is left, and what
was written can be read back exactly. The loss mask is a list of spans, in code points:
the text of each assistant turn.

Defined cases: null roles and texts count as empty, null scores as 0; a parent that is
not there makes its message a root; a conversation of any length is one row, and texts of
any length are taken whole; a cycle of replies is an error; of equal scores the
longer path, then the smaller leaf comes first; an empty table gives no rows; other
columns are ignored. For a flat table each row answers the one before it in its
conversation; rows of one turn follow each other by role and text, nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emrecon.llm.common import cut

# Fixed values of the template.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
LEARNT = "assistant"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE, END):
        c = F.replace(c, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, msg, up: for each leaf all messages from it (up = 0) to its root."""
    nodes = messages.select("tree", "msg", "parent")
    known = nodes.select("tree", F.col("msg").alias("parent"))
    jump = cut(nodes.where("parent IS NOT NULL").join(known, ["tree", "parent"], "left_semi").select("tree", "msg", F.col("parent").alias("to")), "jump")
    answered = jump.select("tree", F.col("to").alias("msg"))
    found = cut(nodes.select("tree", "msg").join(answered, ["tree", "msg"], "left_anti").select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up")), "paths")
    most, step = nodes.count(), 1
    while not jump.isEmpty():
        if step > most:
            raise ValueError("replies form a cycle")
        further = cut(found.join(jump, ["tree", "msg"]).select("tree", "leaf", F.col("to").alias("msg"), (F.col("up") + step).alias("up")), "paths")
        found = found.unionByName(further)
        jump = cut(jump.join(jump.select("tree", F.col("msg").alias("to"), F.col("to").alias("next")), ["tree", "to"]).select("tree", "msg", F.col("next").alias("to")), "jump")
        step *= 2
    return found


def best_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The rows of ``paths`` of each tree's best branches, with the rank as ``branch``."""
    found = paths(messages)
    scored = found.join(messages.select("tree", "msg", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), ["tree", "msg"])
    leaves = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("length"))
    order = W.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), "leaf")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches).select("tree", "leaf", "branch")
    return found.join(chosen, ["tree", "leaf"])


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, formatted, loss (array of start and end, in code points).

    ``messages``: tree and msg (an id within the tree), parent, role, text, score."""
    rows = best_branches(messages, branches).join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
    role, text = (escaped(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    rows = rows.select("tree", "branch", "up", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), text.alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = W.partitionBy("tree", "branch").orderBy(F.desc("up"))
    rows = rows.withColumn("start", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") + F.length("head"))
    rows = rows.withColumn("span", F.when(F.col("role") == LEARNT, F.struct("start", (F.col("start") + F.length("body")).alias("end"))))
    turns = rows.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn"), "span"))).alias("t"))
    loss = F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull())
    return turns.select("tree", "branch", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    halves = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(OPEN) + 1)), r"\Q" + CLOSE + r"\E", -1))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def as_tree(rows: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees of one branch each. The
    tree is the conversation's id; rows without one are a conversation of their own."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.select(F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id")).alias("tree"), "turn", "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return cut(rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "messages")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    text = f"{END}{OPEN} ok {CLOSE}"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(text).alias("text"))
    out = format_trees(as_tree(rows.unionByName(own)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    out = out.withColumns({"turns": read_back(F.col("formatted")), "learnt": under_loss(F.col("formatted"), F.col("loss"))})
    return out.select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, replace(replace(replace(replace(role || text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length('[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
