"""Chat formatting of reply trees.

Messages point to the message that they answer. Self-joins find every message's root and score in a number of rounds that
grows with the logarithm of the depth: each round joins a message's jump to an ancestor with that ancestor's own jump, so that
the steps double. Branches (root to leaf) are ranked by score, the same jumps give the messages on the chosen ones,
and each branch becomes one conversation: a text with marked turns, and a loss mask over what the assistant says.

Format: a turn is ``### Assistant: `` (``### System: ``, ``### User: ``; ``### @role: `` for any other role), the text and ``</turn>``
with a line end. Inside texts a backslash is doubled, ``</turn>`` becomes ``<\\/turn>`` and every ``#`` after two others ``\\#``, so no
text holds a control string; removing each backslash, but not what follows it, gives the text back. Roles are escaped in
the same way, and ``: `` in them as ``:\\ ``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batch, read, stored

#: The marks of the three roles, of any other one, and of a turn's end.
HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, END = "### @", "</turn>\n"
#: The places to which the branches of one tree are dealt before the best are told.
DEALT = 64

_MESSAGE = ["tree", "node", "parent", "role", "text", "score"]


def escaped(text: Column) -> Column:
    once = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(once, "(?<=##)#", r"\\#")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def head(role: Column) -> Column:
    """The mark that opens a turn."""
    out = F.concat(F.lit(OTHER), F.replace(escaped(role), F.lit(": "), F.lit(":\\ ")), F.lit(": "))
    for name, mark in HEADS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def messages(df: DataFrame) -> DataFrame:
    """A table of messages as the operators take it: tree, node, parent, role, text, score (absent or no number: 0)."""
    score = F.nanvl(F.col("score").cast("double"), F.lit(0.0)) if "score" in df.columns else F.lit(0.0)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select("tree", "node", "parent", blank("role"), blank("text"), F.coalesce(score, F.lit(0.0)).alias("score"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of conversations without branches (conv_id, turn, role, text): each turn answers the one before it.

    Equal turns stand in the order of role and text; null turns come first; rows without conv_id are one conversation.
    """
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return messages(turns.select(F.col("conv_id").alias("tree"), place.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)))


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes (tree, node, parent, score) -> (branch ends, jump tables).

    The first has tree, node, depth (0 for roots) and total (the scores from the root down) of every message that a root leads to;
    the i-th table has (tree, node, up) for ancestors 2^i steps up. A parent that is not there makes its reply a root.
    Messages whose parents go in a circle have no root and are in neither; rounds end when none finds its root any more.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    at = nodes.alias("n").join(known.alias("k"), F.expr("n.tree <=> k.tree AND n.parent = k.parent"), "left")
    at = stored(at.select("n.tree", "n.node", F.when(F.col("known"), F.col("n.parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("n.score").alias("total")), "chat-jumps")
    tables, done, waiting = [], None, None
    while True:
        ended = at.where("up IS NULL").select("tree", "node", (F.col("steps") - 1).alias("depth"), "total")
        done = ended if done is None else done.union(ended)
        left = at.where("up IS NOT NULL")
        count = left.count()
        if not count or count == waiting:  # a round in which nobody found a root: what is left goes in circles
            return done, tables
        waiting = count
        tables.append(left.select("tree", "node", "up"))
        on = every_state(at, done)
        at = stored(
            left.alias("a").join(on.alias("b"), F.expr("a.tree <=> b.tree AND a.up = b.node"))
            .select("a.tree", "a.node", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total")),
            "chat-jumps",
        )


def every_state(at: DataFrame, done: DataFrame) -> DataFrame:
    """What a jump can land on: those still under way, and those that have their root."""
    ended = done.select("tree", "node", F.lit(None).cast(at.schema["up"].dataType).alias("up"), (F.col("depth") + 1).alias("steps"), "total")
    return at.where("up IS NOT NULL").select("tree", "node", "up", "steps", "total").union(ended)


def branches(nodes: DataFrame, ends: DataFrame, best: int | None = 1, by: str = "total") -> DataFrame:
    """(tree, leaf, depth, value, rank) of the ``best`` branches of each tree: by total or mean score, ties to the lesser leaf.

    best None: all, unranked. The branches of a tree are dealt to DEALT places, and only the best of each place meet.
    """
    if by not in ("total", "mean"):
        raise ValueError("by is total or mean")
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaf = ends.alias("e").join(inner.alias("i"), F.expr("e.tree <=> i.tree AND e.node = i.node"), "left_anti")
    value = F.col("total") if by == "total" else F.col("total") / (F.col("depth") + 1)
    found = leaf.select("tree", F.col("node").alias("leaf"), "depth", value.alias("value"))
    if best is None:
        return found.withColumn("rank", F.lit(None).cast("int"))
    order = [F.desc("value"), F.asc("leaf")]
    near = found.withColumn("place", F.pmod(F.xxhash64("leaf"), F.lit(DEALT)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("tree", "place").orderBy(*order))).where(F.col("rank") <= best).drop("rank", "place")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= best)


def steps_of(chosen: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, node, place) of every message on the chosen branches; place 0 is the root.

    A round adds to each message on a branch the one 2^i steps above it, which no other round adds.
    """
    out = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.col("depth").alias("place"))
    for i, table in enumerate(tables):
        up = out.alias("p").join(table.alias("j"), F.expr("p.tree <=> j.tree AND p.node = j.node"))
        out = stored(out.union(up.select("p.tree", "p.leaf", "p.rank", F.col("j.up").alias("node"), (F.col("p.place") - (1 << i)).alias("place"))), "chat-steps")
    return out


def formatted(steps: DataFrame, msgs: DataFrame) -> DataFrame:
    """(tree, leaf, rank, n_turns, text, mask): each branch as one text, and the spans (start, size, in code points) under the loss mask.

    A conversation is one value of a row, so a branch must be below 2 GB. Branches are gathered by tree and leaf; those of a
    popular tree are in many groups.
    """
    line = steps.alias("s").join(msgs.alias("m"), F.expr("s.tree <=> m.tree AND s.node = m.node"))
    line = line.select("s.tree", "s.leaf", "s.rank", "s.place", (F.col("m.role") == "assistant").alias("told"), head(F.col("m.role")).alias("head"), escaped(F.col("m.text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.sum(size).over(W.partitionBy("tree", "leaf").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    line = line.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    span = F.when(F.col("told"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("size")))
    part = F.struct("place", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    parts = F.sort_array(F.collect_list(part))
    whole = line.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.count("*").alias("n_turns"), parts.alias("parts"))
    return whole.select("tree", "leaf", "rank", "n_turns", F.array_join(F.col("parts.turn"), "").alias("text"), F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("mask"))


def conversations(msgs: DataFrame, best: int | None = 1, by: str = "total") -> DataFrame:
    """The ``best`` branches of every tree of messages (tree, node, parent, role, text, score) as conversations.

    node is unique in its tree; of rows of one tree and node the least is kept. Null node: left out, as nothing can name it;
    null tree: one tree; null role or text: empty; null score: 0. Messages in a circle of parents are on no branch. An empty table
    gives none. Texts are whole, and travel twice: to their branches, and with them.
    """
    fields = ["parent", "role", "text", "score"]
    one = messages(msgs).where("node IS NOT NULL")
    one = stored(one.groupBy("tree", "node").agg(F.min(F.struct(*fields)).alias("m")).select("tree", "node", *(f"m.{c}" for c in fields)), "chat-messages")
    nodes = one.select("tree", "node", "parent", "score")
    ends, tables = jumps(nodes)
    return formatted(steps_of(branches(nodes, ends, best, by), tables), one)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    names = {mark: role for role, mark in HEADS.items()}
    out = []
    for turn in text.split(END)[:-1]:
        mark, colon, body = turn.partition(": ")
        role = names.get(mark + colon)
        out.append((unescaped(mark[len(OTHER) :]) if role is None else role, unescaped(body)))
    return out


def under_mask(text: str, mask: list[dict]) -> str:
    """What a model learns to say: the masked spans, unescaped, one after the other."""
    return "".join(unescaped(text[s["start"] : s["start"] + s["size"]]) for s in mask)


def read_back(chats: DataFrame) -> DataFrame:
    """tree, leaf, turns (role, text) and loss (the text under the mask) from formatted conversations."""
    kind = {c: chats.schema[c].dataType.simpleString() for c in ("tree", "leaf")}

    def body(batches):
        for batch in batches:
            chat, mask = batch.column("text").to_pylist(), batch.column("mask").to_pylist()
            turns = pa.array([[{"role": r, "text": t} for r, t in parsed(x)] for x in chat], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            loss = pa.array([under_mask(x, m) for x, m in zip(chat, mask, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), turns, loss, batch.column("n_chars")], names=["tree", "leaf", "turns", "loss", "n_chars"])

    schema = f"tree {kind['tree']}, leaf {kind['leaf']}, turns array<struct<role:string,text:string>>, loss string, n_chars long"
    return by_batch(chats.select("tree", "leaf", "text", "mask", F.length("text").cast("long").alias("n_chars")), schema, body)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, that holds the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    back = read_back(conversations(from_turns(turns)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"))


QUERIES = {"op11_chat_format": op11_chat_format}
ORACLE_SQL = {
    "op11_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(x)),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars,
         CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
              ELSE 7 + length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
                   + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) + (length(role) - length(replace(role, ': ', ''))) // 2 END + 8 AS marks
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
