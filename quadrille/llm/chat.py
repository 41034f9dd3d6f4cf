"""Chat formatting with cumulative-snapshot collapse (operator 5); DataFrame functions only.

Loggers often store a conversation again after each turn, so the table holds all prefixes of the final one.
Every turn gets the hash of the turns up to it: a running xor, within the conversation, of 128-bit hashes
that are salted with the turn's place. A conversation whose last hash is some longer conversation's inner hash is a
prefix of it and goes (an anti-join); of equal conversations the smallest id stays. What remains is rendered.

One window pass per conversation, then joins on fixed-width hashes: texts are shuffled once, by conversation, and the
anti-join's result meets them where they lie. The window is a running one, so a long conversation is read as a stream; only
rendering holds a conversation whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


CONVERSATION = ["_id", "_none"]  # conv_id, and whether it is null: plain keys, so that one partitioning serves all steps


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(_id, _none, turn, role, text) with pos, hash_a, hash_b (of the turns up to it) and last."""
    order = Window.partitionBy(*CONVERSATION).orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("pos", F.row_number().over(order))
    told = (F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    for k, name in enumerate(("hash_a", "hash_b")):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(k), "pos", *told)).over(so_far))
    return rows.withColumn("last", F.lead("pos").over(order).isNull())


def collapse(conversations: DataFrame) -> DataFrame:
    """The turns of maximal conversations: _id, _none, pos, role, text, n_turns."""
    conv_id = F.col("conv_id")
    unknown = F.lit(0).cast(conversations.schema["conv_id"].dataType)
    turns = prefix_hashes(conversations.select(F.coalesce(conv_id, unknown).alias("_id"), conv_id.isNull().alias("_none"), "turn", "role", "text"))
    key = ["pos", "hash_a", "hash_b"]
    inner = turns.filter(~F.col("last")).select(*key).distinct()
    whole = turns.filter("last").select(*CONVERSATION, *key).join(inner, key, "left_anti")
    kept = whole.groupBy(*key).agg(F.min(F.struct("_none", "_id")).alias("first"))  # a null id stays only where there is no other
    kept = kept.select("first.*", F.col("pos").alias("n_turns"))
    return turns.join(kept, CONVERSATION).select(*CONVERSATION, "pos", "role", "text", "n_turns")


def _plain(text: Column) -> Column:
    """A turn's words can't open or close a turn."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("<| im_start |>"))
    return F.replace(text, F.lit(CLOSE), F.lit("<| im_end |>"))


def render(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered.

    A conversation is the rows of one conv_id in order of turn (then role and text, where turns tie); rows
    without conv_id form one conversation. A null role is rendered as unknown and a null text as empty; both differ from
    every stored value. Repeated rows are turns of their own. Other columns are ignored; an empty table gives an
    empty result.
    """
    turn = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), _plain(F.col("text")), F.lit(CLOSE), F.lit("\n"))
    rows = collapse(conversations).select(*CONVERSATION, "n_turns", F.struct("pos", turn.alias("line")).alias("line"))
    lines = F.array_sort(F.collect_list("line"))
    return rows.groupBy(*CONVERSATION).agg(F.first("n_turns").cast("long").alias("n_turns"), lines.alias("lines")).select(
        F.when(~F.col("_none"), F.col("_id")).alias("conv_id"), "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered")
    )


ORACLE = r"""
WITH t AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2), '') OVER
           (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
whole AS (SELECT min(conv_id) AS conv_id, so_far FROM t WHERE pos = n GROUP BY so_far),
kept AS (SELECT conv_id FROM whole WHERE so_far NOT IN (SELECT so_far FROM t WHERE pos < n))
SELECT conv_id, max(n)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
         || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>')
         || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
