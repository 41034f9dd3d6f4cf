"""Exact dedup by deterministic block naming (operator 8).

A text is cut into fixed-size blocks. The distinct blocks are sorted within hash partitions, and a block's
place is its integer name; then adjacent pairs of names are named the same way, level by level, until one
integer stands for the whole document. Equal names mean equal contents by construction (names are given to
sorted distinct contents, not to fingerprints), so an identity is free of collisions.

A block finds its name by its 64-bit hash where all blocks with that hash are one content; contents that
share a hash are told apart by the bytes themselves.

Cost: distinct blocks are combined before the shuffle, so copies collapse where they are read; the text
is shuffled at most once, and each further level moves half as many fixed-width rows as the one before.
Levels are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.rows import is_scan, numbered
from quadrille.session import ensure_checkpoint_dir

LAST = -(1 << 63)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; runs of a single space are left alone."""
    runs = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _blocks(docs: DataFrame, size: int, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """(row, doc_id, n_blocks, pos, block, h, sha); sha on the first block only."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
        normalised(F.col(text_col)).cast("binary").alias("content"),
    )
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("pos"))
    block = F.substring("content", F.col("pos") * size + 1, F.lit(size))
    return rows.select(
        "row",
        "doc_id",
        "n_blocks",
        "pos",
        block.alias("block"),
        F.xxhash64(block).alias("h"),
        F.when(F.col("pos") == 0, F.sha2("content", 256)).alias("sha"),
    )


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names of distinct rows: the place within the sorted partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame, block_size: int = 2048, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. Of rows with the same smallest doc_id, the
    first read stays. A null doc_id ranks last. Other columns of the input are ignored. An empty table
    gives an empty result. ``row_col`` names a column of distinct longs; it then orders rows of the same doc_id and
    comes out with the verdicts.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    number = row_col
    if row_col is None:
        # the branches below must number rows alike, as scans of files do; anything else is pinned first
        rows = docs.select(F.col(id_col), F.col(text_col))
        docs, number = (rows, None) if is_scan(rows) else (numbered(rows), "_row")
    blocks = _blocks(docs, block_size, id_col, text_col, number)
    names = _named(blocks.select("h", "block").distinct(), "block").select("h", "name").checkpoint()
    same_hash = names.groupBy("h").count().filter("count > 1").select("h").checkpoint()
    single = names.join(same_hash, "h", "left_anti")
    keep = ("row", "doc_id", "n_blocks", "pos", "sha", "name")
    level = blocks.drop("block").join(single, "h").select(*keep)
    if not same_hash.isEmpty():
        shared = blocks.join(same_hash, "h", "left_semi")
        told = _named(shared.select("h", "block").distinct(), "block").withColumn("name", -1 - F.col("name"))
        level = level.unionByName(shared.join(told, ["h", "block"]).select(*keep))
    level = level.checkpoint()

    heads = level.filter("pos = 0").select("row", "doc_id", "n_blocks", "sha")
    current = level.select("row", "n_blocks", F.col("n_blocks").alias("width"), "pos", "name")
    roots = current.filter("width = 1").select("row", "n_blocks", "name")
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    while longest > 1:
        pairs = (
            current.filter("width > 1")
            .groupBy("row", "n_blocks", "width", F.floor(F.col("pos") / 2).alias("at"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(LAST)).alias("right"),
            )
            .select("row", "n_blocks", F.ceil(F.col("width") / 2).alias("width"), F.col("at").alias("pos"), "left", "right")
        )
        distinct = _named(pairs.select("left", "right").distinct(), "left", "right")
        current = pairs.join(distinct, ["left", "right"]).select("row", "n_blocks", "width", "pos", "name").checkpoint()
        roots = roots.unionByName(current.filter("width = 1").select("row", "n_blocks", "name"))
        longest = -(-longest // 2)

    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    rows = heads.join(roots.withColumnRenamed("n_blocks", "blocks"), "row")
    groups = rows.groupBy("blocks", "name").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["blocks", "name"]).select(
        *([] if row_col is None else [F.col("row").alias(row_col)]),
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
