"""Corpus preparation, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next:
language ID, exact dedup, MinHash near-dedup, mixing to target weights, byte-level BPE. All but the last return
the columns of documents; the last has token_ids in place of the text.

Verdicts are on rows and not on ids, so repeated rows, ids that clash and rows without id are told apart. A null or empty
text has no language and goes in the first stage. Of equal texts, and of linked ones, the row with the smallest doc_id
stays, one without id only where there is no other; of rows that repeat both, the first read. A null source is a
source of its own, and a null lang is evidence of nothing; where no document declares a language, all with letters
pass. Texts may be of any length. An empty table gives an empty result. Columns that documents have besides come along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, exact_dedup, langid, minhash, mixing, registry
from quadrille.llm.rows import free_name, numbered
from quadrille.session import ensure_checkpoint_dir


def _keep(rows: DataFrame, refused: DataFrame, row: str) -> DataFrame:
    """The numbered ``rows`` but for the refused ones, without their numbers."""
    return rows.join(refused.select(row), row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    return _keep(rows, langid.identify_documents(rows, carry=(row,)).filter("NOT kept"), row)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    verdicts = exact_dedup.exact_dedup(rows.select(row, "doc_id", "text"), row_col=row)
    return _keep(rows, verdicts.filter("NOT kept"), row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8. Of linked rows the one with the smallest doc_id stays; null ranks last."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = minhash.near_duplicates(rows.select(row, "text"), id_col=row)
    found = found.select(F.col("doc_id").alias(row), "component_id").checkpoint()
    shared = found.filter(F.col(row) != F.col("component_id")).select("component_id").distinct()
    members = found.join(shared, "component_id", "left_semi").join(rows.select(row, "doc_id"), row)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col(row).alias("row"))
    first = members.groupBy("component_id").agg(F.min(place).alias("first"))
    return _keep(rows, members.join(first, "component_id").filter(F.col(row) != F.col("first.row")), row)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with proof of what they decode to. The copies of the mix follow one another and are encoded once."""
    return bpe.encode(docs, registry.tokenizer_path(), proof=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("mixing", mixing_to_weights),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None  # language ID and BPE are beyond SQL; tests/llm compares run() with a brute-force version


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's output is removed once the next is written; the result reads the last one kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}_{name}")
            docs = spark.read.parquet(f"{place}/{k}_{name}")
            if before:
                _remove(spark, before)
            before = f"{place}/{k}_{name}"
    return docs
