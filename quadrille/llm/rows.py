"""Numbers for rows, which all scans of a table repeat; and shuffles that several jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a deterministic projection or selection of a table of files: each evaluation reads the same rows in
    the same partitions."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number of each row's own that all later scans repeat; ``name`` is none of its columns.

    A table of files has it from a row's file and its place there; any other is checkpointed with it.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return docs.withColumn(name, F.monotonically_increasing_id()).checkpoint()
    file, place, number = (free_name(docs, c) for c in ("_file", "_place", "_number"))
    rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = sorted(r[0] for r in rows.select(file).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{number} long, {file} string")
    return rows.join(F.broadcast(numbers), file).select(*docs.columns, (F.col(number) * (1 << 40) + F.col(place)).alias(name))


def shuffled_once(docs: DataFrame) -> DataFrame:
    """``docs``, with shuffles that run now and that all later jobs read, where each would else write its own.

    They stay while the result is in use. What is lost of them is made again from what ``docs`` reads.
    """
    spark, jvm = docs.sparkSession, docs.sparkSession._jvm
    sql, query = jvm.org.apache.spark.sql, docs._jdf.queryExecution()
    rows, plan = query.toRdd(), query.executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()  # as it ran; the adaptive node itself tells no partitioning
    parts, none = plan.outputPartitioning(), getattr(getattr(jvm.scala, "None$"), "MODULE$")
    while parts.getClass().getSimpleName() == "PartitioningCollection":
        parts = parts.partitionings().head()
    scan = sql.execution.LogicalRDD(plan.output(), rows, parts, plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(getattr(getattr(sql.classic, "Dataset$"), "MODULE$").ofRows(spark._jsparkSession, scan), spark)
