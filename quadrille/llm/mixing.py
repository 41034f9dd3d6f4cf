"""Mixing sources to target weights (operator 7); DataFrame functions only.

Sizes are summed per source (combined before the shuffle, so a source that holds a third of all rows costs
no more than another). Targets follow by water filling over the small table of sources. A document is
then emitted floor(rate) times, and once more with probability rate - floor(rate), decided by a hash of its
doc_id and the seed: no state, no order, and the same result in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
SMALL = 8 << 20  # bytes of the table of sources, up to which it is broadcast


def word_count(text: Column) -> Column:
    """Maximal runs outside ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2
) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. Together they get ``percent`` of
    all sizes; a target stops at ``most`` times its source's size and what is over is shared again by
    weight. Sharing again until none is above is water filling: with sources ordered by cap per weight, a
    source is capped if what is left, shared by the weight that is left, reaches its cap.
    """
    # One row per source: the windows below run over the table of sources, not over documents.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    )
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything) * percent)
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)) * 100)
        .withColumn("weight_left", F.sum("weight").over(rest))
    )
    # doubles: a product of corpus size and weights can pass the range of a long
    left = (F.col("total") - F.col("capped_before")).cast("double")
    full = left * F.col("weight") >= F.col("cap").cast("double") * F.col("weight_left") * 100
    # capped sources are a prefix of the order, so the first open one fixes the share of all open ones
    open_ = ranked.withColumn("full", full).withColumn("left", left)
    first_left = F.max(F.when(~F.col("full"), F.col("left"))).over(everything)
    first_weight = F.max(F.when(~F.col("full"), F.col("weight_left"))).over(everything)
    share = first_left * F.col("weight") / (first_weight * 100)
    return open_.withColumn("share", share).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("share")).alias("target"),
    )


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = 150,
    most: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies (how often the mix emits the row).

    Null texts have size 0. Null is a source of its own. Repeated rows share their coin; a row without id takes its text's. A source of size 0 gets
    target 0 and its rows are not emitted. An empty table gives an empty result.
    """
    sized = docs.withColumn("_size", word_count(F.col(text_col)))
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_size").alias("source_size")).checkpoint()
    targets = source_targets(sizes, weights, percent, most).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    weight = F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)
    small = (sizes.agg(weight).first()[0] or 0) <= SMALL
    # texts stay where they are while the table of sources is small; beyond that, AQE splits the hot sources of a join
    joined = sized.join(F.broadcast(targets) if small else targets, sized[source_col].eqNullSafe(targets["_source"])).drop("_source")
    whole = F.floor(rate)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")))
    extra = (coin(key, seed) < rate - whole).cast("long")
    return joined.withColumn("_copies", whole.cast("long") + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as planned, with its own columns only."""
    plan = mix_plan(docs, **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return plan.filter("_copies > 0").select(*[plan[c] for c in docs.columns], copies).drop("_copy")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    id_col = options.get("id_col", "doc_id")
    columns = {options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    plan = mix_plan(docs.select(*sorted(columns)), **options)
    return plan.select(
        F.col(id_col).alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS key, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 2 * source_size AS cap FROM s),
o AS (
  SELECT *, sum(source_size) OVER () * 150 AS total,
         coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 AS capped_before,
         sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w WINDOW r AS (ORDER BY cap / weight, place)),
f AS (SELECT *, (total - capped_before)::DOUBLE * weight >= cap::DOUBLE * weight_left * 100 AS is_full FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (max(CASE WHEN NOT is_full THEN total - capped_before END) OVER ()::DOUBLE * weight)
                   / (max(CASE WHEN NOT is_full THEN weight_left END) OVER () * 100)::DOUBLE END AS target
  FROM f),
j AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
