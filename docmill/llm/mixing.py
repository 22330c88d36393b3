"""Mixing of sources to target weights (operator 4).

Every document gets a hash-random key. The key's leading hex digits cut each source into ranges of equal expected
size, so even a source with a third of all rows is sorted and summed range by range, in many tasks. Sums of ranges
give each range its start, a window inside the range gives each document the words before it, and the source's budget
cuts exactly at a word: whole epochs first, then the documents up to the budget, the last of them in part.

Defined cases: null texts have size 0; null is a source of its own, the last one; a source of size 0 has target 0;
an empty table gives an empty result; repeated rows are mixed as rows of their own; ties of the key go by id, then
size; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD
from docmill.session import checkpointed


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], index: str) -> DataFrame:
    """``df`` with the sums of columns over all rows before each, and its position from 0, in a total order.

    Rows are dealt out by range; only one row for each range is summed in one place.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    of_range = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = of_range.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in sums],
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    rows_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, "_range").select(
        *df.columns,
        (F.col("_first") + F.row_number().over(inside) - 1).alias(index),
        *[(F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(rows_before), F.lit(0))).alias(name) for c, name in sums.items()],
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sizes`` (_none, _source, source_size) with the target of each source: ``share`` of all words, by weight, none
    above ``most`` times its source's size.

    Weights repeat along the sources in code-point order, null last. What a full source leaves over goes to the
    others by weight, so targets are min(limit, level * weight) with one level for all: with sources in order of
    limit / weight, the highest level that any place in that order gives.
    """
    ranked = running_sums(sizes, [F.col("_none"), F.col("_source")], {}, "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("_weight", weight.cast("long")).withColumn("_limit", most * F.col("source_size"))
    filled = running_sums(limits, [F.col("_limit") / F.col("_weight"), F.col("_rank")], {"_limit": "_limits", "_weight": "_weights"}, "_at")
    words, of_all = limits.agg(F.sum("source_size"), F.sum("_weight")).first()
    place = (F.lit(share * (words or 0)) - F.col("_limits")) / (F.lit(of_all or 1) - F.col("_weights"))
    level = filled.agg(F.max(place)).first()[0]
    target = F.least(F.col("_limit").cast("double"), F.lit(level or 0.0) * F.col("_weight"))
    return limits.select("_none", "_source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", digits: int = 3
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs``: the words the mix takes of it.

    ``digits`` hex digits of the key make the ranges of a source (3: 4,096 ranges).
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))).cast("binary"))
    rows = checkpointed(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("_none"),
            F.coalesce("source", F.lit("")).alias("_source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("_key"),
        ).withColumn("_range", F.substring("_key", 1, digits))
    )
    source, part = ["_none", "_source"], ["_none", "_source", "_range"]
    ranges = rows.groupBy(*part).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy(*source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    targets = source_targets(ranges.groupBy(*source).agg(F.sum("_words").alias("source_size")), weights, share, most)
    inside = Window.partitionBy(*part).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts.join(targets, source), part)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_inside")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0)))
    named = F.when(~F.col("_none"), F.col("_source"))
    return placed.select("doc_id", named.alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


#: {rows}: the relation with doc_id, source and text.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), md5(text), ''))) AS key
  FROM {rows}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM per),
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER p, 0)::DOUBLE AS limits, coalesce(sum(w) OVER p, 0)::DOUBLE AS ws,
         sum(source_size) OVER ()::DOUBLE AS every, sum(w) OVER ()::DOUBLE AS every_w
  FROM weighted WINDOW p AS (ORDER BY 2 * source_size / w::DOUBLE, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((1.5::DOUBLE * every - limits) / (every_w - ws)) AS lev FROM filled),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, lev * w) AS target FROM weighted, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + least(size, greatest(budget - epochs * source_size - before, 0)))::BIGINT AS taken
FROM cut
"""
