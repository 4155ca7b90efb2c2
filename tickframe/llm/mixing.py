"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets follow by water-filling, and every document is then taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm.common import small, table, word_count, written

#: The weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
#: Tables of sources up to this many rows (a few hundred bytes each) are broadcast.
BROADCAST_SOURCES = 10_000


def coin(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the key and the seed; the same in every run."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
    source: str = "source",
) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    The sources share budget times the size of everything by weight. No target exceeds cap times the
    source's size; what a source can't take goes to the others by weight until none is above: in order
    of cap / weight, the sources that stop are a prefix. The two windows see one row per source, already
    summed; documents are summed before any shuffle. A null source is a source, the last one in order.
    Sources without words have target and rate 0.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(in_order) - 1
    weighed = sums.select("source", "source_size", F.get(choices, rank % len(weights)).alias("weight")).withColumn(
        "most", F.lit(float(cap)) * F.col("source_size")
    )
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    stops = F.col("most") <= F.col("level") * F.col("weight")
    # the level of the first source that doesn't stop holds for all after it
    level = F.first(F.when(~stops, F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(stops | level.isNull(), F.col("most")).otherwise(level * F.col("weight"))
    filled = levels.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return filled.select("source", "source_size", "weight", "target", rate.alias("rate"))


def mix(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    seed: str = "mix-1",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the document).

    Null, empty and very long texts count as any other; a document without words can be taken too, which
    adds nothing to the size. Rows that repeat a key share the key's coin. An empty table gives an empty
    result. Columns of docs stay, but for such as have the names of the new ones.
    """
    docs = docs.drop("mix_size", "mix_source", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    targets = written(source_targets(docs, size, weights, budget, cap, source), "mix-sources").select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("rate").alias("mix_rate"),
    )
    joined = docs.withColumn("mix_size", size).join(
        small(targets, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("mix_source"))
    )
    whole = F.floor("mix_rate")
    extra = (coin(F.col(key), seed) < F.col("mix_rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).drop("mix_source", "mix_rate")


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken, without the columns that the mix added."""
    taken = mixed.where(F.col("mix_copies") > 0)
    copies = taken.withColumn("mix_copy", F.explode(F.expr("sequence(1, mix_copies)")))
    return copies.drop("mix_copy", "mix_copies", "mix_size", "mix_source_size", "mix_target")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, word_count(F.col("text"))).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight,
         2.0::DOUBLE * source_size AS most
  FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), filled AS (
  SELECT source, source_size,
         CASE WHEN most <= level * weight THEN most
              ELSE weight * first_value(CASE WHEN most > level * weight THEN level END IGNORE NULLS)
                   OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         END AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM filled
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT
                                  / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""
