"""Order statistics without a sort: the k-th smallest value of each group, by narrowing brackets.

A bracket holds the value that is looked for. Each round cuts every bracket into CELLS equal parts, counts the rows
of each part, exactly and before the shuffle, and keeps the part in which the rank falls. A bracket that is down to
FEW rows, or to one value, is settled: only its rows are ever ranked. The rounds read the rows again and shuffle
counts; skewed values only cost a round more, since a bracket shrinks by CELLS each time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.sources.shared import kept

CELLS, FEW, ROUNDS = 4_096, 10_000, 64
#: Brackets up to this many, a few numbers each, are broadcast; more are joined by shuffle.
BROADCAST = 50_000


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """keys, k and value: the k-th smallest value (k from 0) of each group, for wanted (keys, k).

    Null and NaN values are left out. A k beyond the group's rows, or a group without rows, gives no row. Repeated
    rows of wanted count once. rows is read once per round; pass a table or a cheap plan.
    """
    keys = list(keys)
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"), F.col(value).alias("x"))
    ends = values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    open_ = wanted.select(*keys, F.col("k").cast("long").alias("k")).distinct()
    open_ = (open_.join(ends, keys) if keys else open_.crossJoin(F.broadcast(ends))).where("k >= 0 and k < n")  # one row without keys
    # base: how many rows are below the bracket; n: how many are in it
    open_ = kept(open_.select(*keys, "k", "low", "high", F.lit(0).cast("long").alias("base"), "n"), "brackets")
    done = []
    for _ in range(ROUNDS):
        settled = (F.col("n") <= FEW) | (F.col("low") == F.col("high"))
        done.append(open_.where(settled))
        open_ = open_.where(~settled)
        if open_.isEmpty():
            break
        cells = open_.select(*keys, "low", "high").distinct()
        width = (F.col("high") - F.col("low")) / CELLS
        cell = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(CELLS - 1)).alias("cell")
        counts = _inside(values, cells, keys).groupBy(*keys, "low", "high", cell).agg(
            F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        before = Window.partitionBy(*keys, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("under", F.coalesce(F.sum("rows").over(before), F.lit(0)))  # CELLS rows at most
        hit = (F.col("k") >= F.col("base") + F.col("under")) & (F.col("k") < F.col("base") + F.col("under") + F.col("rows"))
        found = open_.join(counts, [*keys, "low", "high"]).where(hit)
        found = found.select(*keys, "k", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("base") + F.col("under")).alias("base"), F.col("rows").alias("n"))
        open_ = kept(found, "brackets")
    else:
        raise RuntimeError(f"brackets did not close in {ROUNDS} rounds")
    left = done[0]
    for d in done[1:]:
        left = left.unionByName(d)
    left = kept(left, "settled")
    # a bracket of one value needs no rank, whatever rows it has
    single = left.where("low = high")
    few = left.where("low <> high")
    ranked = _inside(values, few.select(*keys, "low", "high").distinct(), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "low", "high").orderBy("v")) - 1
    out = ranked.withColumn("place", place.cast("long")).join(few, [*keys, "low", "high"]).where("place = k - base").select(*keys, "k", "x")
    # the value itself, in its own type
    kind = dict(rows.dtypes)[value]
    out = out.unionByName(single.select(*keys, "k", F.col("low").cast(kind).alias("x")))
    return out.withColumnRenamed("x", value)


def _inside(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of values within each bracket of their group."""
    small = brackets.limit(BROADCAST + 1).count() <= BROADCAST
    right = F.broadcast(brackets) if small else brackets
    b = [F.col(f"r.{c}") for c in ("low", "high")]
    test = (F.col("l.v") >= b[0]) & (F.col("l.v") <= b[1])
    for c in keys:
        test = test & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return values.alias("l").join(right.alias("r"), test).select("l.*", *b)
