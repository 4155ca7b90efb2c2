"""Fixed-bin histograms with interpolated quantiles, one per key.

Samples are counted per bin before the shuffle; a histogram is one row with its occupied bins in order, at
most as many as the binning has. Bin -1 is underflow, the binning's size is overflow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegerRange:
    """Unit bins over [low, high)."""

    def __init__(self, low: int, high: int):
        if low >= high:
            raise ValueError("low must be below high")
        self.low, self.high, self.size = low, high, high - low

    def bin(self, sample: Column) -> Column:
        return (sample - self.low).cast("long")

    def edge(self, index: Column) -> Column:
        return (index + self.low).cast("double")


class Cuts:
    """Bins between sorted, unique cuts."""

    def __init__(self, cuts: Sequence[float]):
        if len(cuts) < 2 or any(a >= b for a, b in zip(cuts, cuts[1:], strict=False)):
            raise ValueError("at least two cuts, sorted and unique")
        self.cuts, self.low, self.high, self.size = list(cuts), cuts[0], cuts[-1], len(cuts) - 1

    def bin(self, sample: Column) -> Column:
        return (sum(((sample >= c).cast("long") for c in self.cuts[1:]), F.lit(0).cast("long"))).cast("long")

    def edge(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(float(c)) for c in self.cuts]), index.cast("int"))


def histogram(samples: DataFrame, keys: Sequence[str], value: str, binning, weight: str | None = None, overall: bool = False) -> DataFrame:
    """keys, n, low, high (observed), bins (array of bin and weight, in order). Samples of weight 0 or null count nothing.

    With overall there is one more histogram of everything, its keys null: samples are grouped once by the
    sets (keys) and ().
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    v = F.col(value)
    index = F.when(v < binning.low, F.lit(-1).cast("long")).when(v >= binning.high, F.lit(binning.size).cast("long")).otherwise(binning.bin(v))
    rows = samples.where(v.isNotNull()).select(*keys, v.alias("v"), w.alias("w"), index.alias("bin")).where("w > 0")
    first = rows.groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
    if overall and keys:
        all_ = first.groupBy("bin").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))
        first = first.withColumn("all", F.lit(0)).unionByName(all_.withColumn("all", F.lit(1)), allowMissingColumns=True)
        keys = [*keys, "all"]
    return first.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sort_array(F.collect_list(F.struct("bin", "w"))).alias("bins"),
    )


def _ends(index: Column, binning) -> tuple[Column, Column]:
    """Lower and upper end of a bin; the observed extremes end the outer two."""
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    under, over = index == -1, index == binning.size
    inner = F.when(under | over, F.lit(0).cast("long")).otherwise(index)
    a = F.when(under, low).when(over, F.lit(float(binning.high))).otherwise(binning.edge(inner))
    b = F.when(under, F.lit(float(binning.low))).when(over, high).otherwise(binning.edge(inner + 1))
    return a, b


def quantile(q: float, binning) -> Column:
    """Interpolated quantile of a histogram row, rounded down; null when it is empty.

    The bin is the first whose share of samples so far reaches q (for overflow: exceeds q); with none, the
    largest sample.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile is between 0 and 1")
    share = F.lit(float(q))
    n = F.col("n").cast("double")
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("found"))

    def step(s: Column, x: Column) -> Column:
        upto = (s["before"] + x["w"]).cast("double") / n
        hit = F.when(x["bin"] == binning.size, share < upto).otherwise(share <= upto)
        a, b = _ends(x["bin"], binning)
        height, base = x["w"].cast("double") / n, s["before"].cast("double") / n
        inside = F.floor(a + (share - base) * (b - a) / height).cast("double")
        return F.struct((s["before"] + x["w"]).alias("before"), F.coalesce(s["found"], F.when(hit, inside)).alias("found"))

    return F.coalesce(F.aggregate("bins", start, step)["found"], F.col("high").cast("double")).cast("long")


def mean(binning) -> Column:
    """Mean of the bins' midpoints by weight, for whole samples: midpoints and mean are cut to whole numbers."""

    def step(s: Column, x: Column) -> Column:
        a, b = _ends(x["bin"], binning)
        a, b = a.cast("long"), b.cast("long")
        middle = a + F.floor((b - a) / 2)
        return s + middle.cast("long") * x["w"]

    total = F.aggregate("bins", F.lit(0).cast("long"), step)
    return (total / F.col("n")).cast("long")


def quantiles(shares: dict[str, float], binning) -> list[Column]:
    """min, the named quantiles and max."""
    return [F.col("low").alias("min"), *[quantile(q, binning).alias(name) for name, q in shares.items()], F.col("high").alias("max")]


def bins(samples: DataFrame, keys: Sequence[str], value: str, binning, weight: str | None = None) -> DataFrame:
    """keys, bin, w, low, high: a row per occupied bin. Bins of several tables are merged by merged()."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    v = F.col(value)
    index = F.when(v < binning.low, F.lit(-1).cast("long")).when(v >= binning.high, F.lit(binning.size).cast("long")).otherwise(binning.bin(v))
    rows = samples.where(v.isNotNull()).select(*keys, v.alias("v"), w.alias("w"), index.alias("bin")).where("w > 0")
    return rows.groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of bins() of several histograms, or of one in parts, as rows of their sum."""
    return parts.groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))


def summary(parts: DataFrame, keys: Sequence[str], binning, shares: dict[str, float], overall: bool = False) -> DataFrame:
    """keys, n, min, the named quantiles and max from rows of bins(), as quantile() defines them.

    One pass over the bins for all quantiles: running sums by key, then for each quantile the first bin that
    reaches it. A key has as many rows as its histogram has occupied bins. With overall there is one more row for
    everything, its keys null. Without keys, no samples give one row of nulls.
    """
    keys = list(keys)
    if overall and keys:
        parts = parts.withColumn("all", F.lit(0)).unionByName(merged(parts, []).withColumn("all", F.lit(1)), allowMissingColumns=True)
    own = [*keys, "all"] if overall and keys else keys
    every = Window.partitionBy(*own)
    total = F.sum("w").over(every)
    rows = parts.withColumns(
        {
            "n": total,
            "upto": F.sum("w").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "least": F.min("low").over(every),
            "most": F.max("high").over(every),
        }
    )
    n = F.col("n").cast("double")
    upto, base, height = F.col("upto").cast("double") / n, (F.col("upto") - F.col("w")).cast("double") / n, F.col("w").cast("double") / n
    rows = rows.withColumns({"low": F.col("least"), "high": F.col("most")})
    a, b = _ends(F.col("bin"), binning)
    rows = rows.withColumns({"upto": upto, "base": base, "height": height, "a": a, "b": b})
    found = []
    for name, q in shares.items():
        share = F.lit(float(q))
        hit = F.when(F.col("bin") == binning.size, share < F.col("upto")).otherwise(share <= F.col("upto"))
        inside = F.floor(F.col("a") + (share - F.col("base")) * (F.col("b") - F.col("a")) / F.col("height"))
        first = F.min(F.when(hit, F.struct("bin", inside.alias("x"))))["x"].cast("double")
        found.append(F.coalesce(first, F.max("high").cast("double")).cast("long").alias(name))
    out = rows.groupBy(*own).agg(F.max("n").alias("n"), F.min("low").alias("min"), *found, F.max("high").alias("max"))
    return out.drop("all") if own != keys else out


#: Percentiles of the statistics, by their usual names.
SUMMARY = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
DEPTH = {**SUMMARY, "p999": 0.999, "p9999": 0.9999}
ARRIVAL = {
    "p0001": 0.0001, "p001": 0.001, "p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99,
}
