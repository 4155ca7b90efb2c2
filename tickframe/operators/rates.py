"""Event rates over a trailing window, as steps: how long which rate held.

A window of N sampling ticks counts the events of its ticks. Each occupied tick adds its events at once and
takes them away N ticks later; between those breakpoints the rate stays, so no tick is expanded and fine
sampling costs nothing. Late events count in the tick that was current when they came.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.numbers import floor_div
from tickframe.sources.shared import kept


def window_ticks(measurement: int, sampling: int) -> int:
    if sampling <= 0 or measurement < sampling or measurement % sampling:
        raise ValueError("the measurement period must be a positive multiple of the sampling period")
    return measurement // sampling


def rate_steps(events: DataFrame, keys: Sequence[str], time: str, order: str, measurement: int, sampling: int) -> DataFrame:
    """keys, tick, rate, weight: the rate that holds for weight ticks from tick on.

    The first event only starts the clock, and the last, open tick gives no rate: weights sum to the last
    tick less the first. Windows are by key; without keys current ticks and rates are found in two steps,
    within ranges of about RANGE_ROWS rows and then over the ranges, so that no task sees all events.
    """
    n = window_ticks(measurement, sampling)
    tick = floor_div(F.col(time), sampling)
    rows = events.where(F.col(time).isNotNull()).select(*keys, F.col(order).alias("o"), tick.alias("t"))
    most = None if keys else rows.count()
    if keys:
        current = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = rows.withColumn("tick", F.max("t").over(current))
    else:
        placed = _running_max(rows, most)
    counts = placed.groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias("events"))
    if not keys and most > RANGE_ROWS:
        counts = kept(counts, "counts")
    change = lambda t, d: F.struct(t.alias("tick"), d.alias("change"))
    both = F.explode(F.array(change(F.col("tick"), F.col("events")), change(F.col("tick") + n, -F.col("events"))))
    ends = counts.select(*keys, both.alias("x")).groupBy(*keys, "x.tick").agg(F.sum("x.change").alias("change"))
    last = counts.groupBy(*keys).agg(F.max("tick").alias("last")) if keys else counts.agg(F.max("tick").alias("last"))
    joined = ends.join(last, list(keys)) if keys else _over_ranges(ends, 2 * most if most <= RANGE_ROWS // 2 else None).crossJoin(F.broadcast(last))  # one row
    if not keys:
        by, base, next_ = Window.partitionBy("part").orderBy("tick"), F.col("base"), F.col("next_tick")
    else:
        by, base, next_ = Window.partitionBy(*keys).orderBy("tick"), F.lit(0), F.col("last")
    steps = joined.withColumn("rate", base + F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "until", F.least(F.coalesce(F.lead("tick").over(by), next_, F.col("last")), F.col("last"))
    )
    return steps.where("tick < last").select(*keys, "tick", "rate", (F.col("until") - F.col("tick")).alias("weight")).where("weight > 0")


#: Rows of a range that one task takes in order, about, and the places between which ranges can end.
RANGE_ROWS, CUTS = 500_000, 4_096


def with_part(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """rows with part, the range of the column by; ranges have about as many rows each. most is a known bound of the rows.

    Rows that fit one range are counted and left as they are; more are written once, and one aggregate over what was
    written finds the ranges' ends.
    """
    if (rows.count() if most is None else most) <= RANGE_ROWS:
        return rows.withColumn("part", F.lit(0))
    rows = kept(rows, "ordered")
    shares = ", ".join(f"{k / CUTS}D" for k in range(1, CUTS))  # as text: a call for each literal would take seconds
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(`{by}`, array({shares}), {4 * CUTS})").alias("cuts")).first()
    ranges = min(CUTS, -(-found["n"] // RANGE_ROWS))
    cuts = sorted({found["cuts"][k * CUTS // ranges - 1] for k in range(1, ranges)})
    # places in a sorted list, by halving
    return rows.withColumn("part", _place(F.col(by), cuts, 0, len(cuts)))


def _place(x: Column, cuts: list, low: int, high: int) -> Column:
    """How many of the sorted cuts from low to high are below x, plus low."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x > cuts[middle], _place(x, cuts, middle + 1, high)).otherwise(_place(x, cuts, low, middle))


def _over_ranges(ends: DataFrame, most: int | None) -> DataFrame:
    """ends (tick, change) with part, base (the sum of all changes of earlier parts) and next_tick (the first tick of the next part)."""
    dealt = with_part(ends, "tick", most)
    sums = dealt.groupBy("part").agg(F.sum("change").alias("sum"), F.min("tick").alias("first"))
    in_order = Window.orderBy("part")  # one row per range
    base = F.coalesce(F.sum("sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    return dealt.join(F.broadcast(sums.select("part", base, F.lead("first").over(in_order).alias("next_tick"))), "part")


def _running_max(rows: DataFrame, most: int) -> DataFrame:
    """tick: the largest t so far in the order of o."""
    dealt = with_part(rows, "o", most)
    tops = dealt.groupBy("part").agg(F.max("t").alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    floors = tops.select("part", F.max("top").over(before).alias("floor"))
    current = Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(floors), "part").withColumn("tick", F.greatest(F.max("t").over(current), F.col("floor")))


def interarrival(events: DataFrame, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """keys, order, gap: time since the event before; it may be negative, and the first event has none."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return events.select(*keys, order, gap.alias("gap")).where("gap is not null")
