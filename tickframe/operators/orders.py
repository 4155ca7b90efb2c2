"""Order lifecycles: from messages to accepted book updates.

lifecycle() is declarative, for feeds in which a message refers to the last order that its security created:
every window is by security, so the messages are shuffled once. tickframe.operators.fold follows arbitrary
references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A delete asks for more than any order has.
EVERYTHING = 1 << 40


def lifecycle(feed: DataFrame) -> DataFrame:
    """Messages with what they do: accepted, side, px, qty (signed), left (shares of the order after it), old_px, old_qty.

    An add opens a chain, a replace continues it if the order before still has shares. Reductions take at
    most what is left; one that finds nothing is not accepted, and neither is anything that refers to an
    order that never lived. A replace inherits the side, and is one update with the old price and quantity.
    """
    by_stock = Window.partitionBy("stock").orderBy("seq")
    so_far = by_stock.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    creates, adds = F.col("order_id").isNotNull(), F.col("type") == "A"
    blocks = feed.withColumn("block", F.sum(creates.cast("int")).over(so_far)).withColumn("chain", F.sum(adds.cast("int")).over(so_far))
    in_block = Window.partitionBy("stock", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.when(creates, F.lit(0)).when(F.col("type") == "D", F.lit(EVERYTHING)).otherwise(F.col("shares")).cast("long")
    first = lambda c: F.first(c).over(in_block)
    taken = blocks.withColumn("asked", asked).withColumn("sum_asked", F.sum("asked").over(in_block))
    taken = taken.withColumn("size", first(F.when(F.col("order_id").isNotNull(), F.col("shares")))).withColumn(
        "order_px", first(F.when(F.col("order_id").isNotNull(), F.col("px")))
    )
    zero = F.lit(0).cast("long")
    left = F.greatest(F.coalesce("size", zero) - F.col("sum_asked"), zero)
    found = F.greatest(F.coalesce("size", zero) - (F.col("sum_asked") - F.col("asked")), zero)
    state = taken.withColumn("left", left).withColumn("found", found)
    state = state.withColumn("old_left", F.lag("left").over(by_stock)).withColumn("old_px", F.lag("order_px").over(by_stock))
    in_chain = Window.partitionBy("stock", "chain").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    replaced = F.when(F.col("type") == "U", (F.coalesce("old_left", zero) > 0).cast("int")).otherwise(F.lit(1))
    lives = (F.min(replaced).over(in_chain) == 1) & (F.col("chain") > 0)
    state = state.withColumn("lives", lives).withColumn("chain_side", F.first("side").over(in_chain))
    accepted = F.col("lives") & (creates | (F.col("found") > 0))
    replace = F.col("type") == "U"
    qty = F.when(creates, F.col("shares")).otherwise(-F.least("asked", "found"))
    return state.select(
        "seq",
        "ts_us",
        "ts_ns",
        "stock",
        "type",
        accepted.alias("accepted"),
        F.col("chain_side").alias("side"),
        F.col("order_px").alias("px"),
        qty.alias("qty"),
        "left",
        replace.alias("is_replace"),
        F.when(replace, F.col("old_px")).otherwise(zero).alias("old_px"),
        F.when(replace, F.col("old_left")).otherwise(zero).alias("old_qty"),
        "order_id",
        "ref",
        "chain",
        "shares",
    )


def updates(states: DataFrame) -> DataFrame:
    """Accepted book updates: seq, ts_us, ts_ns, stock, side, px, qty, is_replace, old_px, old_qty."""
    return states.where("accepted").select(
        "seq", "ts_us", "ts_ns", "stock", "side", "px", "qty", "is_replace", "old_px", "old_qty"
    )


def deltas(accepted: DataFrame) -> DataFrame:
    """Changes of price levels: seq, sub, stock, side, px, delta. A replace first takes the old quantity, then adds the new."""
    step = lambda sub, px, delta: F.struct(F.lit(sub).alias("sub"), px.alias("px"), delta.alias("delta"))
    both = F.array(step(0, F.col("old_px"), -F.col("old_qty")), step(1, F.col("px"), F.col("qty")))
    steps = F.when(F.col("is_replace"), both).otherwise(F.array(step(0, F.col("px"), F.col("qty"))))
    return accepted.select("seq", "stock", "side", F.explode(steps).alias("x")).select(
        "seq", "x.sub", "stock", "side", "x.px", "x.delta"
    )
