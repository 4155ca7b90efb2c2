"""Inside quotes and depth, from updates with the state of their book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.prices import price_levels


def reported() -> Column:
    """Whether an update is at or better than the inside of its side; of a replace the old price counts."""
    key = F.when(F.col("is_replace"), F.col("old_px")).otherwise(F.col("px"))
    return F.when(F.col("side") == "B", key >= F.col("bid_px")).otherwise(key <= F.col("offer_px"))


def inside_reported(book: DataFrame) -> DataFrame:
    return book.where(reported())


def inside_changed(book: DataFrame) -> DataFrame:
    """Updates after which the best bid or offer, price or quantity, isn't what it was before."""
    before = Window.partitionBy("stock").orderBy("seq")
    quote = F.struct("bid_px", "bid_qty", "offer_px", "offer_qty")
    return book.withColumn("old_quote", F.lag(quote).over(before)).where(
        F.col("old_quote").isNull() | (F.col("old_quote") != quote)
    ).drop("old_quote")


def published(book: DataFrame) -> DataFrame:
    """Updates whose price is the best of their side."""
    return book.where(F.when(F.col("side") == "B", F.col("px") == F.col("bid_px")).otherwise(F.col("px") == F.col("offer_px")))


def inside_line() -> Column:
    """One line of text: time, security, bid and offer."""
    return F.concat_ws(" ", "ts_ns", "stock", "stock", "bid_px", "bid_qty", "offer_px", "offer_qty")


def book_depth() -> Column:
    """Price levels from worst to best, both sides together."""
    return price_levels(F.col("worst_bid_px"), F.col("bid_px")) + price_levels(F.col("offer_px"), F.col("worst_offer_px"))


def event_depth() -> Column:
    """Levels between an update's price and the inside of its side; 0 at or inside it."""
    zero = F.lit(0).cast("long")
    buy = F.when(F.col("px") < F.col("bid_px"), price_levels(F.least("px", "bid_px"), F.col("bid_px"))).otherwise(zero)
    sell = F.when(F.col("px") > F.col("offer_px"), price_levels(F.least("px", "offer_px"), F.col("px"))).otherwise(zero)
    return F.when(F.col("side") == "B", buy).otherwise(sell)


def grid(quotes: DataFrame, step_us: int) -> DataFrame:
    """Best bid and offer of each security at the end of each time step in which it was updated: tick, stock, quotes."""
    tick = F.floor(F.col("ts_us") / step_us).cast("long")
    last = F.max(F.struct("seq", "bid_px", "bid_qty", "offer_px", "offer_qty")).alias("q")
    return quotes.groupBy("stock", tick.alias("tick")).agg(last).select(
        "stock", "tick", "q.bid_px", "q.bid_qty", "q.offer_px", "q.offer_qty"
    )
