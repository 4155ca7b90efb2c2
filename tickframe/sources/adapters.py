"""A market-data feed from the events table.

Each event is a message: view adds a buy order, signup a sell order, purchase executes, error deletes and
click replaces. The user is the security, the event's id its order's id, and a message refers to the last
order that its user created.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TYPES = {"view": "A", "signup": "A", "purchase": "E", "error": "D", "click": "U"}
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = F.date_part(F.lit("SECOND"), ts)
    return day * DAY_US + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (second * 1_000_000).cast("long")


def feed(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """Messages: seq, ts_us, ts_ns (since midnight), stock, type, side, order_id, ref, px, shares.

    px is the value in whole cents, or with exact in hundredths of a cent. The one window is by stock.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    px = F.round(F.col("value") * (10_000 if exact else 100)).cast("long")
    us = micros(F.col("ts"))
    messages = events.select(
        F.col("event_id").alias("seq"),
        us.alias("ts_us"),
        (F.pmod(us, F.lit(DAY_US)) * 1000).alias("ts_ns"),
        F.col("user_id").alias("stock"),
        F.element_at(kind, F.col("event_type")).alias("type"),
        F.when(F.col("event_type") == "view", "B").when(F.col("event_type") == "signup", "S").alias("side"),
        F.when(F.col("event_type").isin("view", "signup", "click"), F.col("event_id")).alias("order_id"),
        (px if exact else px * 100).alias("px"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") + 1).alias("shares"),
    )
    before = Window.partitionBy("stock").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn(
        "ref", F.when(F.col("side").isNull(), F.last("order_id", ignorenulls=True).over(before))
    )
