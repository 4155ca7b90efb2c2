"""Lines of text, as feeds' tools print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.functions.prices import price_text


def trade_line() -> Column:
    """A trade message in one line: time, order, side, shares, security, price, match."""
    return F.concat_ws(" ", "ts_ns", "order_id", "side", "shares", "stock", price_text(F.col("px")), "match")
