"""Prices as raw integers, 10,000 to the dollar, and their levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One dollar; below it a level is one raw unit, above it a cent.
UNIT = 10_000
CENT = 100
MOST = 2_000_000_000
#: What an empty side quotes: (price, quantity).
EMPTY_BID, EMPTY_OFFER = (0, 0), (MOST, 0)


def price_levels(low: Column, high: Column) -> Column:
    """Number of levels from low to high; an error if high is below low."""
    one = F.lit(UNIT).cast("long")
    zero = F.lit(0).cast("long")
    fine = F.greatest(F.least(high, one) - low, zero)
    coarse = F.floor(F.greatest(high - F.greatest(low, one), zero) / CENT)
    return F.when(high < low, F.raise_error(F.lit("invalid price range"))).otherwise(fine + coarse).cast("long")


def level_to_price(level: Column) -> Column:
    """The price of a level counted from 0; an error outside 0 to the level of the highest price."""
    top = UNIT + (MOST - UNIT) // CENT
    price = F.when(level <= UNIT, level).otherwise((level - UNIT) * CENT + UNIT)
    return F.when((level < 0) | (level > top), F.raise_error(F.lit("invalid price level"))).otherwise(price).cast("long")


def penny_price(price: Column) -> Column:
    """The price at which a book with one-cent levels above a dollar shows an order."""
    return F.when(price < UNIT, price).otherwise(price - price % CENT).cast("long")


def price_text(price: Column, digits: int = 4) -> Column:
    """Whole and fraction, the fraction padded with zeros."""
    scale = F.lit(10**digits).cast("long")
    whole = F.floor(price / scale) if digits < 8 else (price - price % scale) / scale
    return F.concat_ws(".", whole.cast("long").cast("string"), F.lpad((price % scale).cast("string"), digits, "0"))


def time_text(ns: Column) -> Column:
    """HHMMSS.nnnnnnnnn of nanoseconds since midnight."""
    seconds = F.floor(ns / 1_000_000_000).cast("long")
    part = lambda value, size: F.lpad(value.cast("string"), size, "0")
    return F.concat(
        part(F.floor(seconds / 3600), 2),
        part(F.floor(seconds / 60) % 60, 2),
        part(seconds % 60, 2),
        F.lit("."),
        part(ns % 1_000_000_000, 9),
    )


def elapsed_text(us: Column, mode: str = "colons") -> Column:
    """Microseconds as HHMMSS (seconds), HHMMSS.uuuuuu (micros) or HH:MM:SS.uuuuuu (colons)."""
    seconds = F.floor(us / 1_000_000).cast("long")
    part = lambda value, size: F.lpad(value.cast("string"), size, "0")
    fields = [part(F.floor(seconds / 3600), 2), part(F.floor(seconds / 60) % 60, 2), part(seconds % 60, 2)]
    whole = F.concat_ws(":" if mode == "colons" else "", *fields)
    return whole if mode == "seconds" else F.concat_ws(".", whole, part(us % 1_000_000, 6))


def seconds_text(seconds: Column) -> Column:
    """HH:MM:SS."""
    return F.substring(elapsed_text(seconds.cast("long") * 1_000_000), 1, 8)
