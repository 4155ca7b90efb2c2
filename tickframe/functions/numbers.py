"""Numbers from text, powers of two, and comparison with tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_long(text: Column) -> Column:
    """A whole number, if all of the text is one (an optional sign and digits); else null."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))


def to_double(text: Column) -> Column:
    """A number, if all of the text is one, without blanks around it; else null."""
    return F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is at least n, for n from 1 to 2^62; smaller n give 1."""
    least = F.greatest(n.cast("long"), F.lit(1).cast("long"))
    return F.pow(F.lit(2.0), F.when(least == 1, 0).otherwise(F.length(F.bin(least - 1)))).cast("long")


def close_enough(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Whether numbers differ by at most tolerance (whole numbers) or tolerance times the double's epsilon, relative to the larger (others)."""
    whole = (F.typeof(a).isin("tinyint", "smallint", "int", "bigint")) & (F.typeof(b).isin("tinyint", "smallint", "int", "bigint"))
    apart = F.abs(a.cast("double") - b.cast("double"))
    relative = tolerance * 2.0**-52 * F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double")))
    return F.when(whole, apart <= tolerance).otherwise(apart <= relative)


def first_differences(a: Column, b: Column, most: int = 10, tolerance: int = 1) -> Column:
    """Places, and what is there, of the first samples of two arrays that aren't close enough; all that one array has more count as different."""
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    at = F.transform(places, lambda i: F.struct(i.alias("at"), F.get(a, i).alias("a"), F.get(b, i).alias("b")))
    unlike = F.filter(at, lambda x: ~F.coalesce(close_enough(x["a"], x["b"], tolerance), F.lit(False)))
    return F.when(F.greatest(F.size(a), F.size(b)) > 0, F.slice(unlike, 1, most))


def floor_div(x: Column, n: int) -> Column:
    """Whole x by whole n, rounded down, exactly: a plain quotient is a double and takes nanoseconds since 1970 for others."""
    x, by = F.floor(x).cast("long"), F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, by), by)
