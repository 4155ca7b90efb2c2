"""Statistics of a feed and of book depth, a row per security and one for everything, ready for CSV.

The column names and percentiles are fixed by the format. Securities without samples have NSamples 0 and
blanks. Processing times come from an optional column; without it they are blank, since they can't be
worked out later.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.decode import view
from tickframe.operators.histogram import ARRIVAL, DEPTH, IntegerRange, bins, summary
from tickframe.operators.rates import interarrival, rate_steps, with_part
from tickframe.sources.shared import kept

AGGREGATE = "__aggregate__"
SECOND = 1_000_000_000
# Periods, maxima and percentiles of the format.
#: Name, measurement and sampling period in ns, largest rate with a bin of its own.
RATES = (
    ("RatePerSec", SECOND, 1_000_000, 1_000_000),
    ("RatePerMSec", 1_000_000, 1_000, 100_000),
    ("RatePerUSec", 1_000, 1, 100_000),
)
ARRIVAL_MAX, PROCESSING_MAX = 100_000, 1_000_000
PROCESSING = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


def _named(samples: DataFrame, value: str, binning: IntegerRange, shares: dict[str, float], suffix: str, weight: str | None = None) -> DataFrame:
    return named(bins(samples, ["Name"], value, binning, weight), binning, shares, suffix)


def named(parts: DataFrame, binning: IntegerRange, shares: dict[str, float], suffix: str) -> DataFrame:
    """Name and the percentiles of rows of bins by Name, their names with the suffix."""
    rows = summary(parts, ["Name"], binning, shares)
    return rows.select("Name", *[F.col(n).alias(f"{n}{suffix}") for n in ("min", *shares, "max")])


def _twice(rows: DataFrame, name: Column) -> DataFrame:
    """Every row for its own name and for everything."""
    return rows.withColumn("Name", F.explode(F.array(name.cast("string"), F.lit(AGGREGATE))))


def feed_statistics(events: DataFrame, name: str, time: str, order: str, processing: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Name, NSamples, rates per second, millisecond and microsecond, inter-arrival and processing times in ns.

    names, a table with a column Name, adds securities without samples. Rates and gaps of everything are
    those of the whole feed in its order, not sums over securities.
    """
    rows = events.select(F.col(name).cast("string").alias("Name"), F.col(time).alias("t"), F.col(order).alias("o"), *([F.col(processing).alias("p")] if processing else []))
    rows = kept(rows, "events")  # read several times
    parts = [_twice(rows, F.col("Name")).groupBy("Name").agg(F.count(F.lit(1)).alias("NSamples"))]
    for suffix, measurement, sampling, most in RATES:
        own = rate_steps(rows, ["Name"], "t", "o", measurement, sampling)
        whole = rate_steps(rows, [], "t", "o", measurement, sampling).withColumn("Name", F.lit(AGGREGATE))
        parts.append(_named(own.unionByName(whole), "rate", IntegerRange(0, most), DEPTH, suffix, "weight"))
    gaps = interarrival(rows, ["Name"], "t", "o").select("Name", "gap").unionByName(
        ordered_gaps(rows).select(F.lit(AGGREGATE).alias("Name"), "gap")
    )
    parts.append(_named(gaps, "gap", IntegerRange(0, ARRIVAL_MAX), ARRIVAL, "Arrival"))
    if processing:
        parts.append(_named(_twice(rows, F.col("Name")), "p", IntegerRange(0, PROCESSING_MAX), PROCESSING, "Processing"))
    out = reduce(lambda a, b: a.join(b, "Name", "left"), parts)
    if not processing:
        out = out.withColumns({f"{n}Processing": F.lit(None).cast("long") for n in ("min", *PROCESSING, "max")})
    return _with_empty(out, names)


def ordered_gaps(rows: DataFrame) -> DataFrame:
    """gap: times between events (o, t) of the whole feed: within ranges of the order, and between one range's end and the next one's start."""
    rows = with_part(rows, "o")
    inner = interarrival(rows, ["part"], "t", "o").select("gap")
    ends = rows.groupBy("part").agg(F.min(F.struct("o", "t")).alias("first"), F.max(F.struct("o", "t")).alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))  # a row per range
    return inner.unionByName(ends.select((F.col("first.t") - before["t"]).alias("gap")).where("gap is not null"))


def directory_names(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Name: the securities that a feed's directory messages announce, whether or not anything comes of them."""
    return view(raw, "R", "PERMISSIVE", payload).select(F.col("stock").alias("Name")).distinct()


def depth_statistics(depths: DataFrame, name: str, value: str, most: int = 8192, names: DataFrame | None = None) -> DataFrame:
    """Name, NSamples and percentiles of book depth."""
    rows = _twice(depths.select(F.col(name).alias("own"), F.col(value).alias("v")), F.col("own"))
    counts = rows.groupBy("Name").agg(F.count("v").alias("NSamples"))
    return _with_empty(counts.join(_named(rows, "v", IntegerRange(0, most), DEPTH, "BookDepth"), "Name", "left"), names)


def _with_empty(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return rows
    every = names.select(F.col("Name").cast("string")).distinct().unionByName(rows.select("Name")).distinct()
    return every.join(rows, "Name", "left").withColumn("NSamples", F.coalesce("NSamples", F.lit(0))).select(*rows.columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """Sorted by name, the row for everything last, with a header."""
    rows.orderBy(F.col("Name") == AGGREGATE, "Name").write.csv(path, header=True)
