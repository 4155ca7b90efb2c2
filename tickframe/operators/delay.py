"""Time series as arrays, and the delay between two of them by circular cross-correlation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sum_square(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def delayed(series: Column, lag: int, periodic: bool | Callable[[Column, Column], Column] = True) -> Column:
    """Each sample lag later; what comes in is the other end, or zero, or what a function of place (below 0 or from the size on) and size says."""
    size = F.size(series)
    at = F.sequence(F.lit(0), size - 1)

    def sample(i: Column) -> Column:
        k = i - lag
        if callable(periodic):
            return F.when((k >= 0) & (k < size), F.get(series, F.greatest(k, F.lit(0)))).otherwise(periodic(k, size))
        if periodic:
            return F.get(series, F.pmod(k, size))
        return F.when((k >= 0) & (k < size), F.get(series, F.greatest(k, F.lit(0)))).otherwise(F.lit(0.0).cast("float"))

    return F.when(size > 0, F.transform(at, sample)).otherwise(series)


def conjugate_multiply(a: Column, b: Column) -> Column:
    """conj(a) * b for arrays of re and im; an error if the sizes differ."""
    one = lambda x, y: F.struct(
        (x["re"] * y["re"] + x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] - x["im"] * y["re"]).alias("im")
    )
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, one)).otherwise(F.raise_error(F.lit("series of different sizes")))


def argmax(series: Column) -> Column:
    """The first index of the largest sample."""
    return (F.array_position(series, F.array_max(series)) - 1).cast("long")


def square(size: int, period: int) -> Column:
    """A test signal: 1 in the first half of each period, else -1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % period < period // 2, 1.0).otherwise(-1.0))


def triangle(size: int, period: int) -> Column:
    """A test signal that rises and falls between -1 and 1."""
    at = lambda i: (i % period) / F.lit(float(period))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(at(i) < 0.5, 4 * at(i) - 1).otherwise(3 - 4 * at(i)))


COMPLEX = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))


def _complex(series: pa.Array) -> list[np.ndarray | None]:
    """Series of numbers, or of structs re and im, as complex arrays; no sample becomes a Python object."""
    offsets, flat = series.offsets.to_numpy(), series.values
    part = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)
    samples = part(flat.field("re")) + 1j * part(flat.field("im")) if pa.types.is_struct(flat.type) else part(flat).astype(complex)
    missing = series.is_null().to_numpy(zero_copy_only=False)
    return [None if m else samples[a:b] for m, a, b in zip(missing, offsets, offsets[1:], strict=False)]


def _transformed(series: pa.Array, how) -> pa.Array:
    """Series of one length are transformed together, PIECE samples or a series at once; null stays null and empty stays empty."""
    rows = _complex(series)
    sizes = np.array([-1 if x is None else len(x) for x in rows], np.int64)
    ends = np.cumsum(np.concatenate([[0], np.maximum(sizes, 0)]))
    out = np.empty(ends[-1], complex)
    for n in np.unique(sizes[sizes > 0]):
        own, step = np.flatnonzero(sizes == n), max(1, PIECE // int(n))
        for some in (own[k : k + step] for k in range(0, len(own), step)):
            for k, x in zip(some, how(np.stack([rows[k] for k in some])), strict=True):
                out[ends[k] : ends[k + 1]] = x
    parts = pa.StructArray.from_arrays([pa.array(out.real.copy()), pa.array(out.imag.copy())], ["re", "im"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=pa.array(sizes < 0))


#: Samples that are transformed at once, about.
PIECE = 1 << 18


@F.arrow_udf(COMPLEX)
def forward_fft(series: pa.Array) -> pa.Array:
    """The discrete Fourier transform of a series of numbers or of structs re and im."""
    return _transformed(series, lambda x: np.fft.fft(x, axis=1))


@F.arrow_udf(COMPLEX)
def backward_fft(series: pa.Array) -> pa.Array:
    """The inverse transform without its factor: forward and backward together give the series times its length."""
    return _transformed(series, lambda x: np.fft.ifft(x, axis=1) * x.shape[1])


def random_series(size: int, seed: int = 0) -> Column:
    """A test signal of samples in [-1, 1), the same for a seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 52)) / F.lit(2.0**51) - 1.0)


_ESTIMATE = T.StructType(
    [T.StructField("found", T.BooleanType()), T.StructField("delay", T.LongType()), T.StructField("confidence", T.DoubleType())]
)


@F.arrow_udf(_ESTIMATE)
def estimate_delay(a: pa.Array, b: pa.Array) -> pa.Array:
    """The delay of b against a, with peak correlation over the sum of squares of a as confidence.

    Series are of numbers or of structs re and im; the correlation's real part counts. Those of a batch that have one
    length are transformed together. A peak that isn't above epsilon, an empty or a null series is not found; series
    of different sizes are an error.
    """
    found, delay, confidence = np.zeros(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a))
    a, b = _complex(a), _complex(b)
    sizes = np.array([-1 if x is None or y is None else len(x) if len(x) == len(y) else -2 for x, y in zip(a, b, strict=True)])
    if (sizes == -2).any():
        raise ValueError("series of different sizes")
    pieces = (own[k : k + step] for n in np.unique(sizes[sizes > 0]) for own, step in [(np.flatnonzero(sizes == n), max(1, PIECE // int(n)))] for k in range(0, len(own), step))
    for rows in pieces:
        n = sizes[rows[0]]
        x, y = (np.stack([s[k] for k in rows]) for s in (a, b))
        if x.imag.any() or y.imag.any():
            peak = np.fft.ifft(np.conj(np.fft.fft(x, axis=1)) * np.fft.fft(y, axis=1), axis=1).real * n
        else:
            peak = np.fft.irfft(np.conj(np.fft.rfft(x.real)) * np.fft.rfft(y.real), n=int(n)) * n
        best, top, power = peak.argmax(axis=1), peak.max(axis=1), (np.abs(x) ** 2).sum(axis=1)
        good = top > np.finfo(np.float64).eps
        found[rows], delay[rows] = good, np.where(good, best, 0)
        confidence[rows] = np.where(power > np.finfo(np.float64).eps, top / np.maximum(power, np.finfo(np.float64).eps), 0.0)
    return pa.StructArray.from_arrays([pa.array(found), pa.array(delay), pa.array(confidence)], ["found", "delay", "confidence"])


def delays(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("x", estimate_delay(F.col(a), F.col(b))).select(
        *[c for c in pairs.columns if c not in (a, b)], "x.found", "x.delay", "x.confidence"
    )


def lag_sums(series: DataFrame, keys: Sequence[str], tick: str, a: Sequence[str], b: Sequence[str], lags: int, block: int = 1 << 16) -> DataFrame:
    """keys, lag, total: for each lag from 0 to lags - 1 the sum over all ticks of the real part of conj(a[t]) * b[t + lag].

    For series longer than a row. a and b name a column each, or two (real and imaginary part); a tick without a
    row, or a null, is 0, rows of one tick add up. Ticks are cut into blocks, each with the lags' overlap of b, that are
    correlated by themselves; their sums are added. A block is the unit of parallel work, whatever the key.
    """
    keys, n = list(keys), max(1, block)
    part = lambda names: [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names] + [F.lit(0.0)] * (2 - len(names))
    rows = series.select(*keys, F.col(tick).cast("long").alias("t"), *[c.alias(x) for c, x in zip(part(a) + part(b), ("are", "aim", "bre", "bim"), strict=True)])
    rows = rows.where("t is not null").groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in ("are", "aim", "bre", "bim")])
    own = F.floor(F.col("t") / n).cast("long")
    first = F.floor((F.col("t") - (lags - 1)) / n).cast("long")
    dealt = rows.select("*", F.explode(F.sequence(first, own)).alias("block"))
    fields = "".join(f"`{c}` {k}, " for c, k in rows.select(*keys).dtypes)

    def correlate(group):
        import pyarrow as pa

        start = group.column("block")[0].as_py() * n
        at = group.column("t").to_numpy() - start
        x, y = np.zeros(n + lags - 1, complex), np.zeros(n + lags - 1, complex)
        inner = at < n
        x[at[inner]] = group.column("are").to_numpy()[inner] + 1j * group.column("aim").to_numpy()[inner]
        y[at] = group.column("bre").to_numpy() + 1j * group.column("bim").to_numpy()
        size = 1 << (2 * len(x) - 1).bit_length()
        sums = np.fft.ifft(np.conj(np.fft.fft(x, size)) * np.fft.fft(y, size))[:lags].real
        fixed = [pa.array([group.column(c)[0].as_py()] * lags, group.column(c).type) for c in keys]
        return pa.table([*fixed, pa.array(np.arange(lags)), pa.array(sums)], [*keys, "lag", "total"])

    sums = dealt.groupBy(*keys, "block").applyInArrow(correlate, f"{fields}lag long, total double")
    return sums.groupBy(*keys, "lag").agg(F.sum("total").alias("total"))


def long_delays(series: DataFrame, keys: Sequence[str], tick: str, a: Sequence[str], b: Sequence[str], lags: int, block: int = 1 << 16) -> DataFrame:
    """keys, found, delay: the lag below lags with the largest sum of lag_sums(), the first of equals; not found if it isn't above epsilon."""
    best = F.max(F.struct("total", (-F.col("lag")).alias("back"))).alias("x")
    out = lag_sums(series, keys, tick, a, b, lags, block).groupBy(*keys).agg(best)
    found = F.col("x.total") > float(np.finfo(np.float64).eps)
    return out.select(*keys, found.alias("found"), F.when(found, -F.col("x.back")).otherwise(0).cast("long").alias("delay"))
