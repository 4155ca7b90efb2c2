"""Order statistics, reductions, mergeable histograms and books in ranges against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import book, histogram, rates, reduce, select, statistics


@pytest.mark.parametrize("few, cells", [(3, 4), (10_000, 4_096)])
def test_order_statistics(spark, monkeypatch, few, cells):
    """Ties, negative and huge values, nulls, NaN, a null group, ranks out of range; many rounds and one."""
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "CELLS", cells)
    pick = random.Random(1)
    rows = [(g, pick.choice([0.0, -1.5, 1e300, -1e300, pick.random(), pick.gauss(0, 1e6)])) for g in ("a", None) for _ in range(150)]
    rows += [("b", 7.0)] * 50 + [("c", None), ("c", float("nan")), ("d", 1.0)]
    wanted = [(g, k) for g in ("a", None, "b", "c", "d", "e") for k in (0, 1, 49, 75, 149, 150, -1)]
    groups = {}
    for g, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    want = [(g, k, sorted(groups[g])[k]) for g, k in wanted if g in groups and 0 <= k < len(groups[g])]
    df = spark.createDataFrame(rows, "g string, x double")
    # null groups join as SQL joins them, so they are named
    named = lambda d: d.withColumn("g", F.coalesce("g", F.lit("?")))
    got = select.order_statistics(named(df), ["g"], "x", named(spark.createDataFrame(wanted + wanted[:3], "g string, k long")))
    assert sorted((r.g, r.k, r.x) for r in got.collect()) == sorted((g or "?", k, x) for g, k, x in want)
    whole = select.order_statistics(df, [], "x", spark.createDataFrame([(0,), (200,)], "k long")).collect()
    every = sorted(x for v in groups.values() for x in v)
    assert sorted((r.k, r.x) for r in whole) == [(0, every[0]), (200, every[200])]
    assert select.order_statistics(df.limit(0), ["g"], "x", spark.createDataFrame(wanted, "g string, k long")).count() == 0


def test_reduce(spark, monkeypatch):
    class Joined:
        """Text of the values in order: associative, not commutative."""

        def initialize(self):
            return ""

        def transform(self, value, offset):
            return f"{value}@{offset};"

        def combine(self, left, right):
            return left + right

    monkeypatch.setattr(reduce, "FAN", 2)
    pick = random.Random(2)
    rows = [(pick.choice("ab") if pick.random() < 0.9 else None, pick.randint(0, 5) if pick.random() < 0.9 else None, k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, x long, at long").repartition(7)
    got = {r.g: r.text for r in reduce.results(reduce.reduce(df, ["g"], "x", "at", Joined()), {"text": ("string",)}).collect()}
    want = {}
    for g, x, at in rows:
        want[g] = want.get(g, "") + f"{x}@{at};"
    assert got == want
    both = reduce.Together(reduce.Sum(), reduce.Least(), reduce.ArgMax(), reduce.Ascents())
    r = reduce.results(reduce.reduce(df, [], "x", "at", both), {"total": ("long", 0), "least": ("long", 1), "at": ("long", 2, 1), "ups": ("long", 3, 2)}).first()
    xs = [(x, at) for _, x, at in rows if x is not None]
    ups = sum(b[0] > a[0] for a, b in zip(xs, xs[1:], strict=False))
    assert (r.total, r.least, r["at"], r.ups) == (sum(x for x, _ in xs), min(xs)[0], min(at for x, at in xs if x == max(xs)[0]), ups)
    assert reduce.reduce(df.limit(0), ["g"], "x", "at", Joined()).count() == 0


def test_merged_histograms(spark):
    """Histograms of parts, merged, are that of the whole; the summary equals the quantiles of the row form."""
    pick = random.Random(3)
    binning = histogram.IntegerRange(10, 60)
    rows = [(pick.choice("ab"), pick.randint(0, 80), pick.randint(0, 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    parts = [histogram.bins(df.where(F.col("v") % 2 == k), ["g"], "v", binning, "w") for k in (0, 1)]
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for overall in (False, True):
        got = histogram.summary(histogram.merged(parts[0].unionByName(parts[1]), ["g"]), ["g"], binning, shares, overall)
        want = histogram.histogram(df, ["g"], "v", binning, "w", overall).select("g", "n", *histogram.quantiles(shares, binning))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert histogram.summary(histogram.bins(df.limit(0), ["g"], "v", binning), ["g"], binning, shares).count() == 0
    assert set(histogram.summary(histogram.bins(df.limit(0), [], "v", binning), [], binning, shares).first()) == {None}


@pytest.mark.parametrize("rows", [5, 40, 10_000])
def test_books_in_ranges(spark, rows):
    pick, live, updates = random.Random(4), {}, []
    for seq in range(600):
        stock = 1 if pick.random() < 0.8 else pick.randint(2, 9)
        side, px, qty = pick.choice("BS"), pick.randint(1, 20) * 100, pick.randint(1, 50)
        mine = [k for k in live if k[0] == stock and live[k]]
        if mine and pick.random() < 0.5:
            k = pick.choice(mine)
            taken = pick.randint(1, live[k])
            live[k] -= taken
            if pick.random() < 0.3:
                updates.append((seq, stock, k[1], px, qty, True, k[2], taken))
                live[stock, k[1], px] = live.get((stock, k[1], px), 0) + qty
            else:
                updates.append((seq, stock, k[1], k[2], -taken, False, 0, 0))
        else:
            live[stock, side, px] = live.get((stock, side, px), 0) + qty
            updates.append((seq, stock, side, px, qty, False, 0, 0))
    df = spark.createDataFrame(updates, "seq long, stock long, side string, px long, qty long, is_replace boolean, old_px long, old_qty long")
    plain, ranged = book.states(df, 3, mode="FAILFAST"), book.states_in_ranges(df, 3, rows=rows)
    assert ranged.columns == plain.columns
    assert sorted(map(repr, ranged.collect())) == sorted(map(repr, plain.collect()))
    with pytest.raises(Exception):  # noqa: B017
        book.states_in_ranges(df.withColumn("qty", F.when(F.col("seq") == 300, -9_999).otherwise(F.col("qty"))), rows=rows).collect()


def test_gaps_of_sparse_orders(spark, monkeypatch):
    """Order numbers in nanoseconds: ranges have rows, not numbers."""
    monkeypatch.setattr(rates, "RANGE_ROWS", 30)
    df = spark.createDataFrame([(k * 10**12, k * k) for k in range(200)], "o long, t long")
    assert rates.with_part(df, "o").groupBy("part").count().count() >= 4
    assert sorted(r.gap for r in statistics.ordered_gaps(df).collect()) == [2 * k + 1 for k in range(199)]


def test_long_delays(spark):
    """Blocks shorter than the lags and longer than the series, missing ticks, nulls, negative ticks, complex samples; a planted delay is found."""
    from tickframe.operators import delay

    pick = random.Random(6)
    rows = [(g, t, pick.gauss(0, 1), pick.gauss(0, 1)) for g in "ab" for t in range(-40, 160) if pick.random() < 0.9]
    pairs = [(g, t, re, im, None, None) for g, t, re, im in rows] + [(g, t + 13, None, None, re, im) for g, t, re, im in rows] + [("a", None, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(pairs, "g string, t long, re double, im double, re2 double, im2 double")
    want = {}
    for g in "ab":
        x, y = ({t: complex(re, im) for k, t, re, im in rows if k == g}, {t + 13: complex(re, im) for k, t, re, im in rows if k == g})
        for lag in range(30):
            want[g, lag] = sum((v.conjugate() * y.get(t + lag, 0)).real for t, v in x.items())
    for block in (8, 64, 100_000):
        got = delay.lag_sums(df, ["g"], "t", ["re", "im"], ["re2", "im2"], 30, block).collect()
        assert {(r.g, r.lag): r.total for r in got} == pytest.approx(want, abs=1e-6)
    assert sorted(map(tuple, delay.long_delays(df, ["g"], "t", ["re", "im"], ["re2", "im2"], 30, 64).collect())) == [("a", True, 13), ("b", True, 13)]
    assert delay.lag_sums(df.limit(0), ["g"], "t", ["re"], ["re2"], 5).count() == 0


def test_delay_of_complex_series(spark):
    from tickframe.operators import delay

    pick = random.Random(7)
    x = [(pick.gauss(0, 1), pick.gauss(0, 1)) for _ in range(64)]
    kind = "array<struct<re:double,im:double>>"
    rows = [(k, x, x[-k:] + x[:-k] if k else x) for k in (0, 5, 40)] + [(9, None, x), (10, [], [])]
    df = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}")
    assert sorted((r.k, r.found, r.delay) for r in delay.delays(df, "a", "b").collect()) == [(0, True, 0), (5, True, 5), (9, False, 0), (10, False, 0), (40, True, 40)]


def test_extrapolation(spark):
    from tickframe.operators import delay

    series = F.array(*[F.lit(float(v)) for v in (1, 2, 4)])
    mirrored = lambda k, size: F.get(series, F.when(k < 0, -k - 1).otherwise(2 * size - k - 1))
    row = spark.range(1).select(delay.delayed(series, 2, mirrored).alias("a"), delay.delayed(series, -2, mirrored).alias("b"), delay.delayed(series, 1).alias("c")).first()
    assert (row.a, row.b, row.c) == ([2.0, 1.0, 1.0], [4.0, 4.0, 2.0], [4.0, 1.0, 2.0])


def test_rates_of_nanoseconds_since_1970(spark):
    """Times that a double can't tell apart: five events within 1,000 ns, and one 999 ns after the fifth."""
    first = 1_700_000_000_000_000_101
    times = [first + d for d in (0, 1, 2, 3, 4, 1_003, 1_004)]
    df = spark.createDataFrame([("a", k, t) for k, t in enumerate(times)], "s string, o long, t long")
    steps = rates.rate_steps(df, ["s"], "t", "o", 1_000, 1)
    want = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 996), (1_000, 4, 1), (1_001, 3, 1), (1_002, 2, 1), (1_003, 2, 1)]
    assert [(r.tick - first, r.rate, r.weight) for r in steps.orderBy("tick").collect()] == want
    assert rates.rate_steps(df.withColumn("t", -F.col("t")), ["s"], "t", "o", 1_000, 1_000).isEmpty()


def test_transforms_make_no_object_per_sample():
    """A batch of 2,000 series of 64 samples, with a null and an empty one, takes some times its 2 MB, and pieces give what the whole gives."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tickframe.operators.delay import backward_fft, forward_fft

    series = pa.array([None, [], *np.random.default_rng(1).random((2_000, 64)).tolist()], pa.list_(pa.float32()))
    tracemalloc.start()
    back = backward_fft.func(forward_fft.func(series))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    assert back[:2].to_pylist() == [None, []]
    assert np.allclose(back[2:].values.field("re").to_numpy()[back.offsets[2].as_py() :], series.values.to_numpy() * 64, atol=1e-4)
