"""Order books per security: level quantities, their intervals, and the state of the book after every update.

states() folds each security's updates in order. Partitions are sorted, not grouped, so that a very active
security streams through its task and only its live levels are in memory.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.prices import EMPTY_BID, EMPTY_OFFER, MOST
from tickframe.sources.shared import kept

#: Updates of a security that one task folds, about, and ranges of a security at most.
RANGE_UPDATES, MOST_RANGES = 1_000_000, 1_024


def level_quantity(changes: DataFrame) -> DataFrame:
    """Quantity of each level after each message that changes it: seq, stock, side, px, qty."""
    level = Window.partitionBy("stock", "side", "px").orderBy("seq", "sub")
    running = changes.withColumn("qty", F.sum("delta").over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # of two changes by one message the last counts
    final = running.withColumn("next_seq", F.lead("seq").over(level)).where("next_seq is null or next_seq <> seq")
    return final.select("seq", "stock", "side", "px", "qty")


def level_intervals(changes: DataFrame) -> DataFrame:
    """Live levels: stock, side, px, qty from seq_from (inclusive) to seq_to (exclusive, null: to the end)."""
    level = Window.partitionBy("stock", "side", "px").orderBy("seq")
    return (
        level_quantity(changes)
        .withColumn("seq_to", F.lead("seq").over(level))
        .where("qty > 0")
        .select("stock", "side", "px", "qty", F.col("seq").alias("seq_from"), "seq_to")
    )


class Side:
    """Live levels of one side, prices in ascending order."""

    def __init__(self):
        self.prices: list[int] = []
        self.quantity: dict[int, int] = {}

    def change(self, px: int, delta: int) -> str | None:
        """Adds to a level or takes from it, at most what it has; says what is wrong with a change that doesn't fit the book."""
        wrong = None
        if not 0 <= px < MOST:
            wrong = "price out of range"
        elif delta < 0 and px not in self.quantity:
            wrong = "no such level"
        elif self.quantity.get(px, 0) + delta < 0:
            wrong = "more than the level has"
        elif delta == 0:
            wrong = "no quantity"
        now = self.quantity.get(px, 0) + delta
        if now > 0:
            if px not in self.quantity:
                insort(self.prices, px)
            self.quantity[px] = now
        elif px in self.quantity:
            del self.quantity[px]
            del self.prices[bisect_left(self.prices, px)]
        return wrong


_STATE = (
    "bid_px long, bid_qty long, offer_px long, offer_qty long, worst_bid_px long, worst_bid_qty long, worst_offer_px long, "
    "worst_offer_qty long, buy_levels long, sell_levels long, bids array<struct<px:long,qty:long>>, offers array<struct<px:long,qty:long>>, feed_error string"
)


def states(accepted: DataFrame, levels: int = 0, stock: str = "stock", seq: str = "seq", mode: str = "PERMISSIVE") -> DataFrame:
    """accepted updates with the book after each: best and worst quotes, numbers of levels, and the best levels of each side.

    An empty side quotes the fixed empty quote. All columns of accepted stay. An update that doesn't fit its
    book (a level that isn't there or has less, no quantity, a price out of range) is named in feed_error and
    changes what it can, or, in mode FAILFAST, is an error.
    """
    ordered = accepted.repartition(stock).sortWithinPartitions(stock, seq)
    return _folded(ordered, accepted, [stock], levels, mode.upper() == "FAILFAST")


def states_in_ranges(accepted: DataFrame, levels: int = 0, stock: str = "stock", seq: str = "seq", rows: int = RANGE_UPDATES) -> DataFrame:
    """states() in mode FAILFAST, a security of more than about `rows` updates in ranges that are folded side by side.

    A range opens with the book that the ranges before leave: the changes of each level are summed by range, before
    the shuffle, and the running sums over the ranges are the opening levels. Errors can't be mended this way, since
    a clipped change would have to reach all later ranges; the first one ends the job, in the range where it is.
    """
    accepted = kept(accepted, "updates")
    many = ", ".join(f"{k / MOST_RANGES}D" for k in range(1, MOST_RANGES))
    counts = accepted.groupBy(stock).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(`{seq}`, array({many}), 10000)").alias("all_cuts")).where(F.col("n") > rows)
    ranges = F.least(F.ceil(F.col("n") / rows), F.lit(MOST_RANGES)).cast("int")
    picked = F.array_distinct(F.transform(F.sequence(F.lit(1), ranges - 1), lambda k: F.get("all_cuts", (F.floor(k * MOST_RANGES / ranges) - 1).cast("int"))))
    hot = kept(counts.select(F.col(stock).alias("hot_stock"), picked.alias("cuts")), "ranges")
    own = accepted.join(hot, F.col(stock).eqNullSafe(F.col("hot_stock")), "left")
    part = F.coalesce(F.size(F.filter("cuts", lambda c: F.col(seq) > c)), F.lit(0)).alias("range_part")
    placed = own.select(*accepted.columns, "cuts", part)
    one = lambda px, d: F.struct(F.col(px).alias("px"), d.alias("d"))
    changes = F.when(F.col("is_replace"), F.array(one("px", F.col("qty")), one("old_px", -F.col("old_qty")))).otherwise(F.array(one("px", F.col("qty"))))
    changed = placed.where("cuts is not null").select(stock, "side", "range_part", F.size("cuts").alias("last"), F.explode(changes).alias("c"))
    sums = changed.groupBy(stock, "side", F.col("c.px").alias("px"), "range_part").agg(F.sum("c.d").alias("d"), F.first("last").alias("last"))
    level = Window.partitionBy(stock, "side", "px").orderBy("range_part")
    sums = sums.withColumns({"qty": F.sum("d").over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "until": F.coalesce(F.lead("range_part").over(level), F.col("last"))})
    sums = sums.withColumn("qty", F.when(F.col("qty") < 0, F.raise_error(F.lit("a level has less than is taken")).cast("long")).otherwise(F.col("qty")))
    opening = sums.where("qty > 0 and range_part < until").select(
        stock, "side", "px", "qty", F.explode(F.sequence(F.col("range_part") + 1, F.col("until"))).alias("range_part"), F.lit(True).alias("opens")
    )
    both = placed.drop("cuts").withColumn("opens", F.lit(False)).unionByName(opening, allowMissingColumns=True)
    ordered = both.repartition(stock, "range_part").sortWithinPartitions(stock, "range_part", F.col("opens").desc(), seq)
    return _folded(ordered, accepted, [stock, "range_part"], levels, True).drop("range_part", "opens")


def _folded(ordered: DataFrame, accepted: DataFrame, keys: list[str], levels: int, failfast: bool) -> DataFrame:
    """The state of the book after each row, by keys; rows with opens only set a level."""
    import pyarrow as pa

    pairs = pa.list_(pa.struct([("px", pa.int64()), ("qty", pa.int64())]))
    kinds = [pa.int64()] * 10 + [pairs, pairs, pa.string()]
    names = [f.split()[0] for f in _STATE.split(", ")]
    opens_too = "opens" in ordered.columns

    def fold(batches: Iterator) -> Iterator:
        own, sides = None, {}
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = [batch.column(c).to_pylist() for c in ("side", "px", "qty", "is_replace", "old_px", "old_qty")]
            opening = batch.column("opens").to_pylist() if opens_too else [False] * batch.num_rows
            keyed = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, opens, side, px, qty, replace, old_px, old_qty in zip(keyed, opening, *columns, strict=True):
                if own is None or key != own:
                    own, sides = key, {"B": Side(), "S": Side()}
                book = sides["B" if side == "B" else "S"]
                if opens:
                    book.change(px, qty)
                    continue
                wrong = [book.change(old_px, -old_qty)] if replace else []
                wrong = next(filter(None, [*wrong, book.change(px, qty)]), None)
                if wrong and failfast:
                    raise ValueError(f"security {key[0]}, side {side}, price {px}, quantity {qty}: {wrong}")
                bids, offers = sides["B"], sides["S"]
                quote = lambda s, k, empty: (s.prices[k], s.quantity[s.prices[k]]) if s.prices else empty
                best = lambda s, chosen: [{"px": p, "qty": s.quantity[p]} for p in chosen]
                row = (
                    *quote(bids, -1, EMPTY_BID), *quote(offers, 0, EMPTY_OFFER),
                    *quote(bids, 0, EMPTY_BID), *quote(offers, -1, EMPTY_OFFER), len(bids.prices), len(offers.prices),
                    best(bids, bids.prices[: -levels - 1 : -1]) if levels else [], best(offers, offers.prices[:levels]), wrong,
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if opens_too:
                batch = batch.filter(pa.array([not o for o in opening]))
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    fields = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes)
    return ordered.mapInArrow(fold, f"{fields}, {_STATE}")
