"""Order lifecycles with arbitrary references, for real feeds.

Messages of a security stream through a task in order; only its live orders are in memory. The same class
serves batch and streaming runs. An order belongs to one security: references cross no security.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

FIELDS = ("seq", "side", "px", "qty", "is_replace", "old_px", "old_qty")
SCHEMA = "stock {kind}, seq long, side string, px long, qty long, is_replace boolean, old_px long, old_qty long"


class Orders:
    """Live orders of one security: id to side, price, shares left."""

    def __init__(self, live: dict[int, tuple[str, int, int]] | None = None):
        self.live = live or {}

    def apply(self, seq: int, kind: str, order_id: int | None, new_id: int | None, side: str | None, shares: int | None, px: int | None):
        """The book update of a message, or None: adds of a live id, unknown references and other types do nothing.

        Reductions take what is left at most, and a delete, or a reduction by 0, all of it. A replace takes
        the old order off the book and puts the new one on it, on the same side, as one update.
        """
        if kind in ("A", "F"):
            if order_id in self.live:
                return None
            self.live[order_id] = (side, px, shares)
            return (seq, side, px, shares, False, 0, 0)
        if order_id not in self.live:
            return None
        own_side, own_px, left = self.live[order_id]
        if kind == "U":
            if new_id in self.live:
                return None
            del self.live[order_id]
            self.live[new_id] = (own_side, px, shares)
            return (seq, own_side, px, shares, True, own_px, left)
        if kind not in ("E", "C", "X", "D"):
            return None
        taken = min(left, shares) if shares and kind != "D" else left
        if taken == left:
            del self.live[order_id]
        else:
            self.live[order_id] = (own_side, own_px, left - taken)
        return (seq, own_side, own_px, -taken, False, 0, 0)


def fold(messages: DataFrame, stock: str = "stock_locate", seq: str = "msgcnt") -> DataFrame:
    """Accepted book updates of decoded messages (type, order_id, new_order_id, side, shares, px), per security in order."""
    kind = dict(messages.dtypes)[stock]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, book = None, Orders()
        for batch in batches:
            rows = []
            for key, *message in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if own is None or key != own[0]:
                    own, book = (key,), Orders()
                if (update := book.apply(*message)) is not None:
                    rows.append((key, *update))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["stock", *FIELDS])

    rows = messages.select(stock, seq, "type", "order_id", "new_order_id", "side", "shares", "px")
    return rows.repartition(stock).sortWithinPartitions(stock, seq).mapInArrow(run, SCHEMA.format(kind=kind))
