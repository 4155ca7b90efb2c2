"""Live books: orders and levels of each security in Spark's state store, over a stream of decoded messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickframe.functions.prices import EMPTY_BID, EMPTY_OFFER
from tickframe.operators.book import Side
from tickframe.operators.fold import Orders
from tickframe.streaming import packs

QUOTES = (
    "stock long, seq long, side string, px long, qty long, is_replace boolean, old_px long, old_qty long, "
    "bid_px long, bid_qty long, offer_px long, offer_qty long, feed_error string"
)
_NAMES = [f.split()[0] for f in QUOTES.split(", ")]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Messages in a pack.
PACK = pa.schema([(n, pa.string() if n in ("type", "side") else pa.int64()) for n in ("stock", "seq", "type", "order_id", "new_order_id", "side", "shares", "px")])
#: Securities share packs and calls by bucket; messages that are objects at once, about.
BUCKETS, AT_ONCE = 256, 8_192
_ORDER = np.dtype([("id", "i8"), ("side", "U1"), ("px", "i8"), ("left", "i8")])
_LEVEL = np.dtype([("side", "U1"), ("px", "i8"), ("qty", "i8")])


class Book:
    """Live orders and levels of one security, as bytes between micro-batches."""

    def __init__(self, orders: bytes = b"", levels: bytes = b""):
        self.orders = Orders({k: v for k, *v in np.frombuffer(orders, _ORDER).tolist()})
        self.sides = {"B": Side(), "S": Side()}
        for side, px, qty in np.frombuffer(levels, _LEVEL).tolist():
            self.sides[side].change(px, qty)
        self.changed = False

    def apply(self, *message) -> tuple | None:
        """The update of a message with best bid and offer after it and what is wrong with it, or None."""
        if (update := self.orders.apply(*message)) is None:
            return None
        self.changed = True
        _, side, px, qty, replace, old_px, old_qty = update
        wrong = [self.sides[side].change(p, q) for p, q in ([(old_px, -old_qty)] if replace else []) + [(px, qty)]]
        bids, offers = self.sides["B"], self.sides["S"]
        bid = (bids.prices[-1], bids.quantity[bids.prices[-1]]) if bids.prices else EMPTY_BID
        offer = (offers.prices[0], offers.quantity[offers.prices[0]]) if offers.prices else EMPTY_OFFER
        return (*update, *bid, *offer, next(filter(None, wrong), None))

    def packed(self) -> tuple[bytes, bytes]:
        orders = np.array([(k, *v) for k, v in self.orders.live.items()], _ORDER)
        levels = np.array([(name, px, side.quantity[px]) for name, side in self.sides.items() for px in side.prices], _LEVEL)
        return orders.tobytes(), levels.tobytes()


def _values(column: pa.ChunkedArray) -> list:
    """What to_pylist() gives, in about a tenth of its time."""
    return column.to_pandas(integer_object_nulls=True).tolist()


class LiveBooks(StatefulProcessor):
    """Packs of messages of a bucket of securities in a micro-batch, each security's in order of seq. The state has one value for each security."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.books = handle.getMapState("books", "stock long", "orders binary, levels binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        messages = pa.concat_tables([packs.rows_of(frame["pack"], PACK) for frame in rows]).combine_chunks()
        messages = messages.sort_by([("stock", "ascending"), ("seq", "ascending")])
        own, book, out = None, Book(), []
        for at in range(0, messages.num_rows, AT_ONCE):
            for stock, *message in zip(*(_values(c) for c in messages.slice(at, AT_ONCE).columns), strict=True):
                if own is None or stock != own[0]:
                    self._left(own, book)
                    own = (stock,)
                    book = Book(*self.books.getValue(own)) if self.books.containsKey(own) else Book()
                if (update := book.apply(*message)) is not None:
                    out.append((stock, *update))
            yield pd.DataFrame(out, columns=_NAMES)
            out = []
        self._left(own, book)

    def _left(self, own: tuple | None, book: Book) -> None:
        """Writes a security's orders and levels, if anything changed and is left of them."""
        if not book.changed:
            return
        orders, levels = book.packed()
        if orders or levels:
            self.books.updateValue(own, (orders, levels))
        elif self.books.containsKey(own):
            self.books.removeKey(own)


def live_quotes(messages: DataFrame) -> DataFrame:
    """Accepted updates with best bid and offer, of a stream of messages (stock, seq, type, order_id, new_order_id, side, shares, px).

    Orders and levels leave the state when nothing is left of them. Messages are packed by bucket before they are shuffled; a task has
    those of a bucket in a micro-batch in memory, about 70 bytes each, and the orders of one security.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    packs.small_batches(messages.sparkSession)
    rows = messages.select(F.pmod(F.xxhash64("stock"), F.lit(BUCKETS)).cast("int").alias("bucket"), *PACK.names)
    packed = rows.mapInArrow(partial(packs.packed, by="bucket", kind=pa.int32(), schema=PACK), "bucket int, pack binary")
    return packed.groupBy("bucket").transformWithStateInPandas(LiveBooks(), QUOTES, "append", "None")


def messages(blocks: DataFrame) -> DataFrame:
    """Messages for live_quotes() of a stream of blocks (seq, payload); a security is the number of its feed and its locate there."""
    from tickframe.functions.decode import common

    stock = F.col("tracking_number") * 65_536 + F.col("stock_locate")
    return common(blocks).select(stock.alias("stock"), "seq", "type", "order_id", "new_order_id", "side", "shares", "px")


def packet_messages(packets: DataFrame, data: str = "data") -> DataFrame:
    """Messages for live_quotes() of a stream of packets; seq is the message's number in its session."""
    from tickframe.functions.decode import common
    from tickframe.sources.itch import blocks

    return common(blocks(packets, data)).select(
        F.col("stock_locate").alias("stock"), "seq", "type", "order_id", "new_order_id", "side", "shares", "px"
    )


def run_available(quotes: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there and writes Parquet; a restart with the same checkpoint goes on from there."""
    query = quotes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def publish(quotes: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, format: str = "parquet") -> None:
    """Runs a stream over what is there and gives every micro-batch to several outputs, each below path under its name.

    A batch that runs again overwrites its own folder, so that a restart neither loses nor repeats rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, of in outputs.items():
            of(batch).write.format(format).mode("overwrite").save(f"{path}/{name}/batch={number}")
        batch.unpersist()

    quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def feed_outputs() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What a feed handler sends on: all updates, those at the top of the book, and the errors."""
    from tickframe.operators.inside import published

    return {"updates": lambda q: q, "inside": published, "errors": lambda q: q.where("feed_error is not null")}
