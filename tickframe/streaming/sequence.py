"""Channels in sequence: a reorder buffer per session in Spark's state store, with event-time timers for what never comes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickframe.sources.itch import walked
from tickframe.streaming import packs
from tickframe.streaming.live import _ROCKS

BLOCKS = "session string, seq long, missing long, received timestamp, released timestamp, payload binary"
_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
#: Blocks in a pack.
PACK = pa.schema([("seq", pa.int64()), ("received", pa.timestamp("us", "UTC")), ("payload", pa.binary())])
#: Numbers of a chunk, whose blocks are held together, and bytes of blocks that a task gathers before they leave or go to the state, about.
CHUNK, GATHERED = 1 << 14, 32 << 20


def _blocks(frame: pd.DataFrame) -> pa.Table:
    """The blocks of a frame of packs, or of one with a row for each block."""
    if "pack" in frame:
        return packs.rows_of(frame["pack"], PACK)
    return pa.Table.from_pandas(frame[PACK.names], PACK, preserve_index=False)


def _micros(blocks: pa.Table) -> np.ndarray:
    return blocks["received"].cast(pa.int64()).to_numpy()


def _ordered(tables: list[pa.Table], turn: int) -> pa.Table:
    """The blocks from turn on in the order of their numbers, each once, as it was first received."""
    blocks = pa.concat_tables(tables).combine_chunks()
    seq = blocks["seq"].to_numpy()
    kept = np.flatnonzero(seq >= turn)
    order = kept[np.lexsort((_micros(blocks)[kept], seq[kept]))]
    return blocks.take(order[np.diff(seq[order], prepend=turn - 1) != 0])


class Sequencer(StatefulProcessor):
    """Blocks of a session leave in the order of their numbers, each once.

    A block ahead of its turn is held. If the missing ones haven't come when the watermark is wait_ms past the first
    one that is held, a row with missing, the number of blocks given up from seq on, takes their place, and what was held goes on.
    Blocks that come after they were given up, or for a second time, are left out. Only what is held is in the state, in packs of a
    chunk of numbers, so that a task has about GATHERED bytes and a chunk in memory, however many blocks come in a micro-batch.
    released is the stream's time at which a block leaves, never before the watermark, as what is held grows old.
    """

    def __init__(self, first: int, wait_ms: int):
        self.first, self.wait_ms = first, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.timer = handle.getValueState("timer", "at long")
        self.held = handle.getMapState("held", "chunk long, part long", "pack binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, parts = self._turn(), self._parts()
        mark, came, size = timerValues.getCurrentWatermarkInMs() + 1, [], 0
        for frame in rows:
            came.append(_blocks(frame))
            size += came[-1].nbytes
            if size >= GATHERED:
                turn = yield from self._settled(key, turn, came, parts, mark)
                came, size = [], 0
        if came:
            turn = yield from self._settled(key, turn, came, parts, mark)
        self._left(turn, parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.timer.clear()
        turn, parts, mark = self._turn(), self._parts(), timerValues.getCurrentWatermarkInMs() + 1
        while (waiting := self._first_held(turn, parts)) and waiting[1] // 1000 + self.wait_ms < mark:
            seq, received = waiting
            yield _frame(key, turn, seq - turn, [received], mark, None)
            turn = yield from self._settled(key, seq, [], parts, mark)
        self._left(turn, parts)

    def _turn(self) -> int:
        return self.next.get()[0] if self.next.exists() else self.first

    def _parts(self) -> dict[int, list[int]]:
        """Numbers of the packs that are held, by chunk, read once a call."""
        found = {}
        for chunk, part in self.held.keys():
            found.setdefault(chunk, []).append(part)
        return found

    def _settled(self, key, turn: int, came: list[pa.Table], parts: dict, mark: int) -> Iterator[pd.DataFrame]:
        """Frames of what leaves in sequence from turn on, then the number that is next; the rest of came is held."""
        new = _by_chunk(_ordered(came, turn)) if came else {}
        reached = not came
        while (chunk := turn // CHUNK) in new or (reached and chunk in parts):
            own = _ordered([*self._read(chunk, parts), *([new.pop(chunk)] if chunk in new else [])], turn)
            self._removed(chunk, parts)
            seq = own["seq"].to_numpy()
            count = int((seq == turn + np.arange(len(seq))).sum())  # numbers only grow, so those in their places come first
            if count:
                yield _frame(key, seq[:count], 0, _micros(own)[:count], mark, own["payload"].slice(0, count).to_numpy())
                turn += count
            if count < len(seq):
                self._hold(chunk, own.slice(count), parts)
            reached = turn // CHUNK != chunk
            if not reached:
                break
        for chunk, blocks in new.items():
            self._hold(chunk, blocks, parts)
        return turn

    def _read(self, chunk: int, parts: dict) -> list[pa.Table]:
        found = [self.held.getValue((chunk, part))[0] for part in parts.get(chunk, ())]
        return [packs.rows_of(found, PACK)] if found else []

    def _removed(self, chunk: int, parts: dict) -> None:
        for part in parts.pop(chunk, ()):
            self.held.removeKey((chunk, part))

    def _hold(self, chunk: int, blocks: pa.Table, parts: dict) -> None:
        own = parts.setdefault(chunk, [])
        own.append(max(own, default=-1) + 1)
        self.held.updateValue((chunk, own[-1]), (packs.bytes_of(blocks),))

    def _first_held(self, turn: int, parts: dict) -> tuple[int, int] | None:
        """Number and receive time, in microseconds, of the first block that is held."""
        if not parts:
            return None
        first = _ordered(self._read(min(parts), parts), turn).slice(0, 1)
        return first["seq"][0].as_py(), int(_micros(first)[0])

    def _left(self, turn: int, parts: dict) -> None:
        """Writes the state; a timer runs for the first block that is held, from when it was received."""
        self.next.update((turn,))
        waiting = self._first_held(turn, parts)
        at = None if waiting is None else waiting[1] // 1000 + self.wait_ms
        if self.timer.exists():
            if self.timer.get()[0] == at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.timer.update((at,))
            self.handle.registerTimer(at)


def _by_chunk(blocks: pa.Table) -> dict[int, pa.Table]:
    """Blocks in order, cut at the ends of chunks."""
    number = blocks["seq"].to_numpy() // CHUNK
    found, at = np.unique(number, return_index=True)
    ends = [*at[1:].tolist(), len(number)]
    return {chunk: blocks.slice(a, b - a) for chunk, a, b in zip(found.tolist(), at.tolist(), ends, strict=False)}


def _frame(key, seq, missing: int, received, mark: int, payload) -> pd.DataFrame:
    received = np.asarray(received, np.int64)
    at = lambda us: pd.to_datetime(us, unit="us", utc=True)
    columns = (key[0], seq, missing, at(received), at(np.maximum(received, mark * 1000)), payload)
    return pd.DataFrame(dict(zip(_NAMES, columns, strict=True)))


def sequenced(blocks: DataFrame, wait_ms: int = 1_000, late: str = "10 seconds", first: int = 0) -> DataFrame:
    """session, seq, missing, received, released, payload: a stream of blocks (session, seq, received, payload; any number of channels) in sequence.

    Rows with missing above 0 stand for blocks from seq on that never came. Sessions are the unit of parallel work; their blocks are
    packed before they are shuffled. late is how far channels may lie apart in receive time; packs whose newest block is older than the
    watermark are left out by Spark. Sets spark.sql.streaming.stateStore.providerClass for the session.
    """
    return _sequenced(blocks.select("session", "seq", "received", "payload").where("seq is not null").mapInArrow(_packed, _PACKS), wait_ms, late, first)


def sequenced_packets(packets: DataFrame, wait_ms: int = 1_000, late: str = "10 seconds", first: int = 0) -> DataFrame:
    """sequenced() of the blocks of packets (received, data), which are packed as they are read out of their packets."""
    return _sequenced(packets.select("received", "data").mapInArrow(_packed_packets, _PACKS), wait_ms, late, first)


_PACKS = "session string, at timestamp, pack binary"


def _packed(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return packs.packed(blocks, "session", pa.string(), PACK, "received")


def _packed_packets(packets: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(walked(packets, ["received"]))


def _sequenced(packed: DataFrame, wait_ms: int, late: str, first: int) -> DataFrame:
    packed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    packs.small_batches(packed.sparkSession)
    sessions = packed.withWatermark("at", late).groupBy("session")
    return sessions.transformWithStateInPandas(Sequencer(first, wait_ms), BLOCKS, "append", "EventTime", eventTimeColumnName="released")
