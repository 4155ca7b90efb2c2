"""Frames of large files in many tasks: where in the middle of a file a frame starts.

A file is a chain of two-byte lengths and payloads, so that only its first byte is known to start a frame. Each
split looks for an entry of its own: the first place from which a chain of frames has known types, the lengths of
these types and times of day. It walks from there to the first frame of the next split. An entry is a guess until
the split before has arrived at it; what can't be confirmed (payloads that look like frames, frames of no known
type) is walked again from the last confirmed place, until that walk meets the entry of a later split, from where
on that split's own walk holds. The splits that are read start at confirmed frames, and their first messages'
numbers are sums of the counts before. Planning reads each byte once, twice where guesses fail.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tickframe.layouts import DAY_NS, ITCH, ITCH_HEADER_SIZE, size

#: Bytes of the longest frame, and frames in a row that make an entry.
LONGEST, CHAIN = 65_537, 12
SPLIT_BYTES = 64 << 20
#: Bytes that are read at once.
BUFFER = 4 << 20
_SIZES = np.zeros(256, np.int64)
for _kind, _layout in ITCH.items():
    _SIZES[ord(_kind)] = max(ITCH_HEADER_SIZE, size(_layout) if _layout else 0)


class Split(NamedTuple):
    """Frames of a file that start from entry on and before end; exit is the next one, count how many, first the number of the first."""

    path: str
    start: int
    end: int
    entry: int
    exit: int
    count: int
    first: int = 0


class Unzipped(io.RawIOBase):
    """A gzipped stream, read as far as its bytes go: what came before a cut or a damage is handed on first."""

    def __init__(self, raw):
        self.file = gzip.GzipFile(fileobj=raw)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        data = self.file.read1(len(out))
        out[: len(data)] = data
        return len(data)


def walk(stream, at: int, end: float) -> Iterator[tuple[int, bytes, list[int]]]:
    """Buffers with the frames that start from at on and before end: place of the buffer, its bytes, starts of its frames and the next one's.

    The stream stands at `at`. Where the last frame is cut off, the last buffer has bytes left.
    """
    rest, done = b"", False
    while at < end and not done:
        fresh = stream.read(BUFFER)
        data, done = rest + fresh, not fresh
        starts, k, n, stop = [0], 0, len(data) - 1, end - at
        while k < n and k < stop:
            k += 2 + (data[k] << 8 | data[k + 1])
            if k > n + 1:
                k = starts[-1]
                break
            starts.append(k)
        if len(starts) > 1 or (done and data):
            yield at, data, starts
        rest, at = data[k:], at + k


def entry(data: bytes) -> int | None:
    """The first place, within a frame's greatest length, from which CHAIN frames look like messages, or as many as there are bytes for."""
    d = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.int64)
    n = min(len(data) - 8, LONGEST)
    if n <= 0:
        return None
    length, kind = d[:n] << 8 | d[1 : n + 1], d[2 : n + 2]
    ok = (_SIZES[kind] == length) & (length > 0)
    for first in np.flatnonzero(ok).tolist():
        k = first
        for _ in range(CHAIN):
            if k + 13 > len(data):
                break
            if (wide := data[k] << 8 | data[k + 1]) != _SIZES[data[k + 2]] or not wide or int.from_bytes(data[k + 7 : k + 13], "big") >= DAY_NS:
                k = -1
                break
            k += 2 + wide
        if k >= 0:
            return first
    return None


def _measured(stream, at: int, end: int) -> tuple[int, int]:
    """Exit and count of a walk."""
    count = 0
    for base, _, starts in walk(stream, at, end):
        count += len(starts) - 1
        at = base + starts[-1]
    return at, count


_FOUND = "path string, start long, end long, entry long, exit long, count long"


def _guessed(splits: DataFrame) -> DataFrame:
    """path, start, end, size with the split's own entry (null if there is none), exit and count."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with fs.FileSystem.from_uri(path)[0].open_input_file(fs.FileSystem.from_uri(path)[1]) as f:
                    f.seek(start)
                    found = 0 if not start else entry(f.read(LONGEST + 64 * CHAIN + 8))
                    out = (None, None)
                    if found is not None:
                        f.seek(start + found)
                        out = _measured(f, start + found, end)
                rows.append((path, start, end, None if found is None else start + found, *out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], [c.split()[0] for c in _FOUND.split(", ")])

    return splits.mapInArrow(scan, _FOUND)


def _walked(gaps: DataFrame) -> DataFrame:
    """From a confirmed place (path, at) through splits (ends, in order) up to the first whose guessed entry (entries, -1 for none) is met."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, at, begins, ends, entries in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                with fs.FileSystem.from_uri(path)[0].open_input_file(fs.FileSystem.from_uri(path)[1]) as f:
                    for start, end, guess in zip(begins, ends, entries, strict=True):
                        if at == guess:
                            break
                        f.seek(at)
                        exit_, count = _measured(f, at, end)
                        rows.append((path, start, end, at, exit_, count))
                        at = exit_
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True) if rows else [[]] * 6)],
                [c.split()[0] for c in _FOUND.split(", ")],
            )

    return gaps.mapInArrow(scan, _FOUND)


def plan(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Confirmed splits of files (URI, size) in the given order, numbered within each file. A row per split comes to the driver."""
    if split_bytes < LONGEST:
        raise ValueError(f"a split has at least {LONGEST} bytes")
    wanted = [(path, at, min(at + split_bytes, total)) for path, total in files for at in range(0, total, split_bytes)]
    if not wanted:
        return []
    rows = _guessed(spark.createDataFrame(wanted, "path string, start long, end long").repartition(len(wanted))).collect()
    by_file: dict[str, list[Split]] = {path: [] for path, _ in files}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_file[r["path"]].append(Split(r["path"], r["start"], r["end"], -1 if r["entry"] is None else r["entry"], r["exit"] or 0, r["count"] or 0))
    sound: dict[str, list[Split]] = {path: [] for path in by_file}
    while True:
        gaps = []
        for path, splits in by_file.items():
            good = sound[path]
            at = good[-1].exit if good else 0
            for s in splits[len(good) :]:
                if at >= s.end:  # a frame reaches over the whole split
                    s = s._replace(entry=at, exit=at, count=0)
                elif s.entry != at:
                    break
                good.append(s)
                at = s.exit
            left = splits[len(good) :]
            if left:
                gaps.append((path, at, [s.start for s in left], [s.end for s in left], [s.entry for s in left]))
        if not gaps:
            break
        found = _walked(spark.createDataFrame(gaps, "path string, at long, begins array<long>, ends array<long>, entries array<long>").repartition(len(gaps))).collect()
        for r in sorted(found, key=lambda r: r["start"]):
            sound[r["path"]].append(Split(r["path"], r["start"], r["end"], r["entry"], r["exit"], r["count"]))
    out = []
    for splits in sound.values():
        first = 0
        for s in splits:
            out.append(s._replace(first=first))
            first += s.count
    return out
