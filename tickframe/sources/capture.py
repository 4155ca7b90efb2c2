"""Captured packets as a streaming and batch source, format capture.

A capture file is a chain of length-framed records: eight bytes of receive time in microseconds, then the packet.
Files have names in the order in which they were begun, and only the last one grows. An offset is a file and a
place in it, always the end of a record: all files before it and that file up to there are read. A batch is the
part of each file between two offsets, so that a restart from a checkpoint reads the same records again, or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tickframe.sources import frames

SCHEMA = "file string, offset long, received timestamp, data binary"
_TIME = 8


def record(packet: Column, received_us: Column) -> Column:
    """A packet with its receive time, for the sink of packets."""
    return F.concat(F.unhex(F.lpad(F.hex(received_us.cast("long")), 2 * _TIME, "0")), packet)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the capture files in a folder, in order; none if the folder isn't there yet."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((x.base_name, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _read(path: str, part: Range, schema: StructType) -> Iterator:
    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    system, root = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{root}/{part.path}") as opened:
        opened.seek(part.start)
        for base, data, starts in frames.walk(opened, part.start, part.end):
            edges = np.array(starts, np.int64)
            if (np.diff(edges) < 2 + _TIME).any():
                raise ValueError(f"{part.path}: a record without receive time")
            times = [int.from_bytes(data[a + 2 : a + 2 + _TIME], "big") for a in starts[:-1]]
            columns = {
                "file": pa.repeat(pa.scalar(part.path), len(times)),
                "offset": pa.array(edges[:-1] + base),
                "received": pa.array(times, pa.int64()).cast(pa.timestamp("us", "UTC")),
                "data": pa.array([data[a + 2 + _TIME : b] for a, b in zip(starts, starts[1:], strict=False)], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in target], schema=target)


class CaptureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]

    def partitions(self) -> list[InputPartition]:
        return [Range(name, 0, size) for name, size in _files(self.path)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        return _read(self.path, partition, self.schema) if partition.path else iter(())


class CaptureStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        #: the last file and how far its records are known to be whole
        self.known: tuple[str, int] = ("", 0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _files(self.path)
        if not found:
            return {"file": self.known[0], "at": self.known[1]}
        name, size = found[-1]
        at = self.known[1] if self.known[0] == name else 0
        if at < size:
            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(f"{root}/{name}") as opened:
                opened.seek(at)
                for base, _, starts in frames.walk(opened, at, size):
                    at = base + starts[-1]
        self.known = (name, at)
        return {"file": name, "at": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, size in _files(self.path):
            if start["file"] <= name <= end["file"]:
                a = start["at"] if name == start["file"] else 0
                b = end["at"] if name == end["file"] else size
                if a < b:
                    out.append(Range(name, a, b))
        return out

    def read(self, partition: Range) -> Iterator:
        return _read(self.path, partition, self.schema)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return CaptureStream(schema, self.options)
