"""Length-framed message files as a Spark source, format itch5.

Each file is a sequence of two-byte lengths and payloads. Uncompressed files are read in splits that start at
frames found by tickframe.sources.frames; a gzipped file is one task. Frames are found in buffers of megabytes
and handed on as Arrow arrays over these, without an object per message. Predicates on the type are met before
a payload leaves the reader; the schema decides what is built. Options: path, mode (FAILFAST or PERMISSIVE, for
a last message that is cut off), splits (the folder of a written plan).
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
)
from pyspark.sql.types import StructType

from tickframe.sources import frames
from tickframe.sources.shared import shared_path
from tickframe.sources.sink import FileWriter, StreamWriter

SCHEMA = "file string, msgcnt long, msgoffset long, type string, payload binary"
_LETTERS = [bytes([k]).decode("latin-1") for k in range(256)]


class Part(InputPartition):
    def __init__(self, path: str, entry: int = 0, end: float = float("inf"), first: int = 0):
        self.path, self.entry, self.end, self.first = path, entry, end, first


def files(path: str) -> list[tuple[str, int]]:
    """URIs and sizes of a file or of a folder's files, by name; those that begin with _ or . are left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
    head = path.split("://", 1)[0] + "://" if "://" in path else "file://"
    return sorted((head + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


class ItchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.splits = schema, options["path"], options.get("splits")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("type",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = wanted if self.types is None else self.types & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.splits:
            from pyarrow import fs, parquet

            system, root = fs.FileSystem.from_uri(self.splits)
            rows = parquet.read_table(root, filesystem=system).to_pylist()
            found = [Part(r["path"], r["entry"], r["end"], r["first"]) for r in sorted(rows, key=lambda r: (r["path"], r["start"]))]
        else:
            found = [Part(path) for path, _ in files(self.path)]
        return found or [Part("")]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        target, names = to_arrow_schema(self.schema), self.schema.fieldNames()
        wanted = None if self.types is None else np.isin(_LETTERS, list(self.types))
        letters = pa.array(_LETTERS)
        count, (system, path) = partition.first, fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as opened:
            if partition.entry:
                opened.seek(partition.entry)
            stream = frames.Unzipped(opened) if path.endswith(".gz") else opened
            for base, data, starts in self.buffers(stream, partition):
                edges = np.array(starts, np.int64)
                n = len(edges) - 1
                if edges[-1] < len(data) and base + int(edges[-1]) < partition.end and not self.permissive:
                    raise ValueError(f"{partition.path} is cut off in message {count + n}")
                # an empty payload has no type
                blank = edges[1:] == edges[:-1] + 2
                kinds = np.frombuffer(data + b"\0", np.uint8)[np.minimum(edges[:-1] + 2, len(data))]
                keep = np.flatnonzero(~blank & wanted[kinds]) if wanted is not None else None
                columns = {}
                for name in names:
                    if name == "file":
                        column = pa.repeat(pa.scalar(partition.path.split("://", 1)[-1]), n)
                    elif name == "msgcnt":
                        column = pa.array(np.arange(count, count + n))
                    elif name == "msgoffset":
                        column = pa.array(edges[:-1] + base + 2)
                    elif name == "type":
                        column = letters.take(pa.array(np.where(blank, 0, kinds), mask=blank))
                        column = pc.fill_null(column, "")
                    else:
                        body = np.ones(edges[-1], bool)
                        body[edges[:-1]] = body[edges[:-1] + 1] = False  # without the lengths
                        ends = (edges - 2 * np.arange(n + 1)).astype(np.int32)
                        column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.frombuffer(data, np.uint8, edges[-1])[body])])
                    columns[name] = column if keep is None else column.take(pa.array(keep))
                count += n
                if n if keep is None else len(keep):
                    yield pa.RecordBatch.from_arrays([columns[c].cast(target.field(c).type) for c in names], schema=target)

    def buffers(self, stream, partition: Part) -> Iterator[tuple[int, bytes, list[int]]]:
        """Buffers of frames; a gzipped file whose end is missing ends where its bytes do."""
        try:
            yield from frames.walk(stream, partition.entry, partition.end)
        except (EOFError, gzip.BadGzipFile, zlib.error):
            if not self.permissive:
                raise


class ItchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "itch5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ItchReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return StreamWriter(self.options, schema, overwrite)


def read_itch(spark: SparkSession, path: str, schema: str = SCHEMA, split_bytes: int = frames.SPLIT_BYTES, numbered: bool = False, **options: str) -> DataFrame:
    """The messages of a file, or of a folder's files. msgcnt counts a file's messages, with numbered those of all files in order of name.

    Uncompressed files of more than split_bytes are planned first, by a job that finds frames in the middle. Sets
    spark.sql.python.filterPushdown.enabled for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ItchSource)
    found = files(path)
    plain = [(p, n) for p, n in found if not p.endswith(".gz")]
    if numbered and len(plain) < len(found):
        raise ValueError("gzipped files can't be numbered ahead")
    if numbered or any(n > split_bytes for _, n in plain):
        parts = frames.plan(spark, plain, split_bytes)
        if numbered:
            first, over = 0, []
            for s in parts:
                over.append(s._replace(first=first))
                first += s.count
            parts = over
        parts += [frames.Split(p, 0, 1 << 62, 0, 0, 0) for p, _ in found if p.endswith(".gz")]
        options["splits"] = shared_path(spark, "splits")
        table = "path string, start long, end long, entry long, exit long, count long, first long"
        spark.createDataFrame([tuple(s) for s in parts if s.entry < s.end], table).write.parquet(options["splits"])
    return spark.read.format("itch5").schema(schema).options(path=path, **options).load()


def blocks(packets: DataFrame, data: str = "data") -> DataFrame:
    """Messages of packets (any columns and the packet's bytes): session, first_seq, block_count, seq, payload.

    A block's number is the packet's first number and its place. Packets without blocks are heartbeats and
    give no rows, as do null packets and such as are shorter than a header. A packet that is cut off gives the
    blocks that are whole. Columns of packets stay, but for such as have the new ones' names.
    """
    kept = [c for c in packets.columns if c not in (data, *_BLOCK)]
    rows = packets.select(*kept, data)
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*kept).dtypes)

    return rows.mapInArrow(partial(walked, kept=kept), kinds + "session string, first_seq long, block_count int, seq long, payload binary")


def walked(batches: Iterator, kept: list[str]) -> Iterator:
    """The blocks of packets, of batches with the columns kept and the packets' bytes after them."""
    import pyarrow as pa

    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def made(batch, of: list[int], out: list[list]):
        taken = batch.take(pa.array(of, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns[:-1], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*kept, *_BLOCK])

    for batch in batches:
        # the column of packets isn't taken along: only its number of rows counts
        others = batch.set_column(len(kept), "data", pa.nulls(batch.num_rows))
        of: list[int] = []
        out: list[list] = [[] for _ in _BLOCK]
        for row, value in enumerate(batch.column(len(kept))):
            raw = value.as_py() or b""
            if len(raw) < struct.calcsize(_HEAD):
                continue
            name, first, count = struct.unpack_from(_HEAD, raw)
            session, at = name.decode("latin-1").rstrip(" "), struct.calcsize(_HEAD)
            for k in range(count):
                end = at + 2 + int.from_bytes(raw[at : at + 2], "big")
                if at + 2 > len(raw) or end > len(raw):
                    break
                of.append(row)
                for column, x in zip(out, (session, first, count, first + k, raw[at + 2 : end]), strict=True):
                    column.append(x)
                at = end
            if len(of) >= BLOCKS_AT_ONCE:
                yield made(others, of, out)
                of, out = [], [[] for _ in _BLOCK]
        yield made(others, of, out)


_BLOCK = ("session", "first_seq", "block_count", "seq", "payload")
#: Blocks that are held as objects, about, before they leave a task as a batch.
BLOCKS_AT_ONCE = 8_192
#: Session, number of the first block, number of blocks.
_HEAD = ">10sQH"
