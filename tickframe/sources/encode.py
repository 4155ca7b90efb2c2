"""Bytes of messages, length-framed files and packets, for fixtures and replays."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.layouts import ITCH, ITCH_HEADER, PITCH, Field, size


def _put(out: bytearray, field: Field, value, big: bool) -> None:
    if field.kind in ("u", "price4", "price8"):
        data = int(value).to_bytes(field.width, "big" if big else "little")
    else:
        data = str(value).encode("latin-1").ljust(field.width, b" ")
    out[field.offset : field.offset + field.width] = data


def itch(kind: str, **values) -> bytes:
    fields = (*ITCH_HEADER, *ITCH[kind])
    out = bytearray(size(fields))
    out[0] = ord(kind)
    for f in fields:
        _put(out, f, values[f.name], True)
    return bytes(out)


def payload(kind: str, **values: Column) -> Column:
    """The bytes of a message as an expression, from columns for all of its fields; fields lie end to end after the type."""

    def part(f: Field) -> Column:
        if f.kind in ("u", "price4", "price8"):
            return F.unhex(F.lpad(F.hex(values[f.name].cast("long")), 2 * f.width, "0"))
        return F.encode(F.rpad(values[f.name].cast("string"), f.width, " "), "ISO-8859-1")

    fields = sorted((*ITCH_HEADER, *ITCH[kind]), key=lambda f: f.offset)
    return F.concat(F.encode(F.lit(kind), "ISO-8859-1"), *map(part, fields))


def pitch_payload(kind: int, **values: Column) -> Column:
    """The bytes of a message of the little-endian protocol: its length, its type, then its fields."""

    def part(f: Field) -> Column:
        if f.kind == "u":
            digits = F.lpad(F.hex(values[f.name].cast("long")), 2 * f.width, "0")
            return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(f.width))]))
        return F.encode(F.rpad(values[f.name].cast("string"), f.width, " "), "ISO-8859-1")

    fields = sorted(PITCH[kind], key=lambda f: f.offset)
    return F.concat(F.unhex(F.lit(f"{size(fields):02X}{kind:02X}")), *map(part, fields))


def block(message: Column) -> Column:
    """A message with its length before it, as an expression."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(message)), 4, "0")), message)


def packets(
    messages: DataFrame, by: str | list[str], session: str | Column, seq: str = "seq", message: str = "payload", also: dict[str, Column] | None = None
) -> DataFrame:
    """by, data and also: a packet for each value of the columns by, its messages in order of seq; they must be as many as its numbers, and 65,535 at most."""
    by = [by] if isinstance(by, str) else by
    session = F.lit(session) if isinstance(session, str) else F.first(session)
    found = messages.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), block(F.col(message)).alias("block")))).alias("all"),
        session.alias("session_"), *[c.alias(name) for name, c in (also or {}).items()],
    )
    number = lambda c, width: F.unhex(F.lpad(F.hex(c), 2 * width, "0"))
    head = F.concat(F.encode(F.rpad("session_", 10, " "), "ISO-8859-1"), number(F.get("all", F.lit(0))["seq"], 8), number(F.size("all"), 2))
    # one concatenation of all blocks, as hexadecimal text
    body = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["block"])), ""))
    return found.select(*by, *(also or {}), F.concat(head, body).alias("data"))


def write_frames(messages: DataFrame, path: str, message: str = "payload") -> None:
    """A length-framed file for each partition of messages, named in the partitions' order, in the folder path.

    A task writes under a name of its own and renames at its end, so that one that is lost or runs twice leaves no half file.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task, (system, root) = TaskContext.get(), fs.FileSystem.from_uri(path)
        system.create_dir(root)
        own = f"{root}/_{task.partitionId()}-{task.taskAttemptId()}"
        with system.open_output_stream(own) as out:
            for batch in batches:
                out.write(framed([m for m in batch.column(0).to_pylist() if m is not None]))
        system.move(own, f"{root}/part-{task.partitionId():06d}.itch")
        yield pa.RecordBatch.from_arrays([pa.array([own])], ["file"])

    messages.select(message).mapInArrow(write, "file string").count()


def pitch(kind: int, **values) -> bytes:
    out = bytearray(size(PITCH[kind]))
    out[0], out[1] = len(out), kind
    for f in PITCH[kind]:
        _put(out, f, values[f.name], False)
    return bytes(out)


def framed(messages: list[bytes]) -> bytes:
    return b"".join(struct.pack(">H", len(m)) + m for m in messages)


def write(path: str, messages: list[bytes]) -> None:
    """A length-framed file; gzipped if the path ends in .gz."""
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as out:
        out.write(framed(messages))


def packet(session: str, first_seq: int, blocks: list[bytes]) -> bytes:
    head = session.encode().ljust(10, b" ")[:10] + struct.pack(">QH", first_seq, len(blocks))
    return head + framed(blocks)
