"""Writers with commit: frames, packets and lines of text, for batches and streams.

A task writes to a file of its own below _temporary and tells the driver its name. Only when all tasks of a batch
are done does commit() move the files of the attempts that succeeded to their names, so that a task that is lost,
repeated or run twice leaves no part. A stream's files carry the batch's number; a batch that is committed again
replaces its own files. abort() removes what the job wrote.
"""

from __future__ import annotations

import gzip
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

TEMPORARY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """A task's file, its name to be, and how many records and bytes it holds."""

    file: str
    name: str
    records: int
    bytes: int


def _framed(column) -> Iterator[bytes]:
    from tickframe.sources.encode import framed

    yield framed([m for m in column.to_pylist() if m is not None])


def _lines(column) -> Iterator[bytes]:
    yield "".join(f"{x}\n" for x in column.to_pylist() if x is not None).encode()


#: What a record becomes, and the files' ending. Packets in a file are framed as messages are.
FORMATS = {"frames": (_framed, ".itch"), "packets": (_framed, ".cap"), "lines": (_lines, ".txt")}


class _Files:
    """What both writers share. Options: path, records (frames, packets or lines), compression (none or gzip). One column is written."""

    def __init__(self, options: dict, schema, overwrite: bool = False):
        if len(schema.fields) != 1:
            raise ValueError("one column is written")
        self.path, self.overwrite = options["path"], overwrite
        self.kind, self.gzip = options.get("records", "frames"), options.get("compression", "none").lower() == "gzip"
        if self.kind not in FORMATS:
            raise ValueError(f"records is one of {', '.join(FORMATS)}")
        self.job, self.stamp = uuid.uuid4().hex, time.time_ns()

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task, (system, root) = TaskContext.get(), self._system()
        encode, ending = FORMATS[self.kind]
        folder = f"{root}/{TEMPORARY}/{self.job}"
        system.create_dir(folder)
        own = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        records = size = 0
        with system.open_output_stream(own, compression=None) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.gzip else raw
            for batch in iterator:
                for piece in encode(batch.column(0)):
                    out.write(piece)
                    size += len(piece)
                records += batch.num_rows - batch.column(0).null_count
            if self.gzip:
                out.close()
        return Written(own, f"{task.partitionId():06d}{ending}{'.gz' if self.gzip else ''}", records, size)

    def _removed(self, prefix: str) -> None:
        from pyarrow import fs

        system, root = self._system()
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.type == fs.FileType.File and x.base_name.startswith(prefix):
                system.delete_file(x.path)

    def _moved(self, messages: list[Written | None], prefix: str) -> None:
        """Gives the files of these messages their names, in the order of tasks."""
        system, root = self._system()
        for m in messages:
            if m is not None and m.records:
                system.move(m.file, f"{root}/{prefix}{m.name}")
        self._cleaned()

    def _cleaned(self) -> None:
        from pyarrow import fs

        system, root = self._system()
        folder = f"{root}/{TEMPORARY}/{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
        rest = f"{root}/{TEMPORARY}"
        if system.get_file_info(rest).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(rest)):
            system.delete_dir(rest)


class FileWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        # the names of a job's files come after those of earlier jobs
        if self.overwrite:
            self._removed("part-")
        self._moved(messages, f"part-{self.stamp:020d}-")

    def abort(self, messages: list[Written | None]) -> None:
        self._cleaned()


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._removed(f"batch-{batchId:09d}-")
        self._moved(messages, f"batch-{batchId:09d}-")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._cleaned()
