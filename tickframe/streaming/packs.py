"""Rows in packs: Arrow batches of many rows as one value, so that shuffles, sorts and calls to the state are for packs and not for rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that are gathered before they are packed, about.
ROWS, BYTES = 1 << 16, 4 << 20
#: Bytes of packs that go to a Python worker at once. Spark's default makes batches of 64 MB, of which a task has several copies.
BATCH_BYTES, _DEFAULT_BYTES = "8m", "67108864b"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """For the whole session, Arrow batches get BATCH_BYTES unless it sets a size of its own."""
    if spark.conf.get(_BYTES, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        spark.conf.set(_BYTES, BATCH_BYTES)


def bytes_of(rows: pa.Table) -> bytes:
    """A table of few enough rows as one value; rows_of() reads it."""
    (batch,) = rows.combine_chunks().to_batches()
    return batch.serialize().to_pybytes()


def rows_of(packs: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in packs], schema)


def packed(batches: Iterator[pa.RecordBatch], by: str, kind: pa.DataType, schema: pa.Schema, newest: str | None = None) -> Iterator[pa.RecordBatch]:
    """by, with newest also at, and pack: the rows of each value of by among some that came together, and the newest value of a column in them."""
    import numpy as np
    import pyarrow.compute as pc

    names = [by, *(["at"] if newest else []), "pack"]
    for rows in _gathered(batches):
        codes = rows[by].combine_chunks().dictionary_encode()
        code = codes.indices.fill_null(-1).to_numpy()
        order = np.argsort(code, kind="stable")
        rows, code = rows.select(schema.names).cast(schema).take(order), code[order]
        starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        pieces = [rows.slice(a, b - a) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True)]
        values = codes.dictionary.to_pylist()
        columns = [pa.array([None if k < 0 else values[k] for k in code[starts].tolist()], kind)]
        if newest:
            columns.append(pa.array([pc.max(p[newest]) for p in pieces], schema.field(newest).type))
        columns.append(pa.array([bytes_of(p) for p in pieces], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
