"""Reductions by any associative reducer: partial results per task, combined in a tree in the order of the offsets.

A reducer says what nothing is (initialize), what an element at its offset is (transform) and how two neighbouring
results become one (combine); combine must be associative, not commutative. Results are bytes on their way, made by
pickle. Tasks take ranges of the offset, so that a hot key is many partials, and each level of the tree combines up to
FAN neighbours of a key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.sources.shared import kept

FAN = 64


class Reducer(Protocol):
    def initialize(self) -> Any: ...

    def transform(self, value: Any, offset: int) -> Any: ...

    def combine(self, left: Any, right: Any) -> Any: ...


class Sum:
    def initialize(self) -> float:
        return 0

    def transform(self, value, offset: int):
        return 0 if value is None else value

    def combine(self, left, right):
        return left + right


class Least:
    """The smallest value; None for nothing."""

    def initialize(self):
        return None

    def transform(self, value, offset: int):
        return value

    def combine(self, left, right):
        return right if left is None else left if right is None or left <= right else right


class ArgMax:
    """(value, offset) of the largest value, the first of equals."""

    def initialize(self):
        return None

    def transform(self, value, offset: int):
        return None if value is None else (value, offset)

    def combine(self, left, right):
        return right if left is None else left if right is None or left[0] >= right[0] else right


class Ascents:
    """(first, last, how often a value is above the one before it): order matters, so it doesn't commute."""

    def initialize(self):
        return None

    def transform(self, value, offset: int):
        return None if value is None else (value, value, 0)

    def combine(self, left, right):
        if left is None or right is None:
            return right if left is None else left
        return (left[0], right[1], left[2] + right[2] + (right[0] > left[1]))


class Together:
    """Several reducers over the same elements at once; the result is the tuple of theirs."""

    def __init__(self, *reducers: Reducer):
        self.reducers = reducers

    def initialize(self):
        return tuple(r.initialize() for r in self.reducers)

    def transform(self, value, offset: int):
        return tuple(r.transform(value, offset) for r in self.reducers)

    def combine(self, left, right):
        return tuple(r.combine(a, b) for r, a, b in zip(self.reducers, left, right, strict=True))


def reduce(rows: DataFrame, keys: Sequence[str], value: str, offset: str, reducer: Reducer) -> DataFrame:
    """keys and result, the pickled reduction of the values of each key in the order of offset.

    Rows of one key and offset go by value. Null values are given to transform; null keys are a key, null offsets
    come first. An empty table gives no rows, as a key without rows is none.
    """
    keys = list(keys)
    columns = rows.select(*keys, F.col(value).alias("value"), F.col(offset).cast("long").alias("offset"))
    fields = "".join(f"`{c}` {t}, " for c, t in columns.select(*keys).dtypes)
    # whole ranges of (offset, key): a task's partials of a key are neighbours
    ordered = columns.repartitionByRange("offset", *keys, "value").sortWithinPartitions(*keys, "offset", "value")

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, own, result, any_ = TaskContext.get().partitionId(), None, None, False
        n = len(keys)
        for batch in batches:
            out = []
            for *key, x, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_ or key != own:
                    if any_:
                        out.append((*own, part, pickle.dumps(result)))
                    own, result, any_ = key, reducer.initialize(), True
                result = reducer.combine(result, reducer.transform(x, at))
            schema = [*(batch.schema.field(k).type for k in range(n)), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * (n + 2), schema, strict=True)], [*keys, "part", "result"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*own, part, pickle.dumps(result)), schema, strict=True)], [*keys, "part", "result"])

    made = kept(ordered.mapInArrow(partial, f"{fields}part long, result binary"), "partials")

    def merge(group):
        import pyarrow as pa

        order = group.column("part").to_numpy().argsort(kind="stable")
        results = group.column("result").to_pylist()
        result = reducer.initialize()
        for k in order:
            result = reducer.combine(result, pickle.loads(results[k]))
        first = group.slice(0, 1)
        arrays = [first.column(c).combine_chunks() for c in [*keys, "up"]] + [pa.array([pickle.dumps(result)], pa.binary())]
        return pa.table(arrays, [*keys, "part", "result"])

    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level = made.select(*keys, F.floor(F.col("part") / FAN).cast("long").alias("up"), "part", "result")
        made = level.groupBy(*keys, "up").applyInArrow(merge, f"{fields}part long, result binary")
        parts = -(-parts // FAN)
        if parts == 1:
            return made.select(*keys, "result")


def results(reduced: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """Columns from pickled results: name to Spark type and the places that lead to it in tuples of tuples; nothing where a tuple is None."""
    others = [c for c in reduced.columns if c != "result"]
    kinds = "".join(f"`{c}` {t}, " for c, t in reduced.select(*others).dtypes)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [pickle.loads(x) for x in batch.column(len(others)).to_pylist()]
            made = [pa.array([_part(x, at) for x in found]) for _, *at in fields.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*others, *fields])

    return reduced.select(*others, "result").mapInArrow(read, kinds + ", ".join(f"`{c}` {t}" for c, (t, *_) in fields.items()))


def _part(result: Any, at: Sequence[int]) -> Any:
    for k in at:
        result = None if result is None else result[k]
    return result
