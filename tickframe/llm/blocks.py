"""Blocks of numbers: rows that hold many numbers as bytes, several kinds of them in one table.

A table of several kinds has a key and the columns of each kind, named a_..., b_..., c_...; they are null in the
rows of other kinds. What a task makes goes to a range or a bucket as one row, however many numbers that is.
"""

from __future__ import annotations

import numpy as np


def schema(key: str, *kinds: dict[str, str]) -> str:
    return ", ".join([f"{key} int", *(f"{'abc'[k]}_{name} binary" for k, kind in enumerate(kinds) for name in kind)])


def made(schema: str, kind: str, key: np.ndarray, columns: dict[str, np.ndarray]):
    """A row of the given kind for each value of key."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    order = np.argsort(key, kind="stable")
    key = key[order].astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(key))
    out = {names[0]: pa.array(key[edges], pa.int32())}
    for name, column in columns.items():
        column = column[order]
        out[f"{kind}_{name}"] = pa.array([column[a:b].tobytes() for a, b in zip(edges, ends, strict=False)], pa.binary())
    return pa.table([out[c] if c in out else pa.nulls(len(edges), pa.binary()) for c in names], names)


def read(group, kind: str, types: dict[str, str]) -> dict[str, np.ndarray]:
    """All numbers of a kind in a group of rows."""
    import pyarrow.compute as pc

    first = f"{kind}_{next(iter(types))}"
    found = group.filter(pc.is_valid(group.column(first)))
    return {name: np.frombuffer(b"".join(found.column(f"{kind}_{name}").to_pylist()), t) for name, t in types.items()}


def chosen(columns: dict[str, np.ndarray], rows: np.ndarray, kind: dict[str, str]) -> dict[str, np.ndarray]:
    """Rows of columns, as a kind has them."""
    return {name: columns[name][rows].astype(t) for name, t in kind.items()}


def ordered(columns: dict[str, np.ndarray], *by: str) -> dict[str, np.ndarray]:
    """Columns in the order of some of them."""
    order = np.lexsort([columns[name] for name in reversed(by)])
    return {name: column[order] for name, column in columns.items()}


def unlike(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new
