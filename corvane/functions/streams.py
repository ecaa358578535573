"""Rows streamed through a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def streamed(rows_of: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType, at_once: int = 5000):
    """A function for mapInArrow: rows_of gets a partition's rows as tuples, one by one, and gives rows of the schema."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for row in rows_of(rows):
            made.append(row)
            if len(made) >= at_once:
                yield batch()
        if made:
            yield batch()

    return run


def begins(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each of the rows, which are sorted by the keys, is the first of its key; nulls are equal."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        number = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= number[1:] != number[:-1]
    return new


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """A partition's rows, sorted by the keys, in tables that cut no key in two; what is held is a batch and the rows of one key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = begins(pa.Table.from_batches([b]), keys)
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)
        last = int(np.flatnonzero(new)[-1])
        if same and not last:
            held.append(b)
            continue
        if last:
            held.append(b.slice(0, last))
        if held:
            yield pa.Table.from_batches(held)
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
