"""Ordered folds over each key's rows, streamed: no key's history is ever held as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task hands on together.
TOGETHER = 4096


def folded(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    fresh: Callable[[], Any],
    step: Callable[..., Iterable[tuple]],
    outputs: str,
    finish: Callable[[Any], Iterable[tuple]] | None = None,
) -> DataFrame:
    """The keys and ``outputs`` (a schema) of what a fold gives over each key's rows in order.

    ``step(state, *values of columns)`` gives any number of tuples for a row, ``finish(state)`` for the
    end of a key; ``fresh()`` is the state that a key begins with. Rows are dealt by key and sorted,
    and a task goes over them batch by batch with the state of the key that it is at; so memory is
    bounded however many rows a key has, and small keys cost no more than their rows. Null keys are a key.
    """
    kinds = dict(rows.dtypes)
    n = len(keys)
    names = [*keys, *dict.fromkeys([*order, *columns])]
    at = [names.index(c) for c in columns]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), outputs])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(parts, arrow, strict=True)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key is None or row[:n] != key:
                    if key is not None and finish is not None:
                        out += [(*key, *x) for x in finish(state)]
                    key, state = row[:n], fresh()
                out += [(*key, *x) for x in step(state, *[row[i] for i in at])]
                if len(out) >= TOGETHER:
                    yield batch(out)
                    out = []
        if key is not None and finish is not None:
            out += [(*key, *x) for x in finish(state)]
        if out:
            yield batch(out)

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
