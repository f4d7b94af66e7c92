"""Rows of each session in order, handed to Python as they come: nothing holds a whole session."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def in_order(rows: DataFrame, order_by: Sequence[str], run: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, key: str = "session") -> DataFrame:
    """``run(session, pieces)`` once per session; the pieces are its rows in order, at most one Arrow batch each.

    A session is one task's stream, sorted with spilling; memory holds what ``run`` carries from piece to piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch]]:
        for batch in batches:
            keys = batch.column(key).to_pylist()
            cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for a, b in pairwise([*cuts, len(keys)]):
                yield keys[a], batch.slice(a, b - a)

    def all_sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for session, own in groupby(pieces(batches), key=lambda x: x[0]):
            yield from run(session, (piece for _, piece in own))

    return rows.repartition(key).sortWithinPartitions(key, *order_by).mapInArrow(all_sessions, schema)
