"""Folds over the rows of a group in their order, streamed: a task holds one batch and the state of one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def kept_in_order(df: DataFrame, group: str, order: str, start: Callable[[], Callable[[dict], bool]]) -> DataFrame:
    """The rows of ``df`` for which a fold says so, in order of ``order`` within each ``group``.

    ``start`` gives the fold of a new group: a function that takes a row, remembers what it needs and tells whether
    the row is kept. Rows of a group come to one task, sorted, and go through it without being gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keep = object(), None
        for batch in batches:
            chosen = []
            for row in batch.to_pylist():
                if row[group] != at:
                    at, keep = row[group], start()
                chosen.append(keep(row))
            yield batch.filter(pa.array(chosen, pa.bool_()))

    return df.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, df.schema)
