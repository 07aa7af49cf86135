"""Runs a vectorised function over whole groups of a sorted partition, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def group_codes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Consecutive numbers of the runs of equal values in ``names``."""
    change = np.zeros(table.num_rows, bool)
    for name in names:
        column = table.column(name).combine_chunks() if isinstance(table, pa.Table) else table.column(name)
        codes = pa.compute.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def over_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table | None],
    schema: StructType, flush: int = 50_000
) -> DataFrame:
    """``kernel(rows, group numbers)`` over blocks of whole groups.

    Rows are shuffled by ``keys`` and sorted by keys and ``order``; a block has at least ``flush`` rows or
    ends with the partition. The caller keeps unbounded groups away (see ``spikes``), so memory is
    bounded by ``flush`` rows plus one group.
    """
    keys = list(keys)
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(table: pa.Table):
            out = kernel(table, group_codes(table, keys))
            if out is not None and out.num_rows:
                yield from out.select(arrow.names).cast(arrow).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < flush:
                continue
            table = pa.Table.from_batches(held)
            codes = group_codes(table, keys)
            last = int(np.searchsorted(codes, codes[-1]))  # the last group may go on in the next batch
            if last:
                yield from work(table.slice(0, last))
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
        if rows:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def column(table: pa.Table, name: str, dtype=None) -> np.ndarray:
    values = table.column(name).to_numpy()
    return values if dtype is None else values.astype(dtype)


def group_median(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Median per group number 0 .. n-1; NaN for a group without values."""
    order = np.lexsort((values, codes))
    ordered, sizes = values[order], np.bincount(codes, minlength=n)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, np.nan)
    has = sizes > 0
    lo, hi = starts[has] + (sizes[has] - 1) // 2, starts[has] + sizes[has] // 2
    out[has] = (ordered[lo] + ordered[hi]) / 2
    return out
