"""Exact order statistics and running totals per group, without a group ever meeting in one task.

Both operators sort the whole input by range, count per partition, and turn the counts of earlier
partitions into offsets. A group that holds most rows is spread over as many partitions as its rows
fill, because the value is part of the sort key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from gridwake.session import cut


def _starts(table: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Row numbers at which a run of equal values in the columns ``names`` begins; nulls equal each other."""
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for name in names:
        codes = pa.compute.dictionary_encode(
            table.column(name), null_encoding="encode"
        ).indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _local_totals(df: DataFrame, groups: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Adds ``_part`` and, for each amount, ``_upto<k>``: its sum over the group's rows so far within the partition."""
    schema = StructType([*df.schema.fields]).add("_part", IntegerType())
    for k in range(len(amounts)):
        schema.add(f"_upto{k}", LongType())
    arrow, groups, amounts = to_arrow_schema(schema), list(groups), list(amounts)

    def run(batches):
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, np.zeros((len(amounts), 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = _starts(batch, groups) if groups else np.array([0])
            total = np.cumsum(
                np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in amounts]), axis=1
            )
            before = np.repeat(
                np.concatenate([np.zeros((len(amounts), 1), np.int64), total[:, starts[1:] - 1]], axis=1),
                np.diff(np.append(starts, n)), axis=1
            )
            upto = total - before
            first = tuple(batch.column(g)[0].as_py() for g in groups)
            if first == last:
                upto[:, : starts[1] if len(starts) > 1 else n] += carried
            last, carried = tuple(batch.column(g)[n - 1].as_py() for g in groups), upto[:, -1:].copy()
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(np.full(n, part, np.int32)),
                    *(pa.array(np.ascontiguousarray(u)) for u in upto)
                ],
                schema=arrow
            )

    return df.mapInArrow(run, schema)


def running_totals(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], amount: str | Sequence[str],
    out: str | Sequence[str] = "upto"
) -> DataFrame:
    """``df`` with the inclusive running sum of one or more whole-number columns per group in ``order``.

    Amounts must not be null. Groups may be an empty list: then the whole table is one group. Rows that tie
    in ``order`` follow each other in any order. Empty input gives empty output.
    """
    amounts, outs = ([amount], [out]) if isinstance(amount, str) else (list(amount), list(out))
    keys = [*groups, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = cut(_local_totals(ordered, groups, amounts))
    per_part = local.groupBy(*groups, "_part").agg(*[F.max(f"_upto{k}").alias(f"_sum{k}") for k in range(len(amounts))])
    # One row per partition that holds some of the group: few rows, even for a group with most of the table.
    window = Window.partitionBy(*[F.col(g) for g in groups]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *groups, "_part",
        *[F.coalesce(F.sum(f"_sum{k}").over(window), F.lit(0)).alias(f"_before{k}") for k in range(len(amounts))]
    )
    match = F.col("l._part") == F.col("o._part")
    for g in groups:
        match &= F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = local.alias("l").join(offsets.alias("o"), match)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"_upto{k}") + F.col(f"_before{k}")).alias(name) for k, name in enumerate(outs)]
    )


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with its row number per group in ``order``, from 1, without a group meeting in one task."""
    return running_totals(df.withColumn("_one", F.lit(1)), groups, order, "_one", out).drop("_one")


def value_counts(df: DataFrame, groups: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """The combinable summary: per group and distinct value its number of rows, as ``(groups, value, n)``.

    Null and NaN values are left out. Summaries of separate partitions or days combine by ``value_counts``
    over their union with ``count='n'``, without any error.
    """
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = F.sum(count) if count else F.count(F.lit(1))
    return usable.groupBy(*groups, F.col(value).cast("double").alias("value")).agg(n.cast("long").alias("n"))


def order_statistics(counts: DataFrame, groups: Sequence[str], ranks: dict[str, callable]) -> DataFrame:
    """The values at given ranks of every group, from ``value_counts``.

    ``ranks`` maps an output column to a function of the group's size column that gives a rank, counted
    from 1. A rank outside 1 .. n, or a null rank, gives null. The table is sorted by range on (group,
    value); counts per partition become offsets, and a row holds a wanted rank when the rank lies between
    the running counts before and after it. Returns ``(groups, n_rows, *ranks)``, one row per group.
    """
    placed = running_totals(counts, groups, ["value"], "n", "_hi")
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("n_rows"))
    if not groups:
        total = sizes.first()["n_rows"] or 0  # a single number
        joined = placed.withColumn("n_rows", F.lit(total).cast("long"))
        return _at_ranks(joined, groups, ranks).where("n_rows IS NOT NULL")
    match = None
    for g in groups:
        same = F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}"))
        match = same if match is None else match & same
    joined = placed.alias("p").join(sizes.alias("s"), match)
    return _at_ranks(joined.select(*[F.col(f"p.{g}") for g in groups], "value", "n", "_hi", "n_rows"), groups, ranks)


def _at_ranks(joined: DataFrame, groups: Sequence[str], ranks: dict[str, callable]) -> DataFrame:
    hits = {
        name: F.when(
            (f(F.col("n_rows")) <= F.col("_hi")) & (f(F.col("n_rows")) > F.col("_hi") - F.col("n")), F.col("value")
        )
        for name,
        f in ranks.items()
    }
    return joined.groupBy(*groups).agg(
        F.max("n_rows").alias("n_rows"), *[F.max(hit).alias(name) for name, hit in hits.items()]
    )


def percentiles(counts: DataFrame, groups: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles, linearly interpolated between neighbouring order statistics, from ``value_counts``."""
    ranks = {}
    for name, f in fractions.items():
        ranks[f"_{name}_lo"] = lambda n, f=f: F.floor((n - 1) * F.lit(f)) + 1
        ranks[f"_{name}_hi"] = lambda n, f=f: F.ceil((n - 1) * F.lit(f)) + 1
    found = order_statistics(counts, groups, ranks)
    columns = []
    for name, f in fractions.items():
        at = (F.col("n_rows") - 1) * F.lit(f)
        columns.append(
            (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (at - F.floor(at))).alias(name)
        )
    return found.select(*groups, "n_rows", *columns)
