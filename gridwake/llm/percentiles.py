"""Percentiles of very large numeric columns, exactly, by a full distributed sort.

The rows of all groups are sorted by range on (group, value); each partition counts its rows of each group; the counts of
earlier partitions become offsets; and a wanted position of a group is looked for in the one partition that holds it.
Neighbouring order statistics are interpolated. A group that holds most rows is spread over as many partitions as its rows
fill, because the value is part of the sort key. The rank error is 0.

Results of separate partitions or days combine through ``summary``: the number of rows of each value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from gridwake.operators.grouped import group_codes
from gridwake.session import Scratch


def summary(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(groups, value, n)``: how many rows of a group have a value; null and NaN values are left out.

    Summaries combine by ``summary(union, groups, "value", "n")`` over their union, without any error; groups may be coarser then.
    """
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return usable.groupBy(*groups, F.col(value).cast("double").alias("value")).agg(n.cast("long").alias("n"))


def _placed(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sorted rows ``(groups, value, n)`` with their partition and the sum of ``n`` over the group's rows so far in it."""
    schema = StructType([*df.schema.fields]).add("_part", IntegerType()).add("_upto", LongType())
    arrow, groups = to_arrow_schema(schema), list(groups)

    def run(batches):
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = group_codes(pa.Table.from_batches([batch]), groups)
            total = np.cumsum(batch.column("n").to_numpy())
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            upto = total - np.concatenate([[0], total])[starts][codes]
            if last is not None and tuple(batch.column(g)[0].as_py() for g in groups) == last:
                upto[codes == 0] += carried
            last, carried = tuple(batch.column(g)[-1].as_py() for g in groups), int(upto[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.cast(f.type) for c, f in zip(batch.columns, arrow)),
                    pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto)
                ],
                schema=arrow
            )

    keys = [*groups, "value"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def order_statistics(
    df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None
) -> DataFrame:
    """``(groups, n_rows, *ranks)``: the values at given ranks of every group, one row per group.

    ``ranks`` maps an output column to a function of the group's size that gives a rank, counted from 1; a rank outside
    1 .. n, or a null one, gives null. ``weight`` names a column of whole numbers, for summaries. Null and NaN values are left
    out, a null group is a group of its own, groups may be an empty list, other columns are ignored, and empty input gives
    no rows. The sorted rows are written once and read once more.
    """
    groups = list(groups)
    names = [f"_g{i}" for i in range(len(groups))]
    slim = df.select(
        *[F.col(g).alias(n) for g, n in zip(groups, names)], F.col(value).cast("double").alias("value"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")
    )
    scratch = Scratch(df.sparkSession, "percentiles")
    placed = scratch.cut(_placed(slim.where("value IS NOT NULL AND NOT isnan(value) AND n > 0"), names))
    # One row per partition that holds some of a group: few rows, even for a group with most of the table.
    per_part = placed.groupBy(*names, "_part").agg(F.max("_upto").alias("_n"))
    whole = Window.partitionBy(*[F.col(n) for n in names])
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_part.withColumn("_before", before).withColumn("n_rows", F.sum("_n").over(whole))
    wanted = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("name"), f(F.col("n_rows")).cast("long").alias("rank")) for k, f in ranks.items()]
        )
    )
    targets = offsets.select(*names, "_part", "_n", "_before", "n_rows", wanted.alias("w"))
    here = (F.col("w.rank") > F.col("_before")) & (F.col("w.rank") <= F.col("_before") + F.col("_n"))
    # A row per group and rank at most; written, so that its size is known and Catalyst decides how to join it.
    targets = scratch.cut(
        targets.where(here).select(
            *names, "_part", F.col("w.name").alias("_name"), (F.col("w.rank") - F.col("_before")).alias("_at")
        )
    )
    match = (F.col("p._part") == F.col("t._part")) & (F.col("t._at") <= F.col("p._upto")) & (
        F.col("t._at") > F.col("p._upto") - F.col("p.n")
    )
    for n in names:
        match &= F.col(f"p.{n}").eqNullSafe(F.col(f"t.{n}"))
    found = placed.alias("p").join(targets.alias("t"), match).select(
        *[F.col(f"p.{n}") for n in names], "_name", "value", F.lit(None).cast("long").alias("n_rows")
    )
    sizes = per_part.groupBy(*names).agg(F.sum("_n").alias("n_rows")).select(
        *names, F.lit(None).cast("string").alias("_name"), F.lit(None).cast("double").alias("value"), "n_rows"
    )
    both = found.unionByName(sizes).groupBy(*names).agg(
        F.max("n_rows").alias("n_rows"), *[F.max(F.when(F.col("_name") == k, F.col("value"))).alias(k) for k in ranks]
    )
    return both.where("n_rows IS NOT NULL").select(
        *[F.col(n).alias(g) for n, g in zip(names, groups)], "n_rows", *ranks
    )


def percentiles(
    df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], weight: str | None = None
) -> DataFrame:
    """``(groups, n_rows, *fractions)``: exact percentiles, linear between the two order statistics around the position."""
    ranks = {}
    for name, f in fractions.items():
        ranks[f"_{name}_lo"] = lambda n, f=f: F.floor((n - 1) * F.lit(f)) + 1
        ranks[f"_{name}_hi"] = lambda n, f=f: F.ceil((n - 1) * F.lit(f)) + 1
    found = order_statistics(df, groups, value, ranks, weight)
    columns = []
    for name, f in fractions.items():
        at = (F.col("n_rows") - 1) * F.lit(f)
        columns.append(
            (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (at - F.floor(at))).alias(name)
        )
    return found.select(*groups, "n_rows", *columns)
