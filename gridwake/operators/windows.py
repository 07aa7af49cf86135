"""Statistics and order-dependent work per (point, year) window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gridwake.functions import indices
from gridwake.operators.grouped import group_codes, over_groups

WINDOW = ["point_id", "year"]
DRY = (121, 304)


def summarise(value: Column, prefix: str = "") -> list[Column]:
    """Aggregates: five percentiles (linear), population deviation, amplitude and number of values."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    names = ("p05", "p25", "p50", "p75", "p95")
    return [
        *[F.get(p, F.lit(i)).alias(prefix + n) for i, n in enumerate(names)], F.stddev_pop(value).alias(prefix + "std"),
        (F.get(p, F.lit(4)) - F.get(p, F.lit(0))).alias(prefix + "amplitude"), F.count(value).alias(prefix + "n_obs")
    ]


def dry_summary(value: Column, doy: Column) -> list[Column]:
    dry = F.when(doy.between(*DRY), value)
    return [F.avg(dry).alias("dry_mean"), F.stddev_pop(dry).alias("dry_std"), F.count(dry).alias("dry_n")]


def band_summary(value: Column, prefix: str) -> list[Column]:
    """5th and 95th percentile and population deviation; fewer than two values give 0, 0 and 1."""
    few = F.count(value) < 2
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return [
        F.when(few, 0.0).otherwise(F.get(p, F.lit(0))).alias(f"{prefix}_p5"),
        F.when(few, 0.0).otherwise(F.get(p, F.lit(1))).alias(f"{prefix}_p95"),
        F.when(few, 1.0).otherwise(F.stddev_pop(value)).alias(f"{prefix}_std")
    ]


def _padded(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of groups of similar size as the sorted rows of a matrix, with infinity behind them."""
    place = np.arange(int(size.max()))[None, :]
    at = np.minimum(first[:, None] + place, len(values) - 1)
    rows = np.where(place < size[:, None], values[at], np.inf)
    rows.sort(axis=1)
    return rows


def _quantile(rows: np.ndarray, size: np.ndarray, f: float) -> np.ndarray:
    """Linear between the two order statistics around the position, of sorted rows of ``size`` values each."""
    at = (size - 1) * f
    low, line = np.floor(at).astype(np.int64), np.arange(len(rows))
    a, b = rows[line, low], rows[line, np.ceil(at).astype(np.int64)]
    return a + (b - a) * (at - low)


def _spread(values: np.ndarray, codes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per group: number of values, 5th and 95th percentile and population deviation; NaN values don't count.

    Groups of similar size share a matrix, so that padding at most doubles the work.
    """
    there = ~np.isnan(values)
    values, codes = values[there], codes[there]
    size = np.bincount(codes, minlength=groups)
    first = np.cumsum(size) - size
    mean = np.bincount(codes, weights=values, minlength=groups) / np.maximum(size, 1)
    squares = np.bincount(codes, weights=np.square(values - mean[codes]), minlength=groups)
    low, high = np.zeros(groups), np.zeros(groups)
    some = np.flatnonzero(size > 1)
    kind = np.ceil(np.log2(size[some])).astype(np.int64)
    for k in np.unique(kind):
        part = some[kind == k]
        rows = _padded(values, first[part], size[part])
        low[part], high[part] = _quantile(rows, size[part], 0.05), _quantile(rows, size[part], 0.95)
    return size, low, high, np.sqrt(squares / np.maximum(size, 1))


def band_summaries(df: DataFrame, keys: Sequence[str], columns: Sequence[str], needed: str | None = None) -> DataFrame:
    """As ``band_summary`` for many columns at once: ``(keys, <c>_p5, <c>_p95, <c>_std, ...)``.

    Null and NaN values don't count; fewer than two give 0, 0 and 1. With ``needed``, a yes-or-no column, groups without a
    yes are left out. One shuffle by the keys; then blocks of whole groups are sorted as matrices, which is
    several times as fast as one percentile aggregate per column. A group is a point's readings of one year,
    bounded by how often a sensor passes, and is held whole.
    """
    keys, columns = list(keys), list(columns)
    schema = StructType([df.schema[k] for k in keys])
    for c in columns:
        for end in ("p5", "p95", "std"):
            schema.add(f"{c}_{end}", DoubleType())

    def kernel(table: pa.Table, codes: np.ndarray) -> pa.Table:
        size = np.bincount(codes)
        first = np.cumsum(size) - size
        if needed:
            yes = table.column(needed).to_numpy().astype(bool)
            kept = np.flatnonzero(np.bincount(codes, weights=yes) > 0)
        else:
            kept = np.arange(len(size))
        out = {k: table.column(k).take(pa.array(first[kept])) for k in keys}
        for c in columns:
            n, low, high, deviation = (x[kept] for x in _spread(table.column(c).to_numpy(), codes, len(size)))
            few = n < 2
            parts = {"p5": np.where(few, 0.0, low), "p95": np.where(few, 0.0, high), "std": np.where(few, 1.0, deviation)}
            out |= {f"{c}_{end}": pa.array(v) for end, v in parts.items()}
        return pa.table(out)

    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    return over_groups(df.select(*keys, *([needed] if needed else []), *doubles), keys, [], kernel, schema)


def scale_stats(df: DataFrame, keys: Sequence[str], value: str, sample: bool = False, floor: float = 1e-6) -> DataFrame:
    """``(keys, mean, std)``: no values give 0 and 1; the deviation is at least ``floor``."""
    deviation = F.stddev_samp(value) if sample else F.stddev_pop(value)
    std = F.when(F.count(value) == 0, 1.0).otherwise(F.greatest(F.coalesce(deviation, F.lit(floor)), F.lit(floor)))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), std.alias("std"))


def z_score(
    df: DataFrame, keys: Sequence[str], value: str, out: str, sample: bool = False, floor: float = 1e-6
) -> DataFrame:
    """Standardised within ``keys``; a null value gives 0."""
    over = Window.partitionBy(*keys)
    deviation = (F.stddev_samp if sample else F.stddev_pop)(value).over(over)
    return df.withColumn(
        out,
        F.coalesce(
            (F.col(value) - F.avg(value).over(over)) / F.greatest(F.coalesce(deviation, F.lit(floor)), F.lit(floor)),
            F.lit(0.0)
        )
    )


def despeckle(df: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """Centred rolling median per point in order of date; a width under two changes nothing."""
    if width < 2:
        return df
    frame = Window.partitionBy("point_id").orderBy("date", "obs_id").rowsBetween(-(width // 2), width // 2)
    return df.withColumns({c: F.percentile(F.col(c), F.lit(0.5)).over(frame) for c in columns})


def earliest(df: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy(*WINDOW).orderBy("date", "source", "item_id", "obs_id", "loaded_at")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def rate_of_change(df: DataFrame, value: str, keys: Sequence[str] = ("point_id",)) -> DataFrame:
    """Change per day since the reading before; null where no day has passed."""
    order = Window.partitionBy(*keys).orderBy("date", "obs_id")
    days = F.datediff("date", F.lag("date").over(order))
    return df.withColumn("rate", F.when(days > 0, (F.col(value) - F.lag(value).over(order)) / days))


def sequences(df: DataFrame, value: Column, most: int) -> DataFrame:
    """One row per window with its readings in order of time, at most ``most`` of them."""
    pairs = F.sort_array(F.collect_list(F.struct("doy", "obs_id", value.alias("v"))))
    short = F.slice(pairs, 1, most)
    return df.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n_obs"), short.alias("s")).select(
        *WINDOW, "n_obs", F.transform("s", lambda x: x.doy).alias("doys"),
        F.transform("s", lambda x: x.v).alias("values")
    )


def farthest(doys: np.ndarray, keep: int) -> np.ndarray:
    """Places of ``keep`` days spread over the year: both ends first, then always the day farthest from those chosen.

    The lowest place wins a tie; the result is in order of time.
    """
    n = len(doys)
    if keep >= n:
        return np.arange(n)
    if keep <= 0:
        return np.zeros(0, np.int64)
    chosen = [0] if keep == 1 else [0, n - 1]
    gap = np.full(n, np.inf)
    for c in chosen:
        gap = np.minimum(gap, np.abs(doys - doys[c]))
    gap[chosen] = -1
    while len(chosen) < keep:
        nxt = int(np.argmax(gap))
        chosen.append(nxt)
        gap = np.where(gap < 0, gap, np.minimum(gap, np.abs(doys - doys[nxt])))
        gap[nxt] = -1
    return np.sort(chosen)


def subsample(df: DataFrame, keep: int, all_optical: bool = False) -> DataFrame:
    """At most ``keep`` rows per window, spread over the year by ``farthest``.

    With ``all_optical`` every optical row stays (the earliest ``keep`` if there are more) and radar rows fill what is left.
    Windows of one point and year are small, so many are handled in one vectorised block.
    """
    schema = StructType(list(df.schema.fields))

    def kernel(table: pa.Table, codes: np.ndarray) -> pa.Table:
        doys = table.column("doy").to_numpy().astype(float)
        radar = np.array(table.column("source").to_pylist()) == "S1" if all_optical else np.ones(len(doys), bool)
        kept = []
        for rows in np.split(np.arange(len(doys)), np.flatnonzero(np.diff(codes)) + 1):
            free, fixed = rows[radar[rows]], rows[~radar[rows]][:keep]
            kept.append(np.sort(np.concatenate([fixed, free[farthest(doys[free], keep - len(fixed))]])))
        return table.take(pa.array(np.concatenate(kept))) if kept else table

    return over_groups(df, WINDOW, ["date", "source", "obs_id"], kernel, schema)


def is_one_run(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Whether each point's rows stand together when the table is read in ``order``: runs against points.

    Runs are counted within the parts of a distributed sort; a run that goes on in the next part is taken off.
    """

    def ends(batches):
        from pyspark import TaskContext

        first, last, runs = None, None, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            if names:
                codes = group_codes(pa.Table.from_batches([batch]), ["point_id"])
                runs += int(codes[-1]) + 1 - (names[0] == last and runs > 0)
                first, last = names[0] if first is None else first, names[-1]
        if runs:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "runs": [runs]}
            )

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("point_id").mapInArrow(
        ends, "part long, first string, last string, runs long"
    )
    joined = parts.withColumn("again", F.lag("last").over(Window.orderBy("part")) == F.col("first"))  # a row per partition
    runs = joined.agg((F.sum("runs") - F.count_if("again")).alias("runs"))
    points = df.agg(F.countDistinct("point_id").alias("points"))
    both = runs.select("runs", F.lit(None).cast("long").alias("points")).unionByName(
        points.select(F.lit(None).cast("long").alias("runs"), "points")
    )
    return both.agg(F.max("runs").alias("runs"), F.max("points").alias("points"))


def waveform(
    df: DataFrame, index: str, quality: str, window: tuple[int, int] = (200, 340), threshold: float = 0.15,
    min_quality: float = 0.3, min_years: int = 3
) -> DataFrame:
    """Per point: the season's peak, its day, and how long and how regularly it comes; two aggregations, no row logic."""
    years = df.groupBy("point_id").agg(F.countDistinct("year").alias("years")).where(F.col("years") >= min_years)
    usable = df.where(
        (F.col(quality) >= min_quality) & F.col("doy").between(*window)
    ).withColumn("w", F.col(index) * F.col(quality)).where("w IS NOT NULL")
    peaks = usable.groupBy("point_id", "year").agg(
        F.max(F.struct("w", -F.col("doy"), -F.col("obs_id"))).alias("m"),
        F.count_if(F.col("w") >= threshold / 2).alias("long")
    ).select(
        "point_id", "year", F.col("m.w").alias("peak"), (-F.col("m.col2")).alias("peak_doy"), "long"
    ).where(F.col("peak") >= threshold)
    found = peaks.groupBy("point_id").agg(
        F.max(F.struct("peak", -F.col("year"), "peak_doy")).alias("b"), F.avg("long").alias("spike_duration"),
        F.avg("peak_doy").alias("peak_doy_mean"), F.stddev_pop("peak_doy").alias("peak_doy_sd"),
        F.count(F.lit(1)).alias("years_detected")
    ).where(F.col("years_detected") >= min_years)
    return found.join(years.select("point_id"), "point_id", "left_semi").select(
        "point_id", F.col("b.peak").alias("peak_value"), F.col("b.peak_doy").alias("peak_doy"), "spike_duration",
        "peak_doy_mean", "peak_doy_sd", "years_detected"
    )


def feature_vector(wave: DataFrame, structure: DataFrame, quality: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(point_id, *names)`` of the points with a waveform: waveform, structure and quality side by side, in the given order.

    A feature that is null or has no column fails the query and is named.
    """
    joined = wave.join(structure, "point_id", "left").join(quality, "point_id", "left")
    if missing := [n for n in names if n not in joined.columns]:
        raise ValueError(f"missing features: {missing}")
    needed = lambda n: F.coalesce(
        F.col(n).cast("double"), F.raise_error(F.lit(f"{n} is missing")).cast("double")
    ).alias(n)
    return joined.select("point_id", *[needed(n) for n in names])


def composite(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean; where all weights are 0 the plain mean."""
    w = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return df.groupBy(*keys).agg(
        F.when(
            F.coalesce(w, F.lit(0.0)) == 0, F.avg(value)
        ).otherwise(F.sum(F.col(weight) * F.col(value)) / w).alias("composite")
    )


def presence_filter(
    windows: DataFrame, vh_low: float = -21.0, vh_rescue: float = -23.0, ndvi_rescue: float = 0.5
) -> DataFrame:
    """Drops presence windows too dark in the dry season, unless green enough to be rescued; no radar keeps a window."""
    dark = F.col("vh_dry") < vh_low
    rescued = (F.col("vh_dry") >= vh_rescue) & (F.col("ndvi_dry") >= ndvi_rescue)
    return windows.where(
        ~((F.col("label") == "presence") & F.coalesce(dark & ~F.coalesce(rescued, F.lit(False)), F.lit(False)))
    )


def flags_dry(doy: Column) -> Column:
    return doy.between(*DRY)


def vh_dry_mean() -> Column:
    return F.avg(F.when(F.col("doy").between(*DRY), indices.decibel(F.col("vh"))))
