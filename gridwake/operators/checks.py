"""Data-quality checks; each gives one row ``(check_name, status, measure)``."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.functions import indices


def _status(fail: Column, warn: Column | None = None) -> Column:
    out = F.when(F.coalesce(fail, F.lit(False)), "FAIL")
    return out.when(
        F.coalesce(warn, F.lit(False)), "WARN"
    ).otherwise("PASS") if warn is not None else out.otherwise("PASS")


def row(df: DataFrame, name: str, measure: Column, fail, warn=None) -> DataFrame:
    """One aggregate and the verdict on it."""
    m = F.col("measure")
    return df.agg(measure.cast("double").alias("measure")).select(
        F.lit(name).alias("check_name"), _status(fail(m), warn(m) if warn else None).alias("status"),
        F.round(m, 6).alias("measure")
    )


def share(condition: Column, among: Column | None = None) -> Column:
    return F.try_divide(
        F.count_if(condition & among) if among is not None else F.count_if(condition),
        F.count_if(among) if among is not None else F.count(F.lit(1))
    )


def row_count(df):
    return row(df, "row_count", F.count(F.lit(1)), lambda m: m == 0)


def radar_presence(df):
    return row(df, "radar_presence", F.count_if(F.col("source") == "S1"), lambda m: F.lit(False), lambda m: m == 0)


def pixel_ratio(df, expected: int):
    return row(df, "pixel_ratio", F.countDistinct("point_id") / expected, lambda m: m < 0.30, lambda m: m < 0.80)


def null_bands(df):
    optical = F.col("source") == "S2"
    return row(
        df, "null_bands", F.greatest(*[share(F.col(b).isNull(), optical) for b in indices.BANDS]), lambda m: m > 0.20,
        lambda m: m > 0.01
    )


def band_range(df):
    worst = F.greatest(*[F.count_if(~indices.reflectance(b).between(0.0, 1.5)) for b in indices.BANDS])
    return row(df, "band_range", worst, lambda m: m > 0)


def index_range(df):
    names = ("NDVI", "NDWI", "NDRE")
    return row(
        df, "index_range", F.greatest(*[F.count_if(~indices.spectral_index(n).between(-1.0, 1.0)) for n in names]),
        lambda m: m > 0
    )


def purity(df):
    return row(df, "purity", F.avg("scl_purity"), lambda m: m == 0, lambda m: m < 0.5)


def duplicates(df):
    return row(
        df.groupBy("point_id", "date", "source").count().where("count > 1"), "duplicates", F.count(F.lit(1)),
        lambda m: m > 0
    )


def radar_integrity(df):
    radar = F.col("source") == "S1"
    return row(
        df, "radar_integrity",
        F.count_if(radar & F.col("B02").isNotNull()) + F.count_if(radar & F.col("orbit").isNull()), lambda m: m > 0
    )


def date_cover(df):
    days = row(df, "dates", F.countDistinct("date"), lambda m: m < 10)
    return days.unionByName(row(df, "months", F.countDistinct("month"), lambda m: F.lit(False), lambda m: m < 6))


def outside_box(df, box: Sequence[float], margin: float = 0.02):
    outside = ~(
        F.col("lon").between(box[0] - margin, box[2] + margin) & F.col("lat").between(box[1] - margin, box[3] + margin)
    )
    return row(df, "outside_box", F.count_if(outside), lambda m: m > 0)


def schema(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """``(column_name, expected, status)`` for each column of a schema, from the table's own; no data is read."""
    have = dict(df.dtypes)
    rows = [
        (f.name, f.dataType.simpleString(), "PASS" if have.get(f.name) == f.dataType.simpleString() else "FAIL")
        for f in wanted
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, status string")


def verdicts(rows: DataFrame) -> DataFrame:
    """The rows and the overall verdict, the worst of them."""
    worst = rows.agg(
        F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)).alias("w")
    )
    overall = worst.select(
        F.lit("overall").alias("check_name"),
        F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "WARN").otherwise("PASS").alias("status"),
        F.lit(None).cast("double").alias("measure")
    )
    return rows.unionByName(overall)


def report(
    df: DataFrame, box: Sequence[float], expected: int, wanted: T.StructType | None = None, margin: float = 0.02
) -> DataFrame:
    """All checks of a prepared table as ``(check_name, status, measure)``.

    An empty table fails at once, and one without the wanted columns or types after it: the other checks are not run then. They take
    two passes: one aggregation for everything that is counted by row, and one by point, day and source.
    """
    spark, text = df.sparkSession, "check_name string, status string, measure double"
    if df.isEmpty():
        return spark.createDataFrame([("row_count", "FAIL", 0.0)], text)
    first = spark.createDataFrame([], text)
    if wanted is not None:
        have = dict(df.dtypes)
        bad = sum(have.get(f.name) != f.dataType.simpleString() for f in wanted)
        first = spark.createDataFrame([("schema", "FAIL" if bad else "PASS", float(bad))], text)
        if bad:
            return first
    optical, radar = F.col("source") == "S2", F.col("source") == "S1"
    inside = F.col("lon").between(box[0] - margin, box[2] + margin) & F.col("lat").between(
        box[1] - margin, box[3] + margin
    )
    never = lambda m: F.lit(False)
    counted = [
        ("row_count", F.count(F.lit(1)), lambda m: m == 0, never),
        ("radar_presence", F.count_if(radar), never, lambda m: m == 0),
        (
            "null_bands", F.greatest(*[share(F.col(b).isNull(), optical) for b in indices.BANDS]), lambda m: m > 0.20,
            lambda m: m > 0.01
        ),
        (
            "band_range", F.greatest(*[F.count_if(~indices.reflectance(b).between(0.0, 1.5)) for b in indices.BANDS]),
            lambda m: m > 0, never
        ),
        (
            "index_range",
            F.greatest(*[F.count_if(~indices.spectral_index(n).between(-1.0, 1.0)) for n in ("NDVI", "NDWI", "NDRE")]),
            lambda m: m > 0, never
        ),
        ("purity", F.avg("scl_purity"), lambda m: m == 0, lambda m: m < 0.5),
        (
            "radar_integrity",
            F.count_if(radar & F.col("B02").isNotNull()) + F.count_if(radar & F.col("orbit").isNull()), lambda m: m > 0,
            never
        ),
        ("dates", F.size(F.collect_set("date")), lambda m: m < 10, never),  # days and months: some thousands at most
        ("months", F.size(F.collect_set("month")), never, lambda m: m < 6),
        ("outside_box", F.count_if(~inside), lambda m: m > 0, never),
    ]
    by_point = [
        ("pixel_ratio", F.count("point_id") / expected, lambda m: m < 0.30, lambda m: m < 0.80),
        ("duplicates", F.coalesce(F.sum("again"), F.lit(0)), lambda m: m > 0, never)
    ]
    per_point = df.groupBy("point_id", "date", "source").count().groupBy("point_id").agg(
        F.count_if(F.col("count") > 1).alias("again")
    )
    return first.unionByName(_stacked(df, counted)).unionByName(_stacked(per_point, by_point))


def _stacked(df: DataFrame, rules: list) -> DataFrame:
    """One aggregation, and a row for each of its measures."""
    row = df.agg(*[measure.cast("double").alias(name) for name, measure, _, _ in rules])
    parts = [
        F.struct(
            F.lit(name).alias("check_name"), _status(fail(F.col(name)), warn(F.col(name))).alias("status"),
            F.round(name, 6).alias("measure")
        )
        for name,
        _, fail, warn in rules
    ]
    return row.select(F.explode(F.array(*parts)).alias("e")).select("e.*")


def region_tags(df: DataFrame) -> DataFrame:
    """Per region the facts about its optical rows and the faults they show, as ``tags``.

    DUPES (a point and day twice), SPARSE (under 5 points), LOW_OBS (a point under 4 rows), NAN (null bands), RANGE (a band's mean
    outside 0 .. 12000), S1_MISS (no radar), S1_SCALE (radar median above 1: not linear power); EMPTY alone where
    a region has no optical rows. Regions may hold most of the table: their median of radar values comes from the
    distributed sort, and the other facts combine before the shuffle.
    """
    from gridwake.operators.order_stats import percentiles, value_counts

    optical, radar = df.where(F.col("source") == "S2"), df.where(F.col("source") == "S1")
    per_day = optical.groupBy("region_id", "point_id", "date").agg(F.count(F.lit(1)).alias("c"))
    per_point = per_day.groupBy("region_id", "point_id").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("again")
    )
    points = per_point.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("n").alias("obs_min"), F.median("n").alias("obs_median"),
        F.max("n").alias("obs_max"), F.sum("again").alias("n_dup")
    )
    mean, std = [F.avg(b) for b in indices.BANDS], [F.stddev_samp(b) for b in indices.BANDS]
    total = lambda parts: functools.reduce(Column.__add__, parts)
    facts = optical.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_obs"), total([F.count_if(F.col(b).isNull()) for b in indices.BANDS]).alias("n_null"),
        (total(mean) / len(mean)).alias("band_mean"), (total(std) / len(std)).alias("band_std"),
        F.greatest(*mean).alias("top"), F.least(*mean).alias("bottom")
    )
    middle = percentiles(value_counts(radar, ["region_id"], "vh"), ["region_id"], {"vh_median": 0.5}).drop("n_rows")
    joined = df.select("region_id").distinct().join(facts, "region_id", "left").join(points, "region_id", "left").join(
        middle, "region_id", "left"
    )
    found = [
        ("DUPES", "n_dup > 0"), ("SPARSE", "n_points < 5"), ("LOW_OBS", "obs_min < 4"), ("NAN", "n_null > 0"),
        ("RANGE", "top > 12000 OR bottom < 0"), ("S1_MISS", "vh_median IS NULL"), ("S1_SCALE", "vh_median > 1")
    ]
    tags = F.array_join(F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in found])), ",")
    return joined.withColumn("tags", F.when(F.col("n_obs").isNull(), "EMPTY").otherwise(tags))


def chunk_completeness(
    df: DataFrame, chunk: Sequence[str], complete: float = 0.95, share_of_dates: float = 0.95, least: int = 4,
    listed: DataFrame | None = None
) -> DataFrame:
    """Per chunk: points, rows of the grid, radar dates and how completely they cover the rows, and the verdict.

    Chunks of ``listed`` that have no rows in ``df`` are EMPTY.
    """
    from gridwake.functions import ids

    y = ids.northing(F.col("point_id"))
    shape = df.groupBy(*chunk).agg(F.countDistinct("point_id").alias("n_points"), F.countDistinct(y).alias("n_rows"))
    dates = df.where(F.col("source") == "S1").groupBy(*chunk, "date").agg(F.countDistinct(y).alias("cover"))
    judged = dates.join(shape, list(chunk)).groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("n_dates"), F.median("cover").alias("cover_median"), F.max("cover").alias("cover_max"),
        F.count_if(F.col("cover") >= complete * F.col("n_rows")).alias("n_complete")
    )
    points = df.groupBy(*chunk, "point_id").agg(F.count_if(F.col("source") == "S1").alias("n1")).groupBy(*chunk).agg(
        F.count_if(F.col("n1") >= least).alias("n_enough")
    )
    out = shape.join(points, list(chunk)).join(judged, list(chunk), "left")
    if listed is not None:
        out = listed.select(*chunk).distinct().join(out, list(chunk), "full")
    out = out.fillna(0, ["n_points", "n_rows", "n_enough", "n_dates", "n_complete"])
    enough = F.try_divide(100 * F.col("n_enough"), F.col("n_points"))
    verdict = F.when(F.col("n_points") == 0, "EMPTY").when(F.col("n_dates") == 0, "S1_MISS").when(
        F.col("n_complete") < share_of_dates * F.col("n_dates"),
        F.when(
            (enough >= 90) & (F.col("cover_median") < 0.5 * F.col("n_rows")), "S1_TRUNC_OK"
        ).otherwise("S1_INCOMPLETE")
    ).otherwise("OK")
    return out.withColumn("verdict", verdict)
