"""Preparing, gating, merging and de-duplicating observation tables."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.functions import ids, indices

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("point_id",)]
    + [T.StructField(n, T.FloatType()) for n in ("lon", "lat")]
    + [
        T.StructField("date", T.DateType()), T.StructField("item_id", T.StringType()),
        T.StructField("tile_id", T.StringType())
    ]
    + [T.StructField(b, T.IntegerType()) for b in indices.BANDS]
    + [T.StructField("scl_purity", T.ByteType()), T.StructField("scl", T.ByteType())]
    + [T.StructField(n, T.ShortType()) for n in ("aot", "view_zenith", "sun_zenith")]
    + [
        T.StructField("source", T.StringType()), T.StructField("vh", T.FloatType()), T.StructField("vv", T.FloatType()),
        T.StructField("orbit", T.StringType())
    ]
)


def conform(df: DataFrame, schema: T.StructType = SCHEMA, fractions_stay: Sequence[str] = ()) -> DataFrame:
    """The schema's columns in its order: missing ones null, others cast (bad values null), the rest dropped.

    Columns named in ``fractions_stay`` keep a fractional type and are never cast to whole numbers.
    """
    have = {f.name: f.dataType for f in df.schema}

    def one(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if field.name in fractions_stay and isinstance(have[field.name], (T.FloatType, T.DoubleType)):
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema])


def prepare(df: DataFrame) -> DataFrame:
    """Source filled in, NaN made null, year, month and day of year added."""
    out = df.withColumn("source", F.coalesce("source", F.lit("S2")))
    out = out.withColumns({c: indices.clean(F.col(c).cast("double")) for c in ("vh", "vv", "NDVI") if c in df.columns})
    out = out.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat") if c in df.columns})
    return out.withColumns({"year": F.year("date"), "month": F.month("date"), "doy": F.dayofyear("date")})


def optical(df: DataFrame, purity: float = 1.0) -> DataFrame:
    """Optical rows of enough purity; a table without those columns passes whole."""
    if "source" in df.columns:
        df = df.where(F.col("source") == "S2")
    return df.where(F.col("scl_purity") >= purity) if "scl_purity" in df.columns else df


def radar(df: DataFrame) -> DataFrame:
    return df.where(F.col("source") == "S1")


def mixed(df: DataFrame, purity: float = 1.0) -> DataFrame:
    """Radar rows as they are, optical ones of enough purity."""
    return df.where((F.col("source") == "S1") | (F.col("scl_purity") >= purity))


def without_water(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce((F.col("source") == "S2") & (F.col("scl") == 6), F.lit(False)))


def with_all_bands(df: DataFrame, bands: Sequence[str] = tuple(indices.BANDS)) -> DataFrame:
    full = functools.reduce(operator.and_, [F.col(b).isNotNull() for b in bands])
    return df.where((F.col("source") == "S1") | full)


def in_box(df: DataFrame, box: Sequence[float]) -> DataFrame:
    return df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def enough(df: DataFrame, optical_min: int = 10, radar_min: int | None = None) -> DataFrame:
    """Rows of those (point, year) windows that have enough observations of each kind."""
    n2, n1 = F.count_if(F.col("source") == "S2"), F.count_if(F.col("source") == "S1")
    kept = df.groupBy("point_id", "year").agg(n2.alias("n2"), n1.alias("n1")).where(
        (F.col("n2") >= optical_min) & (F.col("n1") >= (radar_min or 0))
    )
    return df.join(kept.select("point_id", "year"), ["point_id", "year"], "left_semi")


def contaminated_dates(df: DataFrame, months: Sequence[int] = (1, 2, 3, 4, 5), below: float = 0.05) -> DataFrame:
    """Dates of the wet months on which the mean index of the whole table is near zero."""
    return df.where(F.col("month").isin(*months)).groupBy("date").agg(
        F.avg("index").alias("mean_index")
    ).where(F.col("mean_index") < below)


def every_nth_point(points: DataFrame, n: int, exempt: Column | None = None) -> DataFrame:
    """Every n-th of the distinct points in the order of latitude and longitude, by a distributed numbering; exempt ones all stay."""
    from gridwake.operators.order_stats import numbered

    slim = points.select("point_id", "lon", "lat")
    counted = slim if exempt is None else slim.where(~F.coalesce(exempt, F.lit(False)))
    placed = numbered(
        counted, [], ["lat", "lon", "point_id"], "_place"
    ).where((F.col("_place") - 1) % n == 0).select("point_id", "lon", "lat")
    return placed if exempt is None else placed.unionByName(slim.where(exempt))


def pin_years(df: DataFrame, points: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of ``df`` but those whose point lies in a region's box and whose year is outside the region's first to last year."""
    from gridwake.operators.proximity import locate_in_boxes

    boxes = regions.select(
        F.struct(F.array_min("years").alias("lo"), F.array_max("years").alias("hi"), "id").alias("bid"),
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_lo", "y_lo", "x_hi", "y_hi"))]
    )
    held = locate_in_boxes(
        points.select(F.col("point_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y")), boxes
    )
    years = held.groupBy(F.col("pid").alias("point_id")).agg(F.max("bid.lo").alias("_lo"), F.min("bid.hi").alias("_hi"))
    return df.join(years, "point_id", "left").where(
        ~F.coalesce((F.col("year") < F.col("_lo")) | (F.col("year") > F.col("_hi")), F.lit(False))
    ).drop("_lo", "_hi")


def best_per_day(df: DataFrame) -> DataFrame:
    """One optical row per point and day: purest first, then by scene and observation; radar rows stay."""
    order = Window.partitionBy("point_id", "date").orderBy(
        F.desc_nulls_last("scl_purity"), F.asc_nulls_last("item_id"), "obs_id", "loaded_at"
    )
    chosen = df.where(F.col("source") == "S2").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return chosen.unionByName(df.where(F.col("source") != "S2"))


def latest_delivery(df: DataFrame, key: str = "obs_id", by: str | None = "loaded_at") -> DataFrame:
    """One row per key, the last delivered; rows without a key are left out.

    Without ``by`` (a table that does not say when rows came) the largest row of a key stays, so that the result does
    not depend on the order of the files. Copies are reduced to one row per task before the shuffle: Spark puts a
    limit of one row per key in front of it, or combines the aggregation, so a key with a third of all rows
    sends one row per task. Of deliveries at the same moment any one stays.
    """
    known = df.where(F.col(key).isNotNull())
    if by is None:
        rest = [c for c in df.columns if c != key]
        return known.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)
    # A window, not an aggregation of structs: columns that nobody reads afterwards are never shuffled.
    order = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last())
    return known.withColumn("_delivery", F.row_number().over(order)).where("_delivery = 1").drop("_delivery")


def merged(*frames: DataFrame) -> DataFrame:
    """Union by name, missing columns null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


STORAGE_ORDER = ("_y", "point_id", "date", "_impure")


def with_storage_order(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``STORAGE_ORDER``: northing, and a number that puts the purest first and unknown purity last."""
    return df.withColumns(
        {"_y": ids.northing(F.col("point_id")), "_impure": F.coalesce(-F.col("scl_purity"), F.lit(1))}
    )


def by_northing(df: DataFrame) -> DataFrame:
    """Spread by northing and sorted within each part, ready to be written so that scans prune well."""
    return with_storage_order(df).repartitionByRange(
        "_y", "point_id"
    ).sortWithinPartitions(*STORAGE_ORDER).drop("_y", "_impure")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``new``, and what of ``old`` has other keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def place_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``(point_id, label, first_year, last_year)`` of the points that lie in a region's box, located once.

    The label is that of the last region by ``ordinal``; of several regions the latest beginning and the earliest end hold.
    """
    from gridwake.operators.proximity import locate_in_boxes

    years = [F.array_min("years").alias("lo"), F.array_max("years").alias("hi")]
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_lo", "y_lo", "x_hi", "y_hi"))]
    boxes = regions.select(F.struct("ordinal", "label", *years).alias("bid"), *box)
    held = locate_in_boxes(
        points.select(F.col("point_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y")), boxes
    )
    return held.groupBy(F.col("pid").alias("point_id")).agg(
        F.max_by("bid.label", "bid.ordinal").alias("label"), F.max("bid.lo").alias("first_year"),
        F.min("bid.hi").alias("last_year")
    )


def label_by_box(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The label of the last region (by ``ordinal``) whose box holds the point; null outside all."""
    from gridwake.operators.proximity import locate_in_boxes

    boxes = regions.select(
        F.struct("ordinal", "label").alias("bid"),
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_lo", "y_lo", "x_hi", "y_hi"))]
    )
    held = locate_in_boxes(
        points.select(F.col("point_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y")), boxes
    )
    labels = held.groupBy("pid").agg(F.max_by("bid.label", "bid.ordinal").alias("label"))
    return points.join(labels.withColumnRenamed("pid", "point_id"), "point_id", "left")
