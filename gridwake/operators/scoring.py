"""Scoring of windows by a pluggable model, and from yearly to final scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions import indices
from gridwake.operators.order_stats import numbered


def linear_scorer(weights: dict[str, float], bias: float) -> Column:
    """A logistic model as one expression: the default scorer, wholly inside the generated code."""
    total = F.lit(float(bias))
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return indices.sigmoid(total)


def score_with(
    df: DataFrame, model: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Any model that maps Arrow batches of windows to Arrow batches of scores."""
    return df.mapInArrow(model, schema)


def cascade(df: DataFrame, gate: Column, full: Column, threshold: float) -> DataFrame:
    """A cheap score for all, the full one for those that pass; the others get 0."""
    gated = df.withColumn("gate", gate)
    return gated.withColumn("score", F.when(F.col("gate") >= threshold, full).otherwise(0.0))


def over_years(yearly: DataFrame, end_year: int, rate: float, score: str = "score") -> DataFrame:
    """Decay-weighted mean of the yearly scores per point."""
    weight = F.exp(-rate * (F.lit(end_year) - F.col("year")))
    return yearly.where(F.col(score).isNotNull()).groupBy("point_id").agg(
        (F.sum(weight * F.col(score)) / F.sum(weight)).alias("score")
    )


def ranking(coords: DataFrame, scores: DataFrame, labels: DataFrame) -> DataFrame:
    """All points with score, label and rank (highest first, unscored null)."""
    joined = coords.join(scores, "point_id", "left").join(labels, "point_id", "left")
    ordered = joined.withColumns({"_none": F.col("score").isNull(), "_down": -F.col("score")})
    placed = numbered(ordered, [], ["_none", "_down", "point_id"], "_place").drop("_none", "_down")
    return placed.withColumn("rank", F.when(F.col("score").isNotNull(), F.col("_place")).cast("int")).drop("_place")


def to_grid(df: DataFrame, row: Column, col: Column, score: str = "score") -> DataFrame:
    """The highest score of each cell."""
    return df.groupBy(row.alias("row"), col.alias("col")).agg(F.max(score).alias("value"))


def dry_heuristic(df: DataFrame, least: float = -18.0) -> DataFrame:
    """1 where the mean dry-season VH reaches ``least`` decibels, 0 below, null without readings."""
    mean = F.avg(F.when(F.col("doy").between(121, 304), indices.decibel(F.col("vh"))))
    return df.groupBy("point_id").agg(mean.alias("vh_dry")).select(
        "point_id", "vh_dry",
        F.when(F.col("vh_dry") >= least, 1.0).when(F.col("vh_dry").isNotNull(), 0.0).alias("score")
    )


def harmonise(df: DataFrame, bands: Sequence[str], low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Correction factors ``(tile_id, band, year, scale_factor)`` that fit each tile to the one with most rows.

    Tiles are compared where they saw the same 10 m cell on the same day; the factor is one over the median ratio to the reference
    tile, within limits. Ratios are limited to 0.5 .. 2, well beyond those limits, and taken to five decimals, so that a median's
    state is the counts of 150,001 values at most. A single tile, or no common cells, gives an empty table.
    """
    cells = df.where("tile_id IS NOT NULL").select(
        "tile_id", "year", "date", F.round(F.col("lon") * 10_000).alias("cx"),
        F.round(F.col("lat") * 10_000).alias("cy"), *bands
    )
    # One row: the tile with most rows, the first in the alphabet if several.
    reference = cells.groupBy("tile_id").count().orderBy(F.desc("count"), "tile_id").limit(1).select(
        F.col("tile_id").alias("ref")
    )
    tall = cells.select(
        "tile_id", "year", "date", "cx", "cy",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])
        ).alias("e")
    ).select("tile_id", "year", "date", "cx", "cy", "e.band", "e.v").where("v > 0")
    mine = tall.groupBy("tile_id", "year", "date", "cx", "cy", "band").agg(F.avg("v").alias("v"))
    ours = mine.join(
        F.broadcast(reference), F.col("tile_id") == F.col("ref"), "left_semi"
    ).select("year", "date", "cx", "cy", "band", F.col("v").alias("rv"))
    others = mine.join(F.broadcast(reference), F.col("tile_id") == F.col("ref"), "left_anti")
    ratios = others.join(ours, ["year", "date", "cx", "cy", "band"]).withColumn(
        "ratio", F.round(indices.clamp(F.col("v") / F.col("rv"), 0.5, 2.0) + 1e-9, 5)
    )
    return ratios.groupBy("tile_id", "band", "year").agg(F.median("ratio").alias("m")).where("m > 0").select(
        "tile_id", "band", "year", F.least(F.greatest(1 / F.col("m"), F.lit(low)), F.lit(high)).alias("scale_factor")
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands times their factor; rows without one stay as they are. One join, the factors pivoted to columns."""
    wide = corrections.groupBy("tile_id", "year").agg(
        *[F.max(F.when(F.col("band") == b, F.col("scale_factor"))).alias(f"f_{b}") for b in bands]
    )
    joined = df.join(wide, ["tile_id", "year"], "left")
    return joined.withColumns(
        {b: F.col(b) * F.coalesce(f"f_{b}", F.lit(1.0)) for b in bands}
    ).drop(*[f"f_{b}" for b in bands])
