"""Reading, restricting and writing tables; each writer can be called again without harm."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.operators.observations import by_northing


def csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def extent(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("point_id").alias("n_points"), F.countDistinct("point_id", F.year("date")).alias("n_windows"),
        F.count(F.lit(1)).alias("n_rows")
    )


def restrict(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose keys are (or are not) in the other frame; its columns are the keys. Only one may be given."""
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    other, how = (include, "left_semi") if include is not None else (exclude, "left_anti")
    return df.join(other, other.columns, how)


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds and size per key: a manifest that lets later reads skip what lies elsewhere."""
    bound = lambda f, c, n: F.round(f(c), 6).alias(n)
    return df.groupBy(*keys).agg(
        bound(F.min, "lon", "west"), bound(F.min, "lat", "south"), bound(F.max, "lon", "east"),
        bound(F.max, "lat", "north"), F.count(F.lit(1)).alias("n")
    )


def polygons(spark: SparkSession, text: str) -> DataFrame:
    """Outer rings of a GeoJSON text (a configuration file, read by the driver), with their bounds."""
    rows = []
    for feature in json.loads(text)["features"]:
        ring = feature["geometry"]["coordinates"][0]
        ring = ring[:-1] if ring[0] == ring[-1] else ring
        xs, ys = [float(p[0]) for p in ring], [float(p[1]) for p in ring]
        rows.append((feature["properties"].get("name"), len(ring), min(xs), min(ys), max(xs), max(ys)))
    return spark.createDataFrame(
        rows, "name string, n_corners int, west double, south double, east double, north double"
    )


def regions_from_config(entries: Sequence[dict]) -> list[dict]:
    """Region entries of a configuration; a single ``year`` stands for it and the five years before.

    An entry without years or with an id given twice is refused; the order stays.
    """
    seen, out = set(), []
    for e in entries:
        years = list(e.get("years") or ([] if e.get("year") is None else range(e["year"] - 5, e["year"] + 1)))
        if not years:
            raise ValueError(f"{e['id']} has no years")
        if e["id"] in seen:
            raise ValueError(f"{e['id']} is there twice")
        seen.add(e["id"])
        out.append({**e, "years": years})
    return out


def select_regions(entries: Sequence[dict], wanted: Sequence[str]) -> list[dict]:
    by_id = {e["id"]: e for e in entries}
    return [by_id[w] for w in wanted]


def write_sorted(df: DataFrame, path: str) -> None:
    by_northing(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes unless a finished table with as many rows is there; whether it wrote."""
    if _exists(df.sparkSession, path) and df.sparkSession.read.parquet(path).count() == df.count():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def ensure_sorted(df: DataFrame, path: str) -> bool:
    if _exists(df.sparkSession, path):
        return False
    write_sorted(df, path)
    return True


def covered(scores: DataFrame, coords: DataFrame, key: str, worst: float = 0.05, doubtful: float = 0.001) -> DataFrame:
    """Scores with their coordinates.

    Fails if no score has any, or more than ``worst`` of them have none, and warns beyond ``doubtful``; no scores at all are no fault.
    """
    joined = scores.join(coords, key, "left")
    facts = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lon").isNull()).alias("missing")).first()
    share = facts["missing"] / facts["n"] if facts["n"] else 0.0
    if facts["n"] and facts["missing"] == facts["n"]:
        raise ValueError("none of the scores has coordinates")
    if share > worst:
        raise ValueError(f"{share:.1%} of the scores have no coordinates")
    if share > doubtful:
        warnings.warn(f"{share:.2%} of the scores have no coordinates", stacklevel=2)
    return joined.where("lon IS NOT NULL")


def at_nearest(rows: DataFrame, points: DataFrame, lon: float, lat: float) -> DataFrame:
    """All rows of the point nearest to a place; one row is chosen by a pre-aggregated minimum, then joined."""
    distance = F.pow(F.col("lon") - lon, 2) + F.pow(F.col("lat") - lat, 2)
    nearest = points.agg(
        F.min(F.struct(distance.alias("q"), F.col("point_id").alias("point_id"))).alias("m")
    ).select("m.point_id")
    return rows.join(nearest, "point_id", "left_semi")


def markdown(df: DataFrame, *columns: str) -> DataFrame:
    """A small table as the lines of a Markdown table, in order."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]),
        F.lit(" |")
    )
    body = df.select(line.alias("line"))
    first = df.sparkSession.createDataFrame([(h,) for h in head], "line string")
    return first.unionByName(body)
