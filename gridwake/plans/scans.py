"""Sources, sinks, projections, filters, joins, ordering, set operations and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridwake.functions import geodesy, ids, indices
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.plans.base import BANDS, BOX, GOOD, obs, regions, with_obs, table
from gridwake.plans.registry import Registry
from gridwake.session import work_folder
from gridwake.sources import readers, tables

R = Registry()
LON, LAT = f"lon BETWEEN {BOX[0]} AND {BOX[2]}", f"lat BETWEEN {BOX[1]} AND {BOX[3]}"
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def scratch(spark, name):
    return f"{work_folder(spark)}/{name}/{uuid.uuid4().hex}"


# ---- sources -------------------------------------------------------------------------------------------


@R.add(
    "src_01",
    f"SELECT obs_id, point_id, date, B08, B04 FROM observations WHERE source = 'S2' AND scl_purity = 1 AND date >= "
    f"DATE '2020-01-01'"
)
def src_01(spark, d):
    return table(spark, d, "observations").where(
        (F.col("source") == "S2") & (F.col("scl_purity") == 1) & (F.col("date") >= "2020-01-01")
    ).select("obs_id", "point_id", "date", "B08", "B04")


@R.add(
    "src_02",
    "SELECT point_id, lon, lat, NULL::INT AS label FROM observations WHERE source = 'S1' UNION ALL SELECT point_id, "
    "lon::FLOAT, lat::FLOAT, label FROM science_points"
)
def src_02(spark, d):
    a = table(spark, d, "observations").where("source = 'S1'").select("point_id", "lon", "lat")
    b = table(spark, d, "science_points").select(
        "point_id", F.col("lon").cast("float"), F.col("lat").cast("float"), "label"
    )
    return ob.merged(a, b)


@R.add(
    "src_03",
    "SELECT count(DISTINCT point_id) AS n_points, count(DISTINCT (point_id, year(date))) AS n_windows, count(*) AS "
    "n_rows FROM observations"
)
def src_03(spark, d):
    return readers.extent(table(spark, d, "observations"))


@R.add(
    "src_04",
    "SELECT point_id, count(*) AS n FROM observations WHERE region_id IN (SELECT id FROM training_regions WHERE "
    "label = 'presence') GROUP BY ALL"
)
def src_04(spark, d):
    wanted = table(spark, d, "training_regions").where("label = 'presence'").select(F.col("id").alias("region_id"))
    return readers.restrict(
        table(spark, d, "observations"), include=wanted
    ).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "src_04_exclude",
    "SELECT point_id, count(*) AS n FROM observations WHERE region_id NOT IN (SELECT id FROM training_regions WHERE "
    "label = 'presence') GROUP BY ALL"
)
def src_04_exclude(spark, d):
    unwanted = table(spark, d, "training_regions").where("label = 'presence'").select(F.col("id").alias("region_id"))
    return readers.restrict(
        table(spark, d, "observations"), exclude=unwanted
    ).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("src_05", f"SELECT obs_id, lon, lat FROM observations WHERE {LON} AND {LAT}")
def src_05(spark, d):
    return ob.in_box(table(spark, d, "observations"), BOX).select("obs_id", "lon", "lat")


@R.add("src_06", "SELECT count(DISTINCT point_id) AS n_points FROM observations")
def src_06(spark, d):
    return table(spark, d, "observations").agg(F.countDistinct("point_id").alias("n_points"))


@R.add(
    "src_07",
    "SELECT count(*) AS n_windows FROM (SELECT DISTINCT point_id, year(date) FROM observations WHERE year(date) <= 2020)"
)
def src_07(spark, d):
    return table(spark, d, "observations").where(F.year("date") <= 2020).select(
        "point_id", F.year("date").alias("year")
    ).distinct().agg(F.count(F.lit(1)).alias("n_windows"))


_SCORES = "scores AS (SELECT point_id, round(1 / (1 + exp(-avg(i_ndvi) * 4 + 1)), 6) AS score FROM obs WHERE " + GOOD + " GROUP BY ALL)"


def point_scores(spark, d):
    return ob.optical(obs(spark, d)).groupBy("point_id").agg(
        F.round(indices.sigmoid(F.avg("i_ndvi") * 4 - 1), 6).alias("score")
    )


@R.add("src_08", with_obs(_SCORES) + "SELECT point_id, score FROM scores")
def src_08(spark, d):
    path = scratch(spark, "scores_csv")
    point_scores(spark, d).write.option("header", True).csv(path)
    return readers.csv(spark, path, "point_id string, score double")


@R.add("src_09", "SELECT id, unnest(years)::INT AS year, label FROM training_regions")
def src_09(spark, d):
    return table(spark, d, "training_regions").select("id", F.explode("years").alias("year"), "label")


@R.add(
    "src_10",
    "SELECT id, bbox[1] AS lon_min, bbox[2] AS lat_min, bbox[3] AS lon_max, bbox[4] AS lat_max FROM training_regions"
)
def src_10(spark, d):
    return table(spark, d, "training_regions").select(
        "id", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("lon_min", "lat_min", "lon_max", "lat_max"))]
    )


@R.add(
    "src_11",
    "SELECT * FROM (VALUES ('field', 4, 140.0::DOUBLE, -20.0::DOUBLE, 143.0::DOUBLE, -17.0::DOUBLE)) t(name, "
    "n_corners, west, south, east, north)"
)
def src_11(spark, d):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"field"},"geometry":{"type":"Polygon","coordinates":[[[140,-20],[143,-19],[142,-17],[141,-18],[140,-20]]]}}]}'
    return readers.polygons(spark, text)


@R.add(
    "src_12",
    "SELECT DISTINCT upper(tile) AS tile, CASE WHEN substr(upper(tile), 3, 1) < 'N' THEN 32700 ELSE 32600 END + "
    "substr(tile, 1, 2)::INT AS epsg FROM chunk_reports WHERE tile IS NOT NULL"
)
def src_12(spark, d):
    tiles = table(spark, d, "chunk_reports").where("tile IS NOT NULL").select(F.upper("tile").alias("tile")).distinct()
    return tiles.select("tile", geodesy.epsg_of_tile(F.col("tile")).alias("epsg"))


@R.add("src_13", "SELECT item_id, min(date) AS date, count(*) AS n FROM observations WHERE item_id IS NOT NULL AND date BETWEEN DATE '2018-01-01' AND DATE '2018-12-31' GROUP BY item_id "
       f"HAVING min(lon) <= {BOX[2]} AND max(lon) >= {BOX[0]} AND min(lat) <= {BOX[3]} AND max(lat) >= {BOX[1]}")
def src_13(spark, d):
    scenes = table(spark, d, "observations").where(
        "item_id IS NOT NULL AND date BETWEEN '2018-01-01' AND '2018-12-31'"
    ).groupBy("item_id").agg(
        F.min("date").alias("date"), F.count(F.lit(1)).alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.min("lat").alias("s"), F.max("lat").alias("no")
    )
    return scenes.where(
        geodesy.overlaps((F.col("w"), F.col("s"), F.col("e"), F.col("no")), tuple(F.lit(x) for x in BOX))
    ).select("item_id", "date", "n")


@R.add(
    "src_16",
    "SELECT c.file_id, c.point_id, c.date, c.value FROM chunk_rows c JOIN (SELECT DISTINCT file_id, point_id FROM "
    "chunk_rows WHERE source = 'S1') k USING (file_id, point_id) WHERE source = 'S2'"
)
def src_16(spark, d):
    rows = table(spark, d, "chunk_rows")
    keys = rows.where("source = 'S1'").select("file_id", "point_id").distinct()
    return rows.where("source = 'S2'").join(keys, ["file_id", "point_id"]).select(
        "file_id", "point_id", "date", "value"
    )


@R.add(
    "src_17",
    "SELECT file_id, path FROM chunk_reports WHERE regexp_extract(path, '[/\\\\]([0-9]{4})[/\\\\]', 1)::INT BETWEEN "
    "2019 AND 2021 AND upper(regexp_extract(path, '([0-9]{1,2}[A-Za-z]{3})_r', 1)) LIKE '5%'"
)
def src_17(spark, d):
    from gridwake.operators.compaction import chunk_of_path

    parts = chunk_of_path(F.col("path"))
    return table(spark, d, "chunk_reports").where(
        parts["year"].between(2019, 2021) & parts["tile"].startswith("5")
    ).select("file_id", "path")


@R.add(
    "src_18",
    "SELECT tile_id, year(date)::INT AS year, round(min(lon::DOUBLE), 6) AS west, round(min(lat::DOUBLE), 6) AS "
    "south, round(max(lon::DOUBLE), 6) AS east, round(max(lat::DOUBLE), 6) AS north, count(*) AS n FROM observations "
    "WHERE tile_id IS NOT NULL GROUP BY ALL"
)
def src_18(spark, d):
    return readers.coverage(obs(spark, d).where("tile_id IS NOT NULL"), ["tile_id", "year"])


# ---- sinks: written to the shared folder and read back ------------------------------------------------------


@R.add("snk_01", "SELECT obs_id, point_id, date FROM observations WHERE source = 'S1'")
def snk_01(spark, d):
    path = scratch(spark, "snk_01")
    readers.write_sorted(
        table(spark, d, "observations").where("source = 'S1'").select("obs_id", "point_id", "date", "scl_purity"), path
    )
    return spark.read.parquet(path).select("obs_id", "point_id", "date")


@R.add("snk_02", "SELECT count(*) AS n_rows, 1 AS writes FROM science_points")
def snk_02(spark, d):
    path, df = scratch(spark, "snk_02"), table(spark, d, "science_points")
    writes = sum(readers.write_once(df, path) for _ in range(2))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("writes", F.lit(int(writes)))


@R.add("snk_03", "SELECT year(date)::INT AS year, count(*) AS n FROM observations GROUP BY ALL")
def snk_03(spark, d):
    path = scratch(spark, "snk_03")
    table(spark, d, "observations").select(
        "obs_id", F.year("date").alias("year")
    ).repartition("year").write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@R.add("snk_04", "SELECT count(DISTINCT point_id) AS n_points FROM observations")
def snk_04(spark, d):
    path = scratch(spark, "snk_04")
    readers.extent(table(spark, d, "observations")).select("n_points").write.parquet(path)
    return spark.read.parquet(path)


@R.add(
    "snk_05",
    with_obs(_SCORES)
    + "SELECT point_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC NULLS LAST, point_id)::INT "
    "AS rank FROM scores"
)
def snk_05(spark, d):
    from gridwake.operators.order_stats import numbered

    path = scratch(spark, "snk_05")
    scores = point_scores(spark, d).withColumns(
        {"_none": F.col("score").isNull(), "_down": -F.col("score"), "_unnamed": F.col("point_id").isNull()}
    )
    # Scaled before rounding, as in SQL: 0.67585 * 10000 lies below the half, while Spark's round goes by the digits.
    numbered(scores, [], ["_none", "_down", "_unnamed", "point_id"], "rank").select(
        "point_id", (F.round(F.col("score") * 10_000) / 10_000).alias("score"), F.col("rank").cast("int")
    ).orderBy("rank").coalesce(1).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    # A null value that does not occur: otherwise a quoted empty id would be read as null too.
    return readers.csv(spark, path, "point_id string, score double, rank int", nullValue="\0")


@R.add(
    "snk_06",
    with_obs()
    + f"SELECT region_id, count(*) AS n_dates, sum(n)::BIGINT AS n_obs FROM (SELECT region_id, date, count(*) AS n "
    f"FROM obs WHERE {GOOD} GROUP BY ALL) GROUP BY ALL"
)
def snk_06(spark, d):
    per_date = ob.optical(obs(spark, d)).groupBy("region_id", "date").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "snk_06")
    per_date.groupBy("region_id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("date", "n")))).alias("series")
    ).write.json(path)
    back = spark.read.schema("region_id string, series string").json(path).withColumn(
        "s", F.from_json("series", "array<struct<date:date,n:long>>")
    )
    return back.select(
        "region_id", F.size("s").cast("long").alias("n_dates"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_obs")
    )


_GRID_KEY = "(split_part(point_id, '_', -1)::BIGINT * 65536 + split_part(point_id, '_', -2)::BIGINT)"
_LIMITS = {"vh": (0.002, 0.040), "vv": (0.014, 0.151)}


@R.add(
    "snk_09",
    with_obs() + "SELECT *, row_number() OVER (PARTITION BY band ORDER BY key) AS place FROM ("
    + " "
    "UNION ALL ".join(
        f"SELECT '{b}' AS band, {_GRID_KEY} AS key, round(avg(least(greatest(({b} - {lo}) / ({hi} - {lo}), 0), 1)), "
        f"6) AS val FROM obs WHERE {b} IS NOT NULL GROUP BY ALL"
        for b,
        (lo, hi) in _LIMITS.items()
    )
    + ")"
)
def snk_09(spark, d):
    """A sorted grid of keys and normalised values for each radar band; the place shows the order it is stored in."""
    key = ids.northing(F.col("point_id")).cast("long") * 65536 + ids.easting(F.col("point_id"))
    bands = F.array(
        *[
            F.struct(F.lit(b).alias("band"), indices.min_max(F.col(b), lo, hi).alias("v")) for b,
            (lo, hi) in _LIMITS.items()
        ]
    )
    tall = obs(spark, d).select(key.alias("key"), F.explode(bands).alias("e")).where("e.v IS NOT NULL")
    grid = tall.groupBy("e.band", "key").agg(F.round(F.avg("e.v"), 6).alias("val"))
    return placed(grid, ["key"], "key", "val", groups=["band"])


@R.add(
    "snk_10",
    with_obs()
    + f"SELECT point_id, year, count(*) AS n_obs, list(doy ORDER BY doy, obs_id)[1:64] AS doys, list(round(i_ndvi, "
    f"6) ORDER BY doy, obs_id)[1:64] AS \"values\" FROM obs WHERE {GOOD} GROUP BY ALL"
)
def snk_10(spark, d):
    from gridwake.operators import windows

    path = scratch(spark, "snk_10")
    windows.sequences(ob.optical(obs(spark, d)), F.round("i_ndvi", 6), 64).write.parquet(path)
    return spark.read.parquet(path)


_PYRAMID = """cells AS (SELECT point_id, any_value(lon) AS lon, any_value(lat) AS lat, round(max(i_ndvi), 6) AS v FROM (SELECT point_id, min(lon) OVER (PARTITION BY point_id) AS lon, min(lat) OVER (PARTITION BY point_id) AS lat, i_ndvi FROM obs WHERE """ + GOOD + """) GROUP BY 1),
 px AS (SELECT z, v, floor((lon + 180) / 360 * 2.0 ** z * 256)::BIGINT AS px, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2.0 ** z * 256)::BIGINT AS py FROM cells, range(8, 17) r(z))"""


@R.add(
    "snk_08",
    with_obs(_PYRAMID)
    + "SELECT z::INT AS z, px // 256 AS tx, py // 256 AS ty, count(DISTINCT (px, py)) AS n_pixels, max(v) AS best, "
    "count(*) AS n_cells FROM px GROUP BY ALL"
)
def snk_08(spark, d):
    """The pyramid of map tiles, zoom 8 to 16: per tile its pixels of 256 x 256 that hold a value, and the highest."""
    cells = ob.optical(obs(spark, d)).groupBy("point_id").agg(
        F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.round(F.max("i_ndvi"), 6).alias("v")
    )
    levels = F.array(
        *[
            F.struct(
                F.lit(z).alias("z"),
                *[
                    c.cast("long").alias(n) for n,
                    c in zip(("px", "py"), geodesy.slippy(F.col("lon"), F.col("lat"), z + 8))
                ]
            )
            for z in range(8, 17)
        ]
    )
    pixels = cells.select("v", F.explode(levels).alias("e")).groupBy("e.z", "e.px", "e.py").agg(
        F.max("v").alias("v"), F.count(F.lit(1)).alias("n")
    )
    tile = lambda c: F.floor(F.col(c) / 256)
    return pixels.groupBy("z", tile("px").alias("tx"), tile("py").alias("ty")).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.max("v").alias("best"), F.sum("n").alias("n_cells")
    )


@R.add(
    "snk_07",
    "SELECT unnest(['| verdict | n |', '| --- | --- |']) AS line UNION ALL SELECT '| ' || coalesce(verdict, '-') || "
    "' | ' || n || ' |' FROM (SELECT verdict, count(*) AS n FROM year_summaries GROUP BY 1)"
)
def snk_07(spark, d):
    return readers.markdown(
        table(spark, d, "year_summaries").groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).orderBy("verdict"),
        "verdict", "n"
    )


# ---- projections ----------------------------------------------------------------------------------------------


@R.add("prj_01", "SELECT obs_id, " + ", ".join(f"{b} / 10000.0::DOUBLE AS r_{b}" for b in BANDS) + " FROM observations")
def prj_01(spark, d):
    return table(spark, d, "observations").select("obs_id", *[indices.reflectance(b).alias(f"r_{b}") for b in BANDS])


@R.add(
    "prj_02",
    "SELECT obs_id, CASE WHEN NOT isnan(NDVI) THEN least(greatest(round_even(NDVI::DOUBLE * 10000, 0), 0), "
    "65535)::INT END AS stored FROM observations"
)
def prj_02(spark, d):
    return table(spark, d, "observations").select(
        "obs_id", indices.to_storage(F.col("NDVI").cast("double")).alias("stored")
    )


_STORED = {
    "string": "VARCHAR", "float": "FLOAT", "date": "DATE", "int": "INTEGER", "tinyint": "TINYINT",
    "smallint": "SMALLINT"
}


@R.add(
    "prj_03",
    "SELECT "
    + ", ".join(
        f"{f.name if f.name in ('point_id', 'lon', 'lat') else 'NULL'}::{_STORED[f.dataType.simpleString()]} AS "
        f"{f.name}"
        for f in ob.SCHEMA
    )
    + " FROM science_points"
)
def prj_03(spark, d):
    """Another table brought into the canonical 25 columns: missing ones null, others cast, the rest dropped."""
    return ob.conform(table(spark, d, "science_points"))


@R.add("prj_04", "SELECT point_id, lon, lat, label::TINYINT AS label FROM science_points")
def prj_04(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("point_id", T.StringType()), T.StructField("lon", T.IntegerType()),
            T.StructField("lat", T.IntegerType()), T.StructField("label", T.ByteType())
        ]
    )
    return ob.conform(table(spark, d, "science_points"), schema, fractions_stay=("lon", "lat"))


@R.add("prj_05", "SELECT sighting_id, lon::FLOAT AS lon, lat::FLOAT AS lat, loaded_at::DATE AS day FROM sightings")
def prj_05(spark, d):
    return table(spark, d, "sightings").select(
        "sighting_id", F.col("lon").cast("float"), F.col("lat").cast("float"),
        F.col("loaded_at").cast("date").alias("day")
    )


@R.add("prj_06", "SELECT obs_id, year(date)::INT AS year, dayofyear(date)::INT AS doy FROM observations")
def prj_06(spark, d):
    return table(spark, d, "observations").select(
        "obs_id", F.year("date").alias("year"), F.dayofyear("date").alias("doy")
    )


@R.add("prj_07", "SELECT coalesce(source, 'S2') AS source, count(*) AS n FROM observations GROUP BY 1")
def prj_07(spark, d):
    return table(spark, d, "observations").groupBy(
        F.coalesce("source", F.lit("S2")).alias("source")
    ).agg(F.count(F.lit(1)).alias("n"))


@R.add("prj_08", "SELECT obs_id, 'S2' AS source FROM observations WHERE source IS NULL")
def prj_08(spark, d):
    return table(spark, d, "observations").where("source IS NULL").select("obs_id", F.lit("S2").alias("source"))


@R.add(
    "prj_09",
    "SELECT DISTINCT file_id, CASE WHEN starts_with(point_id, 'px') THEN 'f' || file_id || substr(point_id, 3) ELSE "
    "point_id END AS point_id FROM chunk_rows"
)
def prj_09(spark, d):
    name = F.when(
        F.col("point_id").startswith("px"),
        F.concat(F.lit("f"), F.col("file_id").cast("string"), F.substring("point_id", 3, 1 << 20))
    ).otherwise(F.col("point_id"))
    return table(spark, d, "chunk_rows").select("file_id", name.alias("point_id")).distinct()


@R.add(
    "prj_10",
    "SELECT file_id, printf('px_%04d_%04d', chunk_row, chunk_col) AS point_id FROM chunk_reports WHERE chunk_row >= "
    "0 AND chunk_col >= 0"
)
def prj_10(spark, d):
    return table(spark, d, "chunk_reports").where("chunk_row >= 0 AND chunk_col >= 0").select(
        "file_id", ids.point_name("px", F.col("chunk_row"), F.col("chunk_col")).alias("point_id")
    )


@R.add(
    "prj_11",
    "SELECT obs_id, coalesce(nullif(tile_id, ''), nullif(regexp_extract(item_id, '^S2[ABC]_([0-9]{2}[A-Z]{3})_', 1), "
    "'')) AS tile FROM observations"
)
def prj_11(spark, d):
    return table(spark, d, "observations").select(
        "obs_id", ids.tile_or_item(F.col("tile_id"), F.col("item_id")).alias("tile")
    )


#: Regions carry no cover words, so these queries name them after the cover types in turn, by the length of the id.
COVERED = "region_id || ['', '_mangrove_1', '_bare_2', '_riparian_3', '_water_4'][length(region_id) % 5 + 1]"
COVER_SQL = "CASE WHEN contains(name, '_mangrove') THEN 'mangrove' WHEN contains(name, '_bare') THEN 'bare' WHEN contains(name, '_riparian') THEN 'riparian' WHEN contains(name, '_water') THEN 'water' ELSE 'presence' END"


def covered_name(region_id):
    words = F.array(*[F.lit(w) for w in ("", "_mangrove_1", "_bare_2", "_riparian_3", "_water_4")])
    return F.concat(region_id, F.get(words, F.length(region_id) % 5))


@R.add(
    "prj_12",
    with_obs(
        f"n AS (SELECT region_id, any_value(label) AS label, any_value({COVERED}) AS name FROM obs GROUP BY region_id)"
    )
    + f"SELECT region_id, label, {COVER_SQL} AS cover FROM n"
)
def prj_12(spark, d):
    regions_ = obs(spark, d).groupBy("region_id").agg(F.min("label").alias("label"))
    return regions_.withColumn("cover", ids.cover_type(covered_name(F.col("region_id"))))


@R.add(
    "prj_13",
    with_obs()
    + "SELECT CASE WHEN month BETWEEN 4 AND 9 THEN 'dry' ELSE 'wet' END AS season, count(*) AS n FROM obs GROUP BY ALL"
)
def prj_13(spark, d):
    return obs(spark, d).groupBy(
        F.when(F.col("month").between(4, 9), "dry").otherwise("wet").alias("season")
    ).agg(F.count(F.lit(1)).alias("n"))


# Tags that tell nothing apart.
COMMON_TAGS = ("arid", "semi-arid", "monsoonal", "riparian", "savanna", "gps_surveyed")
_POINTS = "pts AS (SELECT point_id, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY point_id)"


def tag_class(label, tags):
    """The label, followed by the first tag that tells regions apart."""
    first = F.get(F.filter(tags, lambda t: ~t.isin(*COMMON_TAGS)), F.lit(0))
    return F.concat(label, F.coalesce(F.concat(F.lit("/"), first), F.lit("")))


@R.add(
    "prj_14",
    with_obs(
        _POINTS,
        "tc AS (SELECT id, bbox, label || coalesce('/' || list_filter(tags, lambda t: t NOT IN ("
        + ", ".join(f"'{t}'" for t in COMMON_TAGS) + "))[1], '') AS tag_class FROM training_regions)"
    )
    + "SELECT point_id, max_by(tag_class, id) AS tag_class FROM pts JOIN tc ON lon BETWEEN bbox[1] AND bbox[3] AND "
    "lat BETWEEN bbox[2] AND bbox[4] GROUP BY point_id"
)
def prj_14(spark, d):
    """Each point's class by the last region whose box holds it; points outside all are left out."""
    named = regions(spark, d).withColumn("label", tag_class(F.col("label"), F.col("tags")))
    return ob.label_by_box(points(spark, d), named).where("label IS NOT NULL").select(
        "point_id", F.col("label").alias("tag_class")
    )


@R.add(
    "prj_15",
    with_obs(_SCORES) + "SELECT point_id, round_even(least(greatest(score, 0), 1) * 100, 0)::INT AS prob FROM scores"
)
def prj_15(spark, d):
    return point_scores(spark, d).select("point_id", indices.percent(F.col("score")).alias("prob"))


# ---- filters --------------------------------------------------------------------------------------------------


def _ids(name, where, f):
    R.add(
        name, with_obs() + f"SELECT obs_id FROM obs WHERE {where}"
    )(lambda spark, d: f(obs(spark, d)).select("obs_id"))


_any_band_null = " OR ".join(f"{b} IS NULL" for b in BANDS)
_ids("flt_01", GOOD, ob.optical)
_ids("flt_02", "source = 'S1'", ob.radar)
_ids("flt_03", "source = 'S1' OR scl_purity >= 1", ob.mixed)
_ids("flt_04", "NOT coalesce(source = 'S2' AND scl = 6, false)", ob.without_water)
_ids("flt_05", f"source = 'S1' OR NOT ({_any_band_null})", ob.with_all_bands)
_ids("flt_06", "vh IS NOT NULL OR vv IS NOT NULL", lambda df: df.dropna(how="all", subset=["vh", "vv"]))
_ids("flt_07", f"{LON} AND {LAT}", lambda df: ob.in_box(df, BOX))
_ids("flt_08", "doy BETWEEN 121 AND 304", lambda df: df.where(F.col("doy").between(121, 304)))
_ids("flt_09", "year <= 2019", lambda df: df.where(F.col("year") <= 2019))
_ids(
    "flt_10", "contains(item_id, '_55') OR item_id IS NULL",
    lambda df: df.where(F.col("item_id").contains("_55") | F.col("item_id").isNull())
)
_ids(
    "flt_13", "NOT (starts_with(point_id, 'gate_') OR starts_with(point_id, 'luninya_spur'))",
    lambda df: df.where(~(F.col("point_id").startswith("gate_") | F.col("point_id").startswith("luninya_spur")))
)


@R.add(
    "flt_11",
    "SELECT obs_id FROM observations WHERE regexp_replace(point_id, '_[0-9]+_[0-9]+$', '') IN (SELECT id FROM "
    "training_regions WHERE len(years) >= 3)"
)
def flt_11(spark, d):
    wanted = table(spark, d, "training_regions").where(F.size("years") >= 3).select(F.col("id").alias("_region"))
    return table(spark, d, "observations").withColumn(
        "_region", ids.region(F.col("point_id"))
    ).join(wanted, "_region", "left_semi").select("obs_id")


@R.add(
    "flt_12",
    with_obs(
        _POINTS,
        "pn AS (SELECT point_id, max(list_min(years)) AS lo, min(list_max(years)) AS hi FROM pts JOIN "
        "training_regions ON lon BETWEEN bbox[1] AND bbox[3] AND lat BETWEEN bbox[2] AND bbox[4] GROUP BY 1)"
    )
    + "SELECT obs_id FROM obs LEFT JOIN pn USING (point_id) WHERE NOT coalesce(year < lo OR year > hi, false)"
)
def flt_12(spark, d):
    """Without rows that lie in a region's box outside its years; rows outside all boxes stay.

    Points are located once; of overlapping regions the latest beginning and the earliest end decide.
    """
    return ob.pin_years(obs(spark, d), points(spark, d), regions(spark, d)).select("obs_id")


_N2, _N1 = "count(*) FILTER (source = 'S2')", "count(*) FILTER (source = 'S1')"


@R.add(
    "flt_14",
    with_obs(f"k AS (SELECT point_id, year FROM obs GROUP BY ALL HAVING {_N2} >= 10 AND {_N1} >= 4)")
    + "SELECT obs_id FROM obs SEMI JOIN k USING (point_id, year)"
)
def flt_14(spark, d):
    return ob.enough(obs(spark, d), 10, 4).select("obs_id")


_DRY = """w AS (SELECT point_id, year, any_value(label) AS label, avg(vh_db) FILTER (doy BETWEEN 121 AND 304) AS vh_dry, avg(i_ndvi) FILTER (doy BETWEEN 121 AND 304 AND source = 'S2' AND scl IN (4, 5)) AS ndvi_dry FROM obs GROUP BY point_id, year)"""


def dry_windows(spark, d):
    dry = F.col("doy").between(121, 304)
    return obs(spark, d).groupBy("point_id", "year").agg(
        F.min("label").alias("label"), F.avg(F.when(dry, F.col("vh_db"))).alias("vh_dry"),
        F.avg(F.when(dry & (F.col("source") == "S2") & F.col("scl").isin(4, 5), F.col("i_ndvi"))).alias("ndvi_dry")
    )


@R.add(
    "flt_15",
    with_obs(_DRY)
    + "SELECT point_id, year, label FROM w WHERE NOT (label = 'presence' AND coalesce(vh_dry < -16 AND NOT "
    "coalesce(vh_dry >= -17 AND ndvi_dry >= 0.3, false), false))"
)
def flt_15(spark, d):
    from gridwake.operators.windows import presence_filter

    return presence_filter(dry_windows(spark, d), -16.0, -17.0, 0.3).select("point_id", "year", "label")


@R.add(
    "flt_16",
    with_obs()
    + f"SELECT date, round(avg(i_ndvi), 6) AS mean_index FROM obs WHERE {GOOD} AND month IN (1, 2, 3, 4, 5) GROUP BY "
    f"date HAVING avg(i_ndvi) < 0.25"
)
def flt_16(spark, d):
    return ob.contaminated_dates(
        ob.optical(obs(spark, d)).withColumn("index", F.col("i_ndvi")), below=0.25
    ).select("date", r6("mean_index"))


@R.add(
    "flt_17",
    f"SELECT id FROM training_regions WHERE bbox[1] <= {BOX[2]} AND bbox[3] >= {BOX[0]} AND bbox[2] <= {BOX[3]} AND "
    f"bbox[4] >= {BOX[1]}"
)
def flt_17(spark, d):
    return table(spark, d, "training_regions").where(
        geodesy.overlaps(tuple(F.get("bbox", F.lit(i)) for i in range(4)), tuple(F.lit(x) for x in BOX))
    ).select("id")


def points(spark, d):
    return obs(spark, d).groupBy("point_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))


EXEMPT = ("luninya_spur", "quoribo_bend")


@R.add(
    "flt_18",
    with_obs(
        _POINTS,
        "k AS (SELECT *, regexp_replace(regexp_extract(point_id, '^(.+?)_(presence|absence)', 1), '_val$', '') IN "
        "('luninya_spur', 'quoribo_bend') AS exempt FROM pts)"
    )
    + "SELECT point_id FROM (SELECT *, row_number() OVER (ORDER BY lat, lon, point_id) AS n FROM k WHERE NOT exempt) "
    "WHERE (n - 1) % 5 = 0 UNION ALL SELECT point_id FROM k WHERE exempt"
)
def flt_18(spark, d):
    """Every fifth point from south to north; points of exempt sites all stay."""
    return ob.every_nth_point(points(spark, d), 5, exempt=ids.site(F.col("point_id")).isin(*EXEMPT)).select("point_id")


# ---- joins ----------------------------------------------------------------------------------------------------

_STATS = "st AS (SELECT point_id, year, avg(i_ndvi) AS m, stddev_samp(i_ndvi) AS s FROM obs WHERE " + GOOD + " GROUP BY ALL)"


def _stats(spark, d):
    return ob.optical(obs(spark, d)).groupBy("point_id", "year").agg(
        F.avg("i_ndvi").alias("m"), F.stddev_samp("i_ndvi").alias("s")
    )


@R.add(
    "join_01",
    with_obs(_STATS)
    + f"SELECT obs_id, round((i_ndvi - m) / greatest(coalesce(s, 1e-6), 1e-6), 4) AS z FROM obs LEFT JOIN st USING "
    f"(point_id, year) WHERE {GOOD}"
)
def join_01(spark, d):
    joined = ob.optical(obs(spark, d)).join(_stats(spark, d), ["point_id", "year"], "left")
    return joined.select(
        "obs_id",
        F.round((F.col("i_ndvi") - F.col("m")) / F.greatest(F.coalesce("s", F.lit(1e-6)), F.lit(1e-6)), 4).alias("z")
    )


@R.add(
    "join_02",
    with_obs("k AS (SELECT point_id, year FROM obs WHERE source = 'S2' GROUP BY ALL HAVING count(*) >= 40)")
    + "SELECT o.obs_id FROM obs o JOIN k USING (point_id, year)"
)
def join_02(spark, d):
    df = obs(spark, d)
    kept = df.where("source = 'S2'").groupBy("point_id", "year").count().where("count >= 40").select("point_id", "year")
    return df.join(kept, ["point_id", "year"], "left_semi").select("obs_id")


@R.add(
    "join_03",
    with_obs(
        f"a AS (SELECT point_id, year, count(*) AS n2 FROM obs WHERE {GOOD} GROUP BY ALL)",
        "b AS (SELECT point_id, year, count(*) AS n1, round(avg(vh_db), 6) AS vh FROM obs WHERE source = 'S1' GROUP BY ALL)"
    )
    + "SELECT point_id, year, n2, n1, vh FROM a LEFT JOIN b USING (point_id, year)"
)
def join_03(spark, d):
    df = obs(spark, d)
    a = ob.optical(df).groupBy("point_id", "year").agg(F.count(F.lit(1)).alias("n2"))
    return a.join(
        ob.radar(df).groupBy("point_id", "year").agg(F.count(F.lit(1)).alias("n1"), r6(F.avg("vh_db"), "vh")),
        ["point_id", "year"], "left"
    )


@R.add(
    "join_04",
    with_obs(
        "l AS (SELECT point_id, min(label) AS label FROM obs GROUP BY 1)",
        "w AS (SELECT DISTINCT point_id, year FROM obs)"
    )
    + "SELECT point_id, year, label FROM w JOIN l USING (point_id)"
)
def join_04(spark, d):
    df = obs(spark, d)
    return df.select("point_id", "year").distinct().join(
        df.groupBy("point_id").agg(F.min("label").alias("label")), "point_id"
    ).select("point_id", "year", "label")


@R.add(
    "join_05",
    "WITH m AS (SELECT point_id, ((row_number() OVER (ORDER BY point_id) - 1) % 16)::INT AS shard FROM (SELECT "
    "DISTINCT point_id FROM observations)) SELECT shard, count(*) AS n_rows, count(DISTINCT point_id) AS n_points, "
    "min(point_id) AS first FROM observations JOIN m USING (point_id) GROUP BY 1"
)
def join_05(spark, d):
    """Rows routed to shards by a shard map of the points, and what each shard then holds."""
    from gridwake.operators.order_stats import numbered

    rows = table(spark, d, "observations").select("obs_id", "point_id")
    shards = numbered(rows.select("point_id").distinct(), [], ["point_id"], "_n").select(
        "point_id", ((F.col("_n") - 1) % 16).cast("int").alias("shard")
    )
    per_point = rows.join(shards, "point_id", "left").groupBy("shard", "point_id").agg(F.count(F.lit(1)).alias("n"))
    return per_point.groupBy("shard").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_points"), F.min("point_id").alias("first")
    )


@R.add(
    "join_06",
    with_obs(
        "s AS (SELECT obs_id, loaded_at, quantile_cont(vh, 0.5) OVER (PARTITION BY point_id ORDER BY date, obs_id "
        "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM obs WHERE source = 'S1')"
    )
    + "SELECT o.obs_id, round(coalesce(s.smooth, o.vh), 8) AS vh FROM (SELECT * FROM obs WHERE source = 'S1') o LEFT "
    "JOIN s USING (obs_id, loaded_at)"
)
def join_06(spark, d):
    from gridwake.operators.windows import despeckle

    df = ob.radar(obs(spark, d)).withColumn("raw", F.col("vh"))
    return despeckle(df, ["vh"], 3).select("obs_id", F.round(F.coalesce("vh", "raw"), 8).alias("vh"))


@R.add("join_07", with_obs(_SCORES, _POINTS) + "SELECT point_id, lon, lat, score FROM scores JOIN pts USING (point_id)")
def join_07(spark, d):
    return readers.covered(
        point_scores(spark, d), points(spark, d), "point_id", worst=0.05
    ).select("point_id", "lon", "lat", "score")


@R.add("join_08", with_obs(_SCORES, _POINTS) + "SELECT point_id, lon, lat FROM pts SEMI JOIN scores USING (point_id)")
def join_08(spark, d):
    return points(spark, d).join(point_scores(spark, d), "point_id", "left_semi").select("point_id", "lon", "lat")


_LABELS = "lab AS (SELECT point_id, min(label) AS label FROM obs GROUP BY 1)"


@R.add(
    "join_09",
    with_obs(_SCORES, _POINTS, _LABELS)
    + "SELECT point_id, lon, lat, score, label, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score "
    "DESC NULLS LAST, point_id)::INT END AS rank FROM pts LEFT JOIN scores USING (point_id) LEFT JOIN lab USING "
    "(point_id)"
)
def join_09(spark, d):
    labels = obs(spark, d).groupBy("point_id").agg(F.min("label").alias("label"))
    return scoring.ranking(points(spark, d), point_scores(spark, d), labels)


_CELLS = "c AS (SELECT round(lon * 10000) AS cx, round(lat * 10000) AS cy, date, tile_id, obs_id FROM obs WHERE tile_id IS NOT NULL)"


@R.add(
    "join_10",
    with_obs(_CELLS)
    + "SELECT obs_id FROM c JOIN (SELECT cx, cy, date FROM c GROUP BY ALL HAVING count(DISTINCT tile_id) > 1) k "
    "USING (cx, cy, date)"
)
def join_10(spark, d):
    c = obs(spark, d).where("tile_id IS NOT NULL").select(
        F.round(F.col("lon") * 10000).alias("cx"), F.round(F.col("lat") * 10000).alias("cy"), "date", "tile_id",
        "obs_id"
    )
    shared = c.groupBy("cx", "cy", "date").agg(F.countDistinct("tile_id").alias("n")).where("n > 1")
    return c.join(shared, ["cx", "cy", "date"], "left_semi").select("obs_id")


@R.add(
    "join_12",
    with_obs(
        "a AS (SELECT point_id, year, avg(i_ndvi) AS v FROM obs WHERE source = 'S2' GROUP BY ALL)",
        f"b AS (SELECT point_id, year, avg(i_ndvi) AS v FROM obs WHERE {GOOD} GROUP BY ALL)"
    )
    + "SELECT point_id, year, round(b.v - a.v, 6) AS delta FROM a JOIN b USING (point_id, year)"
)
def join_12(spark, d):
    df = obs(spark, d)
    mean = lambda x, name: x.groupBy("point_id", "year").agg(F.avg("i_ndvi").alias(name))
    joined = mean(df.where("source = 'S2'"), "before").join(mean(ob.optical(df), "after"), ["point_id", "year"])
    return joined.select("point_id", "year", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


@R.add(
    "join_13",
    with_obs(
        "a AS (SELECT point_id, avg(i_ndvi) AS ndvi FROM obs WHERE " + GOOD
        + " AND doy BETWEEN 121 AND 304 GROUP BY 1)",
        "b AS (SELECT point_id, avg(vh_db) AS vh FROM obs WHERE source = 'S1' AND doy BETWEEN 121 AND 304 GROUP BY 1)"
    )
    + "SELECT point_id, round(ndvi, 6) AS ndvi, round(vh, 6) AS vh FROM a LEFT JOIN b USING (point_id)"
)
def join_13(spark, d):
    dry = obs(spark, d).where(F.col("doy").between(121, 304))
    a = ob.optical(dry).groupBy("point_id").agg(r6(F.avg("i_ndvi"), "ndvi"))
    return a.join(ob.radar(dry).groupBy("point_id").agg(r6(F.avg("vh_db"), "vh")), "point_id", "left")


@R.add(
    "join_14",
    with_obs(_SCORES, _POINTS, "b AS (SELECT round(lat, 1) AS band, count(*) AS n FROM obs GROUP BY 1)")
    + "SELECT band, any_value(n) AS n, round(median(score), 6) AS score FROM b LEFT JOIN (SELECT round(lat, 1) AS "
    "band, score FROM scores JOIN pts USING (point_id)) USING (band) GROUP BY band"
)
def join_14(spark, d):
    band = F.round("lat", 1).alias("band")
    counts = obs(spark, d).groupBy(band).agg(F.count(F.lit(1)).alias("n"))
    scores = point_scores(spark, d).join(points(spark, d), "point_id").groupBy(band).agg(r6(F.median("score"), "score"))
    return counts.join(scores, "band", "left")


@R.add(
    "join_15",
    with_obs(_POINTS)
    + "SELECT point_id, (SELECT max_by(label, id) FROM training_regions WHERE lon BETWEEN bbox[1] AND bbox[3] AND "
    "lat BETWEEN bbox[2] AND bbox[4]) AS label FROM pts"
)
def join_15(spark, d):
    return ob.label_by_box(points(spark, d), regions(spark, d)).select("point_id", "label")


@R.add(
    "join_16",
    with_obs(_POINTS)
    + "SELECT point_id, id FROM pts JOIN training_regions ON lon BETWEEN bbox[1] AND bbox[3] AND abs(lon - (bbox[1] "
    "+ bbox[3]) / 2) / ((bbox[3] - bbox[1]) / 2) + abs(lat - (bbox[2] + bbox[4]) / 2) / ((bbox[4] - bbox[2]) / 2) <= 1"
)
def join_16(spark, d):
    """Points in a table of polygons: here each region's diamond, whose corners are the middles of its box's sides."""
    from gridwake.operators.proximity import locate_in_polygons

    w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
    x, y = (w + e) / 2, (s + n) / 2
    ring = F.array(F.array(w, y), F.array(x, s), F.array(e, y), F.array(x, n))
    polygons = table(spark, d, "training_regions").select(F.col("id").alias("bid"), F.array(ring).alias("rings"))
    found = locate_in_polygons(
        points(spark, d).select(F.col("point_id").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y")),
        polygons
    )
    return found.select(F.col("pid").alias("point_id"), F.col("bid").alias("id"))


@R.add(
    "join_17",
    with_obs(_POINTS)
    + "SELECT o.obs_id, o.date FROM obs o JOIN (SELECT point_id FROM pts ORDER BY (lon - 142.0) ** 2 + (lat + 18.0) "
    "** 2, point_id LIMIT 1) USING (point_id)"
)
def join_17(spark, d):
    return readers.at_nearest(obs(spark, d), points(spark, d), 142.0, -18.0).select("obs_id", "date")


@R.add("join_18", "SELECT sample_id, point_id IN (SELECT point_id FROM science_points) AS included FROM tam_samples")
def join_18(spark, d):
    """Samples whose point is in a set of ids, and those whose point is not."""
    samples, wanted = table(spark, d, "tam_samples").select("sample_id", "point_id"), table(
        spark, d, "science_points"
    ).select("point_id")
    sides = [
        readers.restrict(samples, **{side: wanted}).select("sample_id", F.lit(side == "include").alias("included"))
        for side in ("include", "exclude")
    ]
    return ob.merged(*sides)


@R.add(
    "join_19",
    with_obs(
        "st AS (SELECT point_id, avg(i_ndvi) AS m, stddev_samp(i_ndvi) AS s FROM obs WHERE " + GOOD
        + " AND year <= 2016 GROUP BY 1)"
    )
    + f"SELECT obs_id, round((i_ndvi - coalesce(m, 0)) / coalesce(s, 1), 4) AS z FROM obs LEFT JOIN st USING "
    f"(point_id) WHERE {GOOD}"
)
def join_19(spark, d):
    df = ob.optical(obs(spark, d))
    stats = df.where("year <= 2016").groupBy("point_id").agg(
        F.avg("i_ndvi").alias("m"), F.stddev_samp("i_ndvi").alias("s")
    )
    return df.join(stats, "point_id", "left").select(
        "obs_id", F.round((F.col("i_ndvi") - F.coalesce("m", F.lit(0.0))) / F.coalesce("s", F.lit(1.0)), 4).alias("z")
    )


@R.add(
    "join_20",
    "SELECT sample_id, coalesce(n, 0) AS n_readings FROM (SELECT DISTINCT sample_id, point_id, year FROM "
    "tam_samples) LEFT JOIN (SELECT point_id, year(date) AS year, count(*) AS n FROM observations GROUP BY ALL) "
    "USING (point_id, year)"
)
def join_20(spark, d):
    samples = table(spark, d, "tam_samples").select("sample_id", "point_id", "year").distinct()
    counts = table(spark, d, "observations").groupBy(
        "point_id", F.year("date").alias("year")
    ).agg(F.count(F.lit(1)).alias("n"))
    return samples.join(counts, ["point_id", "year"], "left").select(
        "sample_id", F.coalesce("n", F.lit(0)).alias("n_readings")
    )


# ---- order, sets, merges -----------------------------------------------------------------------------------------


def placed(df, order, *keep, groups=()):
    """The columns ``keep`` and each row's place in the order, so that the order itself can be compared."""
    from gridwake.operators.order_stats import numbered

    return numbered(df, list(groups), order, "place").select(*keep, *groups, "place")


_NORTHING = "coalesce(try_cast(split_part(point_id, '_', -1) AS INT), 0)"
_SORTED = "coalesce(-scl_purity, 1), obs_id"


@R.add(
    "srt_01",
    f"SELECT obs_id, row_number() OVER (ORDER BY {_NORTHING}, point_id, date, {_SORTED}) AS place FROM observations"
)
def srt_01(spark, d):
    """The order in which observations are stored: northing, point, date, purest first."""
    df = table(spark, d, "observations").select("obs_id", "point_id", "date", "scl_purity")
    return placed(ob.with_storage_order(df), [*ob.STORAGE_ORDER, "obs_id"], "obs_id")


@R.add(
    "srt_02",
    f"SELECT obs_id, row_number() OVER (ORDER BY {_NORTHING}, date, point_id, obs_id) AS place, vh IS NOT NULL AS "
    f"has_vh, scl_purity IS NOT NULL AS has_purity FROM (SELECT obs_id, point_id, date, NULL AS scl_purity, vh FROM "
    f"observations WHERE source = 'S1' UNION ALL SELECT obs_id, point_id, date, scl_purity, NULL FROM observations "
    f"WHERE source IS DISTINCT FROM 'S1')"
)
def srt_02(spark, d):
    """Two tables of different columns merged in the order of northing and date."""
    df = table(spark, d, "observations").select("obs_id", "point_id", "date", "scl_purity", "vh", "source")
    both = ob.merged(df.where("source = 'S1'").drop("scl_purity"), df.where("source IS DISTINCT FROM 'S1'").drop("vh"))
    both = both.withColumn("_y", ids.northing(F.col("point_id"))).withColumns(
        {"has_vh": F.col("vh").isNotNull(), "has_purity": F.col("scl_purity").isNotNull()}
    )
    return placed(both, ["_y", "date", "point_id", "obs_id"], "obs_id", "has_vh", "has_purity")


@R.add(
    "srt_03",
    f"SELECT obs_id, coalesce(source, 'S2') AS source, row_number() OVER (ORDER BY {_NORTHING}, point_id, date, "
    f"coalesce(source, 'S2'), obs_id) AS place FROM observations"
)
def srt_03(spark, d):
    """Optical and radar tables merged, tagged with their source, in the order of northing, point and date."""
    df = table(spark, d, "observations")
    s2 = df.where("source IS DISTINCT FROM 'S1'").select("obs_id", "point_id", "date", F.lit("S2").alias("source"))
    both = ob.merged(s2, df.where("source = 'S1'").select("obs_id", "point_id", "date", F.lit("S1").alias("source")))
    return placed(
        both.withColumn("_y", ids.northing(F.col("point_id"))), ["_y", "point_id", "date", "source", "obs_id"],
        "obs_id", "source"
    )


@R.add(
    "srt_04",
    f"SELECT obs_id, ({_NORTHING} // 64)::BIGINT AS band, row_number() OVER (PARTITION BY {_NORTHING} // 64 ORDER BY "
    f"point_id, date, {_SORTED}) AS place, n_points FROM observations JOIN (SELECT {_NORTHING} // 64 AS b, "
    f"count(DISTINCT point_id) AS n_points FROM observations GROUP BY 1) ON b = {_NORTHING} // 64"
)
def srt_04(spark, d):
    """Scenes merged within bands of 64 rows, in the order of point, date and purity, with each band's number of points."""
    df = table(spark, d, "observations").select("obs_id", "point_id", "date", "scl_purity").withColumn(
        "band", F.floor(ids.northing(F.col("point_id")) / 64)
    )
    sizes = df.groupBy("band").agg(F.countDistinct("point_id").alias("n_points"))
    ordered = placed(ob.with_storage_order(df), ["point_id", "date", "_impure", "obs_id"], "obs_id", groups=["band"])
    return ordered.join(sizes, "band").select("obs_id", "band", "place", "n_points")


@R.add(
    "srt_05",
    "SELECT file_id, point_id, date, source, value, row_number() OVER (ORDER BY file_id % 2, file_id, point_id, date "
    "NULLS FIRST, source NULLS FIRST, value NULLS FIRST) AS place FROM chunk_rows"
)
def srt_05(spark, d):
    """Two strips one after the other, each in its own order."""
    rows = table(spark, d, "chunk_rows")
    strips = [rows.where(f"file_id % 2 = {k}").withColumn("_strip", F.lit(k)) for k in (0, 1)]
    columns = ["file_id", "point_id", "date", "source", "value"]
    return placed(ob.merged(*strips), ["_strip", *columns], *columns)


@R.add(
    "srt_06",
    "SELECT file_id, row_number() OVER (ORDER BY chunk_row NULLS FIRST, chunk_col NULLS FIRST, file_id)::INT AS "
    "place FROM chunk_reports"
)
def srt_06(spark, d):
    from gridwake.operators.order_stats import numbered

    chunks = table(spark, d, "chunk_reports").select("file_id", "chunk_row", "chunk_col")
    return numbered(
        chunks, [], ["chunk_row", "chunk_col", "file_id"], "place"
    ).select("file_id", F.col("place").cast("int").alias("place"))


@R.add(
    "srt_07",
    with_obs()
    + f"SELECT month, round(avg(i_ndvi), 6) AS v FROM obs WHERE {GOOD} GROUP BY month ORDER BY v DESC, month LIMIT 3"
)
def srt_07(spark, d):
    return ob.optical(obs(spark, d)).groupBy("month").agg(
        r6(F.avg("i_ndvi"), "v")
    ).orderBy(F.desc("v"), "month").limit(3)


@R.add(
    "srt_08",
    "SELECT region_id, arg_max(tile_id, struct_pack(n := n, t := tile_id)) AS tile FROM (SELECT region_id, tile_id, "
    "count(*) AS n FROM observations WHERE tile_id IS NOT NULL GROUP BY ALL) GROUP BY region_id"
)
def srt_08(spark, d):
    counts = table(spark, d, "observations").where("tile_id IS NOT NULL").groupBy("region_id", "tile_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("region_id").agg(F.max_by("tile_id", F.struct("n", "tile_id")).alias("tile"))


@R.add(
    "set_01",
    "SELECT point_id AS id, lon, lat, label FROM science_points UNION ALL SELECT id, bbox[1], bbox[2], NULL FROM "
    "training_regions"
)
def set_01(spark, d):
    a = table(spark, d, "science_points").select(F.col("point_id").alias("id"), "lon", "lat", "label")
    return ob.merged(
        a,
        table(spark, d, "training_regions").select(
            "id", F.get("bbox", F.lit(0)).alias("lon"), F.get("bbox", F.lit(1)).alias("lat")
        )
    )


@R.add("set_02", "SELECT point_id FROM observations UNION ALL SELECT point_id FROM chunk_rows")
def set_02(spark, d):
    return table(spark, d, "observations").select("point_id").union(table(spark, d, "chunk_rows").select("point_id"))


@R.add("set_03", "SELECT DISTINCT point_id, year(date)::INT AS year FROM observations")
def set_03(spark, d):
    return table(spark, d, "observations").select("point_id", F.year("date").alias("year")).distinct()


@R.add(
    "set_04",
    "WITH a AS (SELECT DISTINCT date FROM observations WHERE source = 'S1'), b AS (SELECT DISTINCT date FROM "
    "observations WHERE source = 'S2') SELECT 'difference' AS kind, date FROM (SELECT * FROM a EXCEPT SELECT * FROM "
    "b) UNION ALL SELECT 'intersection', date FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT "
    "'union', date FROM (SELECT * FROM a UNION SELECT * FROM b)"
)
def set_04(spark, d):
    """Dates that radar alone saw, that both saw, and that either saw, from one aggregation."""
    seen = table(spark, d, "observations").where("source IN ('S1', 'S2')").groupBy("date").agg(
        F.max(F.col("source") == "S1").alias("a"), F.max(F.col("source") == "S2").alias("b")
    )
    kinds = F.array(
        F.when(F.col("a") & ~F.col("b"), "difference"), F.when(F.col("a") & F.col("b"), "intersection"), F.lit("union")
    )
    return seen.select(F.explode(F.array_compact(kinds)).alias("kind"), "date")


@R.add(
    "set_05", "SELECT point_id, date, count(*) AS n FROM observations GROUP BY ALL HAVING count(*) > 1", repeated=True
)
def set_05(spark, d):
    return tables.table(spark, d, "observations").groupBy("point_id", "date").agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1")


@R.add(
    "set_06",
    "SELECT region_id, tile_id FROM (SELECT DISTINCT region_id, tile_id FROM observations WHERE tile_id IS NOT NULL "
    "AND region_id NOT LIKE 'l%') UNION ALL SELECT DISTINCT region_id, 'new' FROM observations WHERE region_id LIKE 'l%'"
)
def set_06(spark, d):
    df = table(spark, d, "observations")
    old = df.where("tile_id IS NOT NULL").select("region_id", "tile_id").distinct()
    return ob.upsert(
        old, df.where("region_id LIKE 'l%'").select("region_id", F.lit("new").alias("tile_id")).distinct(),
        ["region_id"]
    )


@R.add("srt_09", "SELECT count(*) AS n, 1 AS sorts FROM observations WHERE source = 'S1'")
def srt_09(spark, d):
    """Sorted once: the second call finds the sorted table and does nothing."""
    path, df = scratch(spark, "srt_09"), table(spark, d, "observations").where("source = 'S1'").select(
        "obs_id", "point_id", "date", "scl_purity"
    )
    done = [readers.ensure_sorted(df, path) for _ in range(2)]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("sorts", F.lit(sum(done)))


# ---- extraction ----------------------------------------------------------------------------------------------------


_CHIP_BANDS = ("B04", "B08", "B11")


@R.add("ext_01", with_obs("ch AS (SELECT item_id, region_id, avg(CASE WHEN scl IN (4, 5, 6, 11) THEN 1.0 ELSE 0.0 END) AS purity, avg(least(greatest(1 - aot * 0.001::DOUBLE, 0), 1)) AS aot, avg(greatest(0, 1 - view_zenith / 90.0::DOUBLE)) AS view, "
       + ", ".join(f"min_by({b}, struct_pack(p := point_id, o := obs_id)) FILTER ({b} IS NOT NULL) AS {b}" for b in _CHIP_BANDS) + ", count(*) AS n FROM obs WHERE source = 'S2' AND item_id IS NOT NULL AND scl IS NOT NULL GROUP BY ALL)")
       + "SELECT item_id, region_id, n, round(purity, 6) AS purity, round(coalesce(aot, 1), 6) AS aot, round(coalesce(view, 1), 6) AS view, " + ", ".join(f"{b} / 10000.0::DOUBLE AS {b}" for b in _CHIP_BANDS) + " FROM ch WHERE purity > 0 AND (" + " OR ".join(f"{b} IS NOT NULL" for b in _CHIP_BANDS) + ")")
def ext_01(spark, d):
    """Chips (a scene over a region) as observations: purity, qualities with default 1, and bands of the chip's first point as a map.

    A chip without scene classes or without a clear pixel is dropped; bands that are not there are left out of the map, and a chip
    with none is dropped.
    """
    clear = F.col("scl").isin(*indices.CLEAR_SCENE_CLASSES)
    rows = obs(spark, d).where("source = 'S2' AND item_id IS NOT NULL AND scl IS NOT NULL")
    first = lambda b: F.min(F.when(F.col(b).isNotNull(), F.struct("point_id", "obs_id", b)))[b]
    chips = rows.groupBy("item_id", "region_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(clear, 1.0).otherwise(0.0)).alias("purity"),
        F.avg(indices.clamp(1.0 - F.col("aot") * 0.001, 0.0, 1.0)).alias("aot"),
        F.avg(F.when(F.col("view_zenith").isNotNull(), indices.zenith_quality(F.col("view_zenith")))).alias("view"),
        *[first(b).alias(b) for b in _CHIP_BANDS]
    )
    bands = F.map_filter(
        F.create_map(*[x for b in _CHIP_BANDS for x in (F.lit(b), F.col(b) / 10_000.0)]), lambda _, v: v.isNotNull()
    )
    seen = chips.where("purity > 0").withColumn("bands", bands).where(F.size("bands") > 0)
    one = lambda c: F.round(F.coalesce(c, F.lit(1.0)), 6).alias(c)
    return seen.select(
        "item_id", "region_id", "n", r6("purity"), one("aot"), one("view"),
        *[F.try_element_at("bands", F.lit(b)).alias(b) for b in _CHIP_BANDS]
    )


_ANGLES = "radians(sun_zenith * 0.6) AS s, radians(view_zenith * 0.1) AS v, radians((doy * 7 % 180)::DOUBLE) AS a"


@R.add("ext_02", with_obs("cl AS (SELECT *, (" + " OR ".join(f"{b} IS NOT NULL" for b in BANDS) + f") AS has_value, {_ANGLES} FROM obs WHERE source = 'S2' AND scl IN (4, 5, 6, 11))", "sc AS (SELECT item_id FROM cl GROUP BY 1 HAVING bool_or(has_value))")
       + "SELECT obs_id, 1 AS scl_purity, round_even(least(greatest(1 - aot * 0.001::DOUBLE, 0), 1) * 100, 0)::INT "
       "AS aot, round_even(coalesce(greatest(0, 1 - sun_zenith * 0.6 / 90.0::DOUBLE), 1) * 100, 0)::INT AS "
       "sun_zenith, round_even(coalesce(greatest(0, 1 - view_zenith * 0.1 / 90.0::DOUBLE), 1) * 100, 0)::INT AS "
       "view_zenith, "
       + ", ".join(f"round(CASE WHEN {b} IS NOT NULL THEN least(greatest({b} / 10000.0::DOUBLE * coalesce({indices.brdf_sql(b)}, 1), 0), 1) END, 6) AS {b}" for b in BANDS) + " FROM cl WHERE item_id IN (SELECT item_id FROM sc) OR item_id IS NULL")
def ext_02(spark, d):
    """A scene's clear pixels, corrected to the standard geometry; a scene without any value in its clear pixels is dropped whole.

    The reflectance times the correction is limited to 0 .. 1; where the factor is unknown the value stays. Angles follow from the
    table's own columns by a rule, as it has no angle grids.
    """
    df = obs(spark, d).where((F.col("source") == "S2") & F.col("scl").isin(*indices.CLEAR_SCENE_CLASSES))
    some = F.coalesce(*BANDS).isNotNull()
    scenes = df.groupBy("item_id").agg(F.max(some).alias("some")).where("some OR item_id IS NULL").select("item_id")
    kept = df.alias("d").join(scenes.alias("s"), F.col("d.item_id").eqNullSafe(F.col("s.item_id")), "left_semi")
    sun, view, azimuth = F.col("sun_zenith") * 0.6, F.col("view_zenith") * 0.1, (F.col("doy") * 7 % 180).cast("double")
    kept = indices.with_brdf_kernels(kept, sun, view, azimuth)
    whole = lambda c: F.bround(c * 100, 0).cast("int")
    corrected = [
        F.round(
            indices.clamp(
                indices.reflectance(b) * F.coalesce(indices.brdf_from_kernels(b), F.lit(1.0)), 0.0, 1.0
            ),
            6
        ).alias(b)
        for b in BANDS
    ]
    zenith = lambda c: F.coalesce(F.when(c.isNotNull(), indices.zenith_quality(c)), F.lit(1.0))
    return kept.select(
        "obs_id", F.lit(1).alias("scl_purity"), whole(indices.clamp(1.0 - F.col("aot") * 0.001, 0.0, 1.0)).alias("aot"),
        whole(zenith(sun)).alias("sun_zenith"), whole(zenith(view)).alias("view_zenith"), *corrected
    )


@R.add(
    "ext_03",
    with_obs()
    + "SELECT obs_id, nullif(vh, 0) AS vh, nullif(vv, 0) AS vv, 'S1' AS source FROM obs WHERE source = 'S1' AND "
    "(nullif(vh, 0) IS NOT NULL OR nullif(vv, 0) IS NOT NULL)"
)
def ext_03(spark, d):
    return ob.radar(obs(spark, d)).select(
        "obs_id", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("vh", "vv")], F.lit("S1").alias("source")
    ).dropna(how="all", subset=["vh", "vv"])


@R.add(
    "ext_04",
    "SELECT regexp_replace(item_id, '_[0-9]+_L2A$', '') AS overpass, min(item_id) AS item_id FROM observations WHERE "
    "item_id IS NOT NULL GROUP BY 1"
)
def ext_04(spark, d):
    return table(spark, d, "observations").where("item_id IS NOT NULL").groupBy(
        ids.overpass(F.col("item_id")).alias("overpass")
    ).agg(F.min("item_id").alias("item_id"))


@R.add(
    "ext_05",
    "SELECT easting, ((sum(n) OVER (ORDER BY easting) - n) // 2000)::BIGINT AS shard FROM (SELECT "
    "regexp_extract(point_id, '_([0-9]+)_[0-9]+$', 1)::INT AS easting, count(*) AS n FROM observations GROUP BY 1)"
)
def ext_05(spark, d):
    from gridwake.operators.order_stats import running_totals

    columns = table(spark, d, "observations").groupBy(
        ids.easting(F.col("point_id")).alias("easting")
    ).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(columns, [], ["easting"], "n").select(
        "easting", F.floor((F.col("upto") - F.col("n")) / 2000).alias("shard")
    )


@R.add("ext_06", "SELECT tile_id, count(*) AS n FROM observations WHERE tile_id != '' GROUP BY 1")
def ext_06(spark, d):
    path = scratch(spark, "ext_06")
    table(
        spark, d, "observations"
    ).where("tile_id <> ''").select(
        "obs_id", "tile_id"
    ).repartition("tile_id").write.partitionBy("tile_id").parquet(path)
    return spark.read.schema(
        "obs_id long, tile_id string"
    ).parquet(path).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = R.queries, R.sql
