"""The queries of the core problems over the project's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.operators import compaction, proximity, regular_grid, spikes, timestamps
from gridwake.session import work_folder
from gridwake.sources import tables
from gridwake.sources.tables import table


def usable_ndvi(df: DataFrame) -> DataFrame:
    return df.where("NDVI IS NOT NULL AND NOT isnan(NDVI) AND scl_purity = 1 AND NDVI BETWEEN -1 AND 1")


OPTICAL_RADAR = [
    spikes.Channel("NDVI", "judged_ndvi", -1.0, 1.0),
    spikes.Channel("vh", "vh", 0.0, low_open=True, decibel=True),
    spikes.Channel("vv", "vv", 0.0, low_open=True, decibel=True),
]
RATIO = [spikes.Channel("vhvv_dry", "vhvv_dry", -40.0, 0.0)]


def _faults(spark: SparkSession, d: str, confirm: float | None) -> DataFrame:
    observations = table(spark, d, "observations").withColumn(
        "judged_ndvi", F.when(F.col("scl_purity") == 1, F.col("NDVI"))
    )
    summaries = table(spark, d, "year_summaries")
    found = spikes.flag_implausible(
        observations, ["point_id"], "date", "obs_id", OPTICAL_RADAR, confirm=confirm
    ).withColumn("tab", F.lit("observations"))
    return found.unionByName(
        spikes.flag_implausible(
            summaries, ["bbox_id"], "year", "summary_id", RATIO, confirm=confirm
        ).withColumn("tab", F.lit("year_summaries"))
    )


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings with the kind of fault and the usual deviations, spikes confirmed at eight of them."""
    return _faults(spark, d, 8.0).withColumn("deviations", F.round("deviations", 6))


def p2_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings by the phase space alone: spikes stand out in value, first or second difference."""
    return _faults(spark, d, None)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_faults(spark, d).select("tab", "rec_id", "field")


def _files_and_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = compaction.chunk_files(table(spark, d, "chunk_reports"))
    return files, compaction.plan_records(files, table(spark, d, "chunk_rows"))


#: The table of records is partitioned by these; a chunk's row and column are part of a record.
PLACE, SAME = ["tile", "year"], ["chunk_row", "chunk_col", "point_id", "date", "source"]


def _consolidated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    """The files, the consolidated table of their records, and its folder.

    The records are written as a table of many small files, as they come; partitions with small files are rewritten, where each
    distinct record stands once, with the smallest file_id that holds it.
    """
    root = f"{work_folder(spark)}/compaction/{uuid.uuid4().hex}"
    files = compaction.chunk_files(tables.table(spark, d, "chunk_reports"))
    rows = tables.table(spark, d, "chunk_rows").select("file_id", "point_id", "date", "source", "value")
    placed = rows.join(files.select("file_id", *compaction.CHUNK), "file_id")
    # Eight tasks write to every partition, so that there are small files to consolidate.
    compaction.append(spark, root, placed.repartition(8, "file_id").sortWithinPartitions(*PLACE), PLACE)
    compaction.compact(
        spark, root, PLACE, SAME, small_bytes=128 << 20, min_small=1, target_bytes=256 << 20, first=["file_id"]
    )
    return files, compaction.read(spark, root), root


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that keep no record in the consolidated table.

    The check behind it matters where a partition held well-sized files only and was left alone: a record's smallest file_id keeps it.
    """
    files, table, _ = _consolidated(spark, d)
    kept = table.groupBy(*PLACE, *SAME).agg(F.min("file_id").alias("file_id")).select("file_id").distinct()
    return files.select("file_id").join(kept, "file_id", "left_anti")


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk, what consolidation will do: files and records before, files after."""
    return compaction.plan_partitions(
        *_files_and_records(spark, d), small_bytes=128 << 20, min_small=2, target_rows=5_000_000
    )


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk of the consolidated table: its records, distinct points, and the files of its partition."""
    _, table, _ = _consolidated(spark, d)
    counted = table.withColumn("_file", F.col("_metadata.file_path"))
    per_file = counted.groupBy(*PLACE).agg(F.countDistinct("_file").alias("n_files"))
    per_point = counted.groupBy(*compaction.CHUNK, "point_id").agg(F.count(F.lit(1)).alias("n"))
    chunks = per_point.groupBy(*compaction.CHUNK).agg(
        F.sum("n").alias("n_records"), F.count("point_id").alias("n_points")
    )
    return chunks.join(per_file, PLACE).select(*compaction.CHUNK, "n_records", "n_points", "n_files")


def _instants(spark: SparkSession, d: str) -> DataFrame:
    sightings = table(spark, d, "sightings").where("sighting_id IS NOT NULL")
    parsed = timestamps.parse_moments(sightings, "eventDate", "month")
    # Parsed before the aggregation, so that no filter behind it repeats the parsing.
    latest = parsed.groupBy("sighting_id").agg(
        F.max(F.struct("loaded_at", "dataResourceName", "wall_us", "offset_s")).alias("r")
    ).select("sighting_id", "r.*")
    resources = table(spark, d, "data_resources").groupBy("dataResourceName").agg(F.min("time_zone").alias("zone"))
    placed = latest.join(resources, "dataResourceName", "left")
    # Zone names come from the IANA list: some 600 at most, so their list is bounded.
    names = [r[0] for r in resources.select("zone").where("zone IS NOT NULL").distinct().collect()]
    return timestamps.to_instants(placed, timestamps.zone_intervals(spark, names))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("utc_us IS NOT NULL").select("sighting_id", "utc_us")


def p5_states(spark: SparkSession, d: str) -> DataFrame:
    """How many sightings were placed in which way, per zone."""
    return _instants(spark, d).groupBy("zone", "zone_state").agg(F.count(F.lit(1)).alias("n"))


def _ndvi_series(spark: SparkSession, d: str) -> DataFrame:
    readings = usable_ndvi(table(spark, d, "observations")).select(
        "point_id", F.year("date").alias("year"), F.dayofyear("date").alias("doy"), "obs_id", F.lit(1.0).alias("one")
    )
    return regular_grid.regularise(
        readings, ["point_id", "year"], "doy", "one", step=16, max_span=1, rec_id="obs_id", delta=True
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _ndvi_series(spark, d).where("missing").select("point_id", "year", F.col("cell").cast("int").alias("period"))


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series: readings and covered days of each 16-day period, missing periods marked."""
    return _ndvi_series(spark, d).select(
        "point_id", "year", F.col("cell").cast("int").alias("period"), F.col("increment").alias("n_readings"),
        "covered", "missing"
    )


def p6_counters(spark: SparkSession, d: str) -> DataFrame:
    """A counter that starts anew each year, on a grid of 16 days: how many usable readings a point has had this year.

    Increments come from the differences of consecutive readings and from the resets, and are shared out over the days since the reading
    before, 32 at most; cells that no reading covers are marked.
    """
    usable = usable_ndvi(
        table(spark, d, "observations")
    ).select("obs_id", "point_id", "date").dropDuplicates(["obs_id"])
    days = usable.groupBy("point_id", "date").agg(F.count(F.lit(1)).alias("n"))
    # At most 366 days a point and year.
    order = Window.partitionBy("point_id", F.year("date")).orderBy("date")
    counter = days.select("point_id", F.unix_date("date").alias("day"), F.sum("n").over(order).alias("so_far"))
    series = regular_grid.regularise(counter, ["point_id"], "day", "so_far", step=16, max_span=32)
    return series.select(
        "point_id", "cell", F.round(F.col("increment") + 1e-9, 6).alias("increment"), "covered", "missing"
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sightings = table(spark, d, "sightings").where("sighting_id IS NOT NULL").groupBy("sighting_id").agg(
        F.max(F.struct("loaded_at", "lon", "lat", "year")).alias("r")
    ).select("sighting_id", "r.*")
    science = table(spark, d, "science_points").where("point_id IS NOT NULL").groupBy("point_id").agg(
        F.max(F.struct("lon", "lat")).alias("r")
    ).select("point_id", "r.*")
    near = proximity.near_points(
        sightings.select(F.col("sighting_id").alias("pid"), "lon", "lat"),
        science.select(F.col("point_id").alias("bid"), "lon", "lat"), 150.0
    )
    regions = table(spark, d, "training_regions")
    boxes = regions.select(
        F.struct("id", "years").alias("bid"),
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_lo", "y_lo", "x_hi", "y_hi"))]
    )
    held = proximity.locate_in_boxes(
        sightings.where("lat BETWEEN -90 AND 90").select(
            F.struct("sighting_id", "year").alias("pid"), F.col("lon").alias("x"), F.col("lat").alias("y")
        ),
        boxes
    )
    held = held.where(F.array_contains("bid.years", F.col("pid.year"))).select(
        F.col("pid.sighting_id").alias("pid"), F.col("bid.id").alias("bid")
    ).distinct()
    tagged = lambda df, rel: df.select(
        F.lit(rel).alias("rel"), F.col("pid").alias("sighting_id"), F.col("bid").alias("other_id")
    )
    return tagged(near, "near").unionByName(tagged(held, "in"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_faults, p2_spikes, p3_found, p3_plan, p3_compacted, p5_found, p5_states, p6_found, p6_grid,
        p6_counters, p7_found
    )
}

_NDVI = "NDVI IS NOT NULL AND NOT isnan(NDVI) AND scl_purity = 1"

_GRID = f"""
WITH r AS (SELECT DISTINCT point_id, obs_id, year(date)::INT AS year, ((dayofyear(date) - 1) // 16)::INT AS period, dayofyear(date) AS doy
           FROM observations WHERE {_NDVI} AND NDVI BETWEEN -1 AND 1),
     c AS (SELECT point_id, year, period, count(*)::DOUBLE AS n_readings, count(DISTINCT doy)::DOUBLE AS covered FROM r GROUP BY ALL),
     e AS (SELECT point_id, year, min(period) AS lo, max(period) AS hi FROM c GROUP BY ALL),
     g AS (SELECT point_id, year, unnest(range(lo, hi + 1))::INT AS period FROM e)
"""

_JUDGED = """
WITH o AS (SELECT DISTINCT ON (obs_id) * FROM observations),
     j AS (SELECT 'observations' AS tab, obs_id AS rec_id, 'NDVI' AS field, point_id AS src, date::VARCHAR AS tm, NDVI::DOUBLE AS v FROM o WHERE scl_purity = 1
           UNION ALL SELECT 'observations', obs_id, 'vh', point_id, date::VARCHAR, vh::DOUBLE FROM o
           UNION ALL SELECT 'observations', obs_id, 'vv', point_id, date::VARCHAR, vv::DOUBLE FROM o
           UNION ALL SELECT 'year_summaries', summary_id, 'vhvv_dry', bbox_id, lpad(year::VARCHAR, 5, '0'), vhvv_dry FROM (SELECT DISTINCT ON (summary_id) * FROM year_summaries)),
     k AS (SELECT *, CASE field WHEN 'NDVI' THEN v NOT BETWEEN -1 AND 1 WHEN 'vhvv_dry' THEN v NOT BETWEEN -40 AND 0 ELSE v <= 0 END AS wrong,
                  row_number() OVER (PARTITION BY field, src ORDER BY tm, rec_id) - row_number() OVER (PARTITION BY field, src, v ORDER BY tm, rec_id) AS isle
           FROM j WHERE v IS NOT NULL AND NOT isnan(v)),
     l AS (SELECT *, count(*) OVER (PARTITION BY field, src, v, isle) >= 5 AS stuck,
                  CASE WHEN field IN ('vh', 'vv') THEN CASE WHEN v > 0 THEN 10 * log10(v) END ELSE v END AS x FROM k),
     m AS (SELECT field, src, median(x) AS mid FROM l WHERE NOT wrong AND NOT stuck GROUP BY ALL),
     u AS (SELECT field, src, any_value(mid) AS mid, 1.4826 * median(abs(x - mid)) AS usual FROM l JOIN m USING (field, src) WHERE NOT wrong AND NOT stuck GROUP BY ALL)
"""

_FILES = """
WITH f AS (SELECT file_id, max(size_bytes) AS size_bytes, any_value(upper(regexp_extract(path, '([0-9]{1,2}[A-Za-z]{3})_r([0-9]+)_c([0-9]+)', 1))) AS t,
                  any_value(regexp_extract(path, '[/\\\\]([0-9]{4})[/\\\\]', 1)::INT) AS y, any_value(regexp_extract(path, '_r([0-9]+)_c([0-9]+)', 1)::INT) AS r, any_value(regexp_extract(path, '_r([0-9]+)_c([0-9]+)', 2)::INT) AS c FROM chunk_reports GROUP BY file_id),
     k AS (SELECT t, y, r, c, point_id, date, source, min(file_id) AS file_id FROM f JOIN chunk_rows USING (file_id) GROUP BY ALL)
"""

SQL = {
    "p2_found": _JUDGED
    + "SELECT tab, rec_id, field FROM l LEFT JOIN u USING (field, src) WHERE wrong OR stuck OR abs(x - mid) > 8 * usual",
    "p2_faults": _JUDGED
    + "SELECT tab, rec_id, field, CASE WHEN wrong THEN 'impossible' WHEN stuck THEN 'stuck' ELSE 'spike' END AS "
    "fault, CASE WHEN NOT wrong AND NOT stuck THEN round(abs(x - mid) / usual, 6) END AS deviations FROM l LEFT JOIN "
    "u USING (field, src) WHERE wrong OR stuck OR abs(x - mid) > 8 * usual",
    "p3_found": _FILES + "SELECT file_id FROM f WHERE file_id NOT IN (SELECT file_id FROM k)",
    "p3_plan": _FILES + """, r AS (SELECT t, y, r, c, count(*) AS n_records FROM k GROUP BY ALL), n AS (SELECT t, y, r, c, count(*) AS n_files, count(*) FILTER (size_bytes < 134217728) AS n_small FROM f GROUP BY ALL)
SELECT t AS tile, y AS year, r AS chunk_row, c AS chunk_col, n_files, n_small, coalesce(n_records, 0) AS n_records, n_small >= 2 AS rewrite, CASE WHEN n_small >= 2 THEN ceil(coalesce(n_records, 0) / 5000000)::BIGINT ELSE n_files END AS n_out FROM n LEFT JOIN r USING (t, y, r, c)""",
    "p3_compacted": _FILES
    + "SELECT t AS tile, y AS year, r AS chunk_row, c AS chunk_col, count(*) AS n_records, count(DISTINCT point_id) "
    "AS n_points, 1 AS n_files FROM k GROUP BY ALL",
    "p6_found": _GRID + "SELECT point_id, year, period FROM g ANTI JOIN c USING (point_id, year, period)",
    "p6_grid": _GRID
    + "SELECT point_id, year, period, n_readings, coalesce(covered, 0.0) AS covered, covered IS NULL AS missing FROM "
    "g LEFT JOIN c USING (point_id, year, period)",
    "p6_counters": f"""
WITH u AS (SELECT DISTINCT ON (obs_id) point_id, date FROM observations WHERE {_NDVI} AND NDVI BETWEEN -1 AND 1),
     c AS (SELECT point_id, date_diff('day', DATE '1970-01-01', date) AS t, sum(count(*)) OVER (PARTITION BY point_id, year(date) ORDER BY date)::DOUBLE AS v FROM u GROUP BY point_id, date),
     l AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY point_id ORDER BY t)),
     s AS (SELECT point_id, t, greatest(t - 32, coalesce(pt, t - 32)) AS lo, CASE WHEN pv IS NULL OR v < pv THEN v ELSE v - pv END AS gain FROM l),
     k AS (SELECT *, unnest(range(floor(lo / 16)::BIGINT, ceil(t / 16)::BIGINT)) AS cell FROM s WHERE lo < t),
     g AS (SELECT point_id, cell, sum(gain * (least(t, (cell + 1) * 16) - greatest(lo, cell * 16)) / (t - lo)) AS increment, sum(least(t, (cell + 1) * 16) - greatest(lo, cell * 16))::DOUBLE AS covered FROM k GROUP BY ALL),
     f AS (SELECT point_id, unnest(range(min(cell), max(cell) + 1)) AS cell FROM g GROUP BY point_id)
SELECT point_id, cell, round(increment + 1e-9, 6) AS increment, coalesce(covered, 0) AS covered, covered IS NULL AS missing FROM f LEFT JOIN g USING (point_id, cell)""",
    "p7_found": """
WITH s AS (SELECT DISTINCT ON (sighting_id) * FROM sightings ORDER BY sighting_id, loaded_at DESC), p AS (SELECT DISTINCT ON (point_id) * FROM science_points)
SELECT 'near' AS rel, sighting_id, point_id AS other_id FROM s JOIN p ON s.lat BETWEEN -90 AND 90 AND p.lat BETWEEN -90 AND 90 AND abs(s.lat - p.lat) < 0.01
  AND 2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(p.lat - s.lat) / 2) ** 2 + cos(radians(s.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - s.lon) / 2) ** 2))) <= 150
UNION ALL
SELECT DISTINCT 'in', sighting_id, id FROM s JOIN training_regions t ON lon BETWEEN bbox[1] AND bbox[3] AND lat BETWEEN bbox[2] AND bbox[4] AND lat BETWEEN -90 AND 90 AND list_contains(years, year)""",
}
