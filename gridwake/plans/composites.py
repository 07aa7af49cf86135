"""The questions a user asks, composed from the operators, and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.functions import geodesy, ids, indices
from gridwake.operators import checks
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.operators import windows as wi
from gridwake.plans.base import BANDS, BOX, GOOD, obs, regions, with_obs
from gridwake.plans.evaluations import DQ, _EVALUATED, _FEATURES, _HARM, _VECTOR, _VECTOR_SQL, _WIDE_FACTORS, _evaluation_sql, _signal_sql, dq_sql, evaluate, ml_15, signal_windows
from gridwake.plans.registry import Registry
from gridwake.plans.scans import _POINTS, COVER_SQL, COVERED, EXEMPT, covered_name, points, scratch
from gridwake.plans.statistics import IS_RADAR, OPTICAL, RADAR, _CHUNK_SQL, _REGION_QA, annual_summaries, chunk_quality, rounded, summary_sql, _SEEN, _SERIES_SQL, _YEARS, reduced, series
from gridwake.session import Scratch
from gridwake.sources import readers
from gridwake.streaming import ingest

R = Registry()
r6 = lambda c, name: F.round(c, 6).alias(name)
_IN_BOX = f"lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}"


@R.add(
    "qry_01",
    with_obs(_POINTS)
    + "SELECT o.obs_id, o.date, o.source, round(i_ndvi, 6) AS ndvi, round(vh_db, 6) AS vh FROM obs o JOIN (SELECT "
    "point_id FROM pts ORDER BY (lon - 141.0) ** 2 + (lat + 17.0) ** 2, point_id LIMIT 1) USING (point_id)"
)
def qry_01(spark, d):
    """The history of the point nearest to a place."""
    return readers.at_nearest(obs(spark, d), points(spark, d), 141.0, -17.0).select(
        "obs_id", "date", "source", r6("i_ndvi", "ndvi"), r6("vh_db", "vh")
    )


@R.add("qry_02", with_obs() + f"SELECT obs_id, point_id, date, source FROM obs WHERE {_IN_BOX}")
def qry_02(spark, d):
    return ob.in_box(obs(spark, d), BOX).select("obs_id", "point_id", "date", "source")


@R.add("qry_03", with_obs() + f"SELECT date, {_SERIES_SQL} FROM obs WHERE {_SEEN} AND {_IN_BOX} GROUP BY date")
def qry_03(spark, d):
    """The flagship: index and radar series of a box."""
    return series(ob.in_box(obs(spark, d), BOX)).orderBy("date")


@R.add(
    "qry_03_json",
    with_obs(f"s AS (SELECT date, {_SERIES_SQL} FROM obs WHERE {_SEEN} AND {_IN_BOX} GROUP BY date)")
    + "SELECT year(date)::INT AS year, count(*) AS n_dates, count(ndvi) AS n_optical, round(sum(ndvi), 4) AS ndvi, "
    "round(sum(vh_vv), 4) AS vh_vv, min(date)::VARCHAR AS first FROM s GROUP BY ALL"
)
def qry_03_json(spark, d):
    """The series of a box as JSON, one document a year as a viewer asks for it, and what stands in it when read again."""
    s = series(ob.in_box(obs(spark, d), BOX)).withColumn("year", F.year("date"))
    kinds = T.ArrayType(T.StructType([f for f in s.schema.fields if f.name != "year"]))
    # At most 366 dates a year.
    texts = s.groupBy("year").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in s.columns if c != "year"])))).alias("series")
    )
    path = scratch(spark, "qry_03_json")
    texts.write.json(path)
    back = spark.read.schema("year int, series string").json(path).withColumn(
        "e", F.explode(F.from_json("series", kinds))
    ).select("year", "e.*")
    return back.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count("ndvi").alias("n_optical"), F.round(F.sum("ndvi"), 4).alias("ndvi"),
        F.round(F.sum("vh_vv"), 4).alias("vh_vv"), F.min("date").cast("string").alias("first")
    )


@R.add(
    "qry_04",
    with_obs(
        "cv AS (SELECT tile_id, year, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM obs WHERE "
        "tile_id IS NOT NULL GROUP BY ALL)"
    )
    + f"SELECT tile_id, year FROM cv WHERE w <= {BOX[2]} AND e >= {BOX[0]} AND s <= {BOX[3]} AND n >= {BOX[1]}"
)
def qry_04(spark, d):
    manifest = readers.coverage(obs(spark, d).where("tile_id IS NOT NULL"), ["tile_id", "year"])
    return manifest.where(
        geodesy.overlaps(tuple(F.col(c) for c in ("west", "south", "east", "north")), tuple(F.lit(x) for x in BOX))
    ).select("tile_id", "year")


_BEST = "SELECT * FROM obs WHERE source = 'S2' QUALIFY row_number() OVER (PARTITION BY point_id, date ORDER BY scl_purity DESC NULLS LAST, item_id ASC NULLS LAST, obs_id, loaded_at) = 1"


@R.add(
    "qry_05",
    with_obs("b AS (" + _BEST + ")")
    + f"SELECT obs_id, 't_' || point_id AS point_id, date FROM b WHERE {_IN_BOX} AND B02 IS NOT NULL AND B03 IS NOT "
    f"NULL AND B04 IS NOT NULL AND B05 IS NOT NULL AND B06 IS NOT NULL AND B07 IS NOT NULL AND B08 IS NOT NULL AND "
    f"B8A IS NOT NULL AND B11 IS NOT NULL AND B12 IS NOT NULL"
)
def qry_05(spark, d):
    """The training table of a box: one clear row per point and day, all bands there, ids marked."""
    best = ob.best_per_day(ob.in_box(obs(spark, d), BOX)).where("source = 'S2'")
    return ob.with_all_bands(best).select("obs_id", F.concat(F.lit("t_"), "point_id").alias("point_id"), "date")


_SITE = "regexp_replace(CASE WHEN regexp_matches(point_id, '_(presence|absence)') THEN regexp_extract(point_id, '^(.+?)_(presence|absence)', 1) ELSE point_id END, '_val$', '')"
_TRAINING = (
    _POINTS,
    "bx AS (SELECT point_id, max_by(t.label, id) AS label, max(list_min(years)) AS lo, min(list_max(years)) AS hi "
    "FROM pts JOIN training_regions t ON lon BETWEEN bbox[1] AND bbox[3] AND lat BETWEEN bbox[2] AND bbox[4] GROUP BY 1)",
    "lp AS (SELECT point_id, lon, lat, bx.label FROM pts JOIN bx USING (point_id) WHERE bx.label IS NOT NULL)",
    "sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY lat, point_id) <= greatest(1, "
    "floor(count(*) OVER (PARTITION BY label) * 0.2)) THEN 'validation' ELSE 'train' END AS split FROM lp)",
    f"ex AS (SELECT *, split = 'validation' OR {_SITE} IN ('luninya_spur', 'quoribo_bend') AS exempt FROM sp)",
    "th AS (SELECT point_id, label, split FROM ex WHERE exempt UNION ALL SELECT point_id, label, split FROM (SELECT "
    "*, row_number() OVER (ORDER BY lat, lon, point_id) AS n FROM ex WHERE NOT exempt) WHERE (n - 1) % 2 = 0)",
    "pd AS (SELECT obs.* EXCLUDE (label), th.label AS label, th.split FROM obs JOIN th USING (point_id) JOIN bx "
    "USING (point_id) WHERE year BETWEEN lo AND hi AND NOT (source = 'S2' AND coalesce(scl = 6, false)))",
    "wn AS (SELECT point_id, year, label, split, count(*) FILTER (source = 'S2') AS n2, count(*) FILTER (source = "
    "'S1') AS n1, avg(vh_db) FILTER (source = 'S1' AND doy BETWEEN 121 AND 304) AS vh_dry, avg(i_ndvi) FILTER "
    "(source = 'S2' AND scl IN (4, 5) AND doy BETWEEN 121 AND 304) AS ndvi_dry FROM pd GROUP BY ALL)",
    "kp AS (SELECT point_id, year, label, split FROM wn WHERE n2 >= 10 AND n1 >= 4 AND NOT (label = 'presence' AND "
    "coalesce(vh_dry < -16 AND NOT coalesce(vh_dry >= -17 AND ndvi_dry >= 0.3, false), false)))",
    f"ft AS (SELECT point_id, year, {summary_sql({k: OPTICAL[k] for k in ('ndvi', 'B08')}, GOOD)}, "
    f"{summary_sql({'s1_vh': RADAR['s1_vh']}, IS_RADAR)} FROM pd GROUP BY point_id, year HAVING count(*) FILTER "
    f"({GOOD}) > 0)",
)
_SHOWN = [f"{n}_{end}" for n in ("ndvi", "B08", "s1_vh") for end in ("p5", "p95", "std")]


@R.add(
    "qry_06",
    with_obs(*_TRAINING)
    + f"SELECT point_id, year, label, split, {', '.join(_SHOWN)} FROM kp LEFT JOIN ft USING (point_id, year)"
)
def qry_06(spark, d):
    """The labelled training table with its features, split for validation.

    Points get the label of the last region whose box holds them; rows outside the region's years and water are left out; the
    southernmost fifth of each label validates; every second of the other points stays (all of exempt sites); windows need
    ten optical and four radar readings; and presence windows that are dark and not green in the dry season go.
    """
    from gridwake.operators.evaluation import southern_split

    scratch_ = Scratch(spark, "training")
    df = obs(spark, d).drop("label")
    # One row per point, written once: everything that follows asks for it several times.
    places = scratch_.cut(points(spark, d))
    found = places.join(ob.place_in_regions(places, regions(spark, d)).where("label IS NOT NULL"), "point_id")
    splits = scratch_.cut(southern_split(found, 0.2))
    exempt = ids.site(F.col("point_id")).isin(*EXEMPT)
    train = ob.every_nth_point(splits.where("split = 'train'"), 2, exempt=exempt).select("point_id")
    chosen = splits.where("split = 'validation'").select("point_id").unionByName(train)
    kept = splits.select("point_id", "label", "split", "first_year", "last_year").join(chosen, "point_id", "left_semi")
    rows = ob.without_water(df.join(kept, "point_id").where("year BETWEEN first_year AND last_year"))
    used = ["vh_db", "vv_db", "vh_vv", "rvi", "scl", "scl_purity", "doy", *(f"i_{n.lower()}" for n in indices.INDICES)]
    rows = scratch_.cut(rows.select(*wi.WINDOW, "label", "split", "source", *used, *BANDS))
    dry = wi.flags_dry(F.col("doy"))
    window = rows.groupBy(*wi.WINDOW, "label", "split").agg(
        F.count_if(F.col("source") == "S2").alias("n2"),
        F.count_if(F.col("source") == "S1").alias("n1"),
        F.avg(F.when(dry & (F.col("source") == "S1"), F.col("vh_db"))).alias("vh_dry"),
        F.avg(F.when(dry & (F.col("source") == "S2") & F.col("scl").isin(4, 5), F.col("i_ndvi"))).alias("ndvi_dry"),
    )
    window = wi.presence_filter(window.where("n2 >= 10 AND n1 >= 4"), -16.0, -17.0, 0.3)
    summaries = rounded(annual_summaries(rows, ("ndvi", "B08", "s1_vh")), wi.WINDOW).select(*wi.WINDOW, *_SHOWN)
    return window.select(*wi.WINDOW, "label", "split").join(summaries, wi.WINDOW, "left")


_STANDARD = {"ndvi_p5": 0.8, "ndvi_p95": 0.6, "mavi_std": -0.4, "s1_vh_p5": 0.5}
_SCORED = (
    "en AS (SELECT point_id, year FROM obs GROUP BY ALL HAVING count(*) FILTER (source = 'S2') >= 10 AND count(*) "
    "FILTER (source = 'S1') >= 4)",
    "fk AS (SELECT * FROM fe SEMI JOIN en USING (point_id, year))",
    "ms AS (SELECT "
    + ", ".join(f"avg({n}) AS m_{n}, greatest(coalesce(stddev_samp({n}), 1), 1e-6) AS s_{n}" for n in _STANDARD)
    + " FROM fk)",
    "yr AS (SELECT point_id, year, 1 / (1 + exp(-("
    + " + ".join(f"{w} * (({n} - m_{n}) / s_{n})" for n, w in _STANDARD.items()) + " - 0.1))) AS p FROM fk, ms)",
    "fs AS (SELECT point_id, round(sum(exp(-0.3 * (2022 - year)) * p) / sum(exp(-0.3 * (2022 - year))), 6) AS score "
    "FROM yr GROUP BY 1)",
)


def final_scores(spark, d):
    """The points' final scores: windows with enough readings, standardised features, the scorer, and the years' decaying mean."""
    df = obs(spark, d)
    enough = df.groupBy(*wi.WINDOW).agg(
        F.count_if(F.col("source") == "S2").alias("n2"), F.count_if(F.col("source") == "S1").alias("n1")
    ).where("n2 >= 10 AND n1 >= 4").select(*wi.WINDOW)
    kept = annual_summaries(df, ("ndvi", "mavi", "s1_vh")).select(*wi.WINDOW, *_STANDARD).join(
        enough, wi.WINDOW, "left_semi"
    )
    kept = Scratch(spark, "scores").cut(kept)  # one row per window, used for the scale and for the scores
    stats = kept.agg(
        *[
            x for n in _STANDARD
            for x in (
                F.avg(n).alias(f"m_{n}"),
                F.greatest(F.coalesce(F.stddev_samp(n), F.lit(1.0)), F.lit(1e-6)).alias(f"s_{n}")
            )
        ]
    ).first()  # one row
    known = lambda v, other: F.lit(other if v is None else v)
    standard = kept.select(
        *wi.WINDOW,
        *[((F.col(n) - known(stats[f"m_{n}"], 0.0)) / known(stats[f"s_{n}"], 1.0)).alias(n) for n in _STANDARD]
    )
    yearly = standard.select(*wi.WINDOW, scoring.linear_scorer(_STANDARD, -0.1).alias("score"))
    return scoring.over_years(yearly, 2022, 0.3).select("point_id", r6("score", "score"))


@R.add(
    "qry_07",
    with_obs(_FEATURES, *_SCORED, _POINTS)
    + "SELECT point_id, lon, lat, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, point_id)::INT "
    "AS rank FROM pts JOIN fs USING (point_id)"
)
def qry_07(spark, d):
    """A location scored and ranked, as a CSV file of four decimals in the order of the rank."""
    places = points(spark, d)
    ranked = scoring.ranking(
        places, final_scores(spark, d), places.select("point_id", F.lit(None).cast("string").alias("label"))
    )
    path = scratch(spark, "qry_07")
    ranked.where("score IS NOT NULL").select(
        "point_id", "lon", "lat", F.round("score", 4).alias("score"), "rank"
    ).repartitionByRange("rank").sortWithinPartitions("rank").write.option("header", True).csv(path)
    return readers.csv(spark, path, "point_id string, lon double, lat double, score double, rank int")


_BY_TILE = "bt AS (SELECT point_id, arg_max(tile_id, struct_pack(n := n, t := tile_id)) AS tile_id FROM (SELECT point_id, tile_id, count(*) AS n FROM obs WHERE tile_id IS NOT NULL GROUP BY ALL) GROUP BY 1)"


@R.add(
    "qry_08",
    with_obs(_FEATURES, *_SCORED, _BY_TILE)
    + "SELECT tile_id, point_id, round_even(score * 100, 0)::INT AS prob FROM fs JOIN bt USING (point_id)"
)
def qry_08(spark, d):
    """Scores written as one table a tile, in whole percent; a point goes to the tile that saw it most."""
    seen = obs(spark, d).where("tile_id IS NOT NULL").groupBy("point_id", "tile_id").agg(F.count(F.lit(1)).alias("n"))
    tiles = seen.groupBy("point_id").agg(F.max_by("tile_id", F.struct("n", "tile_id")).alias("tile_id"))
    scores = final_scores(spark, d).join(tiles, "point_id").select(
        "point_id", indices.percent(F.col("score")).alias("prob"), "tile_id"
    )
    path = scratch(spark, "qry_08")
    scores.repartition("tile_id").sortWithinPartitions("tile_id", "point_id").write.partitionBy("tile_id").parquet(path)
    return spark.read.schema(
        "point_id string, prob int, tile_id string"
    ).parquet(path).select("tile_id", "point_id", "prob")


@R.add(
    "qry_08_grid",
    with_obs(_FEATURES, *_SCORED)
    + "SELECT (split_part(point_id, '_', -1)::INT // 16)::INT AS row, (split_part(point_id, '_', -2)::INT // "
    "16)::INT AS col, max(round_even(score * 100, 0)::INT) AS value FROM fs GROUP BY ALL"
)
def qry_08_grid(spark, d):
    """The scores on a grid, the highest of each cell."""
    scores = final_scores(spark, d).withColumn("score", indices.percent(F.col("score")))
    return scoring.to_grid(
        scores, F.floor(ids.northing(F.col("point_id")) / 16).cast("int"),
        F.floor(ids.easting(F.col("point_id")) / 16).cast("int")
    )


@R.add(
    "qry_09",
    with_obs(*_signal_sql(), *_evaluation_sql(["signal", "site"])) + f"SELECT signal, site, {_EVALUATED} FROM jn"
)
def qry_09(spark, d):
    """All signals evaluated site by site, from one aggregation of the observations."""
    return evaluate(signal_windows(spark, d), ["signal", "site"])


@R.add(
    "qry_10",
    with_obs(_HARM, _WIDE_FACTORS) + "SELECT o.tile_id, o.year, count(*) AS n, "
    + ", ".join(f"round(avg({b} * coalesce(f_{b}, 1)), 4) AS {b}" for b in BANDS)
    + " FROM obs o LEFT JOIN wd USING (tile_id, year) WHERE o.tile_id IS NOT NULL GROUP BY ALL"
)
def qry_10(spark, d):
    """Tiles harmonised: mean of each band per tile and year after the corrections."""
    df = obs(spark, d)
    fitted = scoring.apply_corrections(df, scoring.harmonise(df, BANDS), BANDS)
    return fitted.where("tile_id IS NOT NULL").groupBy("tile_id", "year").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(b), 4).alias(b) for b in BANDS]
    )


_CHUNK_VERDICT = "CASE WHEN n_points = 0 THEN 'EMPTY' WHEN n_dates = 0 THEN 'S1_MISS' WHEN n_complete < 0.95 * n_dates THEN CASE WHEN 100 * n_enough / n_points >= 90 AND cover_median < 0.5 * n_rows THEN 'S1_TRUNC_OK' ELSE 'S1_INCOMPLETE' END ELSE 'OK' END"
_REPORT = (
    "rp AS (SELECT 'schema' AS check_name, 'PASS' AS status, 0.0::DOUBLE AS measure UNION ALL "
    + " UNION ALL ".join(dq_sql(*c) for c in DQ)
    + f" UNION ALL SELECT 'chunks', CASE WHEN count(*) FILTER (v NOT IN ('OK', 'S1_TRUNC_OK')) > 0 THEN 'WARN' ELSE "
    f"'PASS' END, count(*) FILTER (v NOT IN ('OK', 'S1_TRUNC_OK'))::DOUBLE FROM (SELECT {_CHUNK_VERDICT} AS v FROM al)"
    + " UNION ALL SELECT 'regions', CASE WHEN count(*) FILTER (n_obs IS NULL OR n_dup > 0 OR n_points < 5 OR obs_min "
    "< 4 OR n_null > 0 OR top > 12000 OR bottom < 0 OR vh_median IS NULL OR vh_median > 1) > 0 THEN 'WARN' ELSE "
    "'PASS' END, count(*) FILTER (n_obs IS NULL OR n_dup > 0 OR n_points < 5 OR obs_min < 4 OR n_null > 0 OR top > "
    "12000 OR bottom < 0 OR vh_median IS NULL OR vh_median > 1)::DOUBLE FROM qa)"
)


@R.add(
    "qry_11",
    with_obs(*_REGION_QA, _CHUNK_SQL, _REPORT)
    + "SELECT * FROM rp UNION ALL SELECT 'overall', CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN "
    "count(*) FILTER (status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END, NULL FROM rp",
    repeated=True
)
def qry_11(spark, d):
    """The table validated as delivered: schema first, then the checks of its rows, of the chunk files and of the regions."""
    df = obs(spark, d, repeated=True)
    kept = [f for f in ob.SCHEMA if f.name not in ("lon", "lat", "vh", "vv")]  # these are doubles after preparation
    rows = checks.report(df, BOX, 1000, wanted=T.StructType(kept))
    count = lambda name, bad, of: of.agg(F.count_if(bad).cast("double").alias("measure")).select(
        F.lit(name).alias("check_name"), F.when(F.col("measure") > 0, "WARN").otherwise("PASS").alias("status"),
        "measure"
    )
    chunks = count("chunks", ~F.col("verdict").isin("OK", "S1_TRUNC_OK"), chunk_quality(spark, d))
    regions_ = count("regions", F.col("tags") != "", checks.region_tags(df))
    return checks.verdicts(rows.unionByName(chunks).unionByName(regions_))


@R.add(
    "qry_12",
    with_obs("h AS (SELECT point_id, avg(vh_db) FILTER (doy BETWEEN 121 AND 304) AS v FROM obs GROUP BY 1)", _POINTS)
    + "SELECT point_id, lon, lat, CASE WHEN v >= -16 THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0.0::DOUBLE END AS "
    "score FROM pts JOIN h USING (point_id)"
)
def qry_12(spark, d):
    return points(spark, d).join(
        scoring.dry_heuristic(obs(spark, d), -16.0), "point_id"
    ).select("point_id", "lon", "lat", "score")


@R.add(
    "qry_13",
    _VECTOR
    + "SELECT point_id, CASE WHEN contains(point_id, '_presence') THEN 1 WHEN contains(point_id, '_absence') THEN 0 "
    "END AS label, "
    + _VECTOR_SQL + " FROM wv JOIN st USING (point_id) JOIN mq USING (point_id)"
)
def qry_13(spark, d):
    """Flowering features of points with their labels: from readings to the vector a classifier takes."""
    label = F.when(F.col("point_id").contains("_presence"), 1).when(F.col("point_id").contains("_absence"), 0)
    return ml_15(spark, d).withColumn("label", label)


# What each cover type is expected to show (low, high): wet peak, dry floor, difference, dry radar ratio.
EXPECTED = {
    "presence": ((0.75, 0.90), (0.20, 0.35), (0.50, 9.9), (-6.0, -3.0)),
    "mangrove": ((0.85, 0.97), (0.60, 0.97), (0.0, 0.30), (-6.0, -3.0)),
    "bare": ((0.45, 0.80), (0.08, 0.20), (0.40, 9.9), (-9.9, -6.5)),
    "riparian": ((0.65, 0.90), (0.25, 0.55), (0.25, 0.55), (-6.0, -3.0)),
}
_MEASURES = ("wet_peak", "dry_floor", "delta", "vhvv_dry")


def verdict(cover, years):
    """``none`` without data, ``fail`` outside a range, ``flag`` within a tenth of its ends or with a wide spread, else ``pass``."""
    fail, flag = F.lit(False), F.coalesce(F.col("iqr_max") > 0.12, F.lit(False))
    for kind, ranges in EXPECTED.items():
        for name, (low, high) in zip(_MEASURES, ranges):
            x, mine = F.col(name), cover == kind
            inside = x.between(low, high)
            edge = inside & (((x - low) / (high - low) < 0.1) | ((high - x) / (high - low) < 0.1))
            fail |= F.coalesce(mine & ~inside, F.lit(False))
            flag |= F.coalesce(mine & edge, F.lit(False))
    wet_surface = cover == "water"
    dry, wet = F.coalesce(F.col("dry_floor") >= 0.1, F.lit(False)), F.col("wet_peak")
    water = F.when(wet.isNull(), "none").when((wet >= 0.1) | dry, "fail").when(wet >= 0, "flag").otherwise("pass")
    land = F.when(
        wet.isNull() & F.col("dry_floor").isNull(), "none"
    ).when(fail, "fail").when(flag, "flag").otherwise("pass")
    return years.withColumn("verdict", F.when(wet_surface, water).otherwise(land))


def _verdict_sql() -> str:
    fails, flags = [], ["coalesce(iqr_max > 0.12, false)"]
    for kind, ranges in EXPECTED.items():
        for name, (low, high) in zip(_MEASURES, ranges):
            fails.append(f"(cover = '{kind}' AND coalesce({name} NOT BETWEEN {low} AND {high}, false))")
            flags.append(
                f"(cover = '{kind}' AND coalesce({name} BETWEEN {low} AND {high} AND (({name} - {low}) / ({high} - "
                f"{low}) < 0.1 OR ({high} - {name}) / ({high} - {low}) < 0.1), false))"
            )
    water = "CASE WHEN wet_peak IS NULL THEN 'none' WHEN wet_peak >= 0.1 OR coalesce(dry_floor >= 0.1, false) THEN 'fail' WHEN wet_peak >= 0 THEN 'flag' ELSE 'pass' END"
    return f"CASE WHEN cover = 'water' THEN {water} WHEN wet_peak IS NULL AND dry_floor IS NULL THEN 'none' WHEN {' OR '.join(fails)} THEN 'fail' WHEN {' OR '.join(flags)} THEN 'flag' ELSE 'pass' END"


_AUDIT = with_obs(
    _YEARS,
    f"yd AS (SELECT *, {COVER_SQL} AS cover FROM (SELECT *, round(wet_peak - dry_floor, 6) AS delta, {COVERED} AS "
    f"name FROM ys))"
)


def audited(spark, d):
    """Verdicts per region and year; regions are named after all cover types in turn, so that every range is met."""
    years = reduced(obs(spark, d)).withColumn("delta", F.round(F.col("wet_peak") - F.col("dry_floor"), 6))
    return verdict(ids.cover_type(covered_name(F.col("region_id"))), years)


R.add(
    "fn_26", _AUDIT + f"SELECT region_id, year, {_verdict_sql()} AS verdict FROM yd"
)(lambda spark, d: audited(spark, d).select("region_id", "year", "verdict"))
R.add(
    "dq_16",
    _AUDIT
    + f"SELECT region_id, count(*) AS n_years, count(*) FILTER (v = 'fail') AS n_fail, count(*) FILTER (v = 'flag') "
    f"AS n_flag, count(*) FILTER (v = 'pass') AS n_pass FROM (SELECT region_id, {_verdict_sql()} AS v FROM yd) GROUP BY 1"
)(
    lambda spark, d: audited(spark, d).groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_years"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("fail", "flag", "pass")]
    )
)


# ---- streaming ----------------------------------------------------------------------------------------------------------


@R.add("stream_01", "SELECT obs_id FROM (SELECT DISTINCT obs_id FROM observations)")
def stream_01(spark, d):
    """Observations arriving as a stream, each delivered once into a table."""
    return ingest.deliver_once(spark, d, scratch(spark, "stream_01")).select("obs_id")


@R.add(
    "stream_02", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"
)
def stream_02(spark, d):
    """Hourly counts of events by event time, late ones included."""
    return ingest.hourly_counts(spark, d, scratch(spark, "stream_02"))


QUERIES, SQL = R.queries, R.sql
