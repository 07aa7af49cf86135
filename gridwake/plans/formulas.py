"""Scalar functions and spatial arithmetic as queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridwake.functions import geodesy, ids, indices
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.plans.base import BANDS, BOX, GOOD, obs, with_obs, table
from gridwake.plans.registry import Registry

R = Registry()
r6 = lambda c, name: F.round(c, 6).alias(name)

# ---- spectral and radar -------------------------------------------------------------------------------------------

for _n, _c in (
    ("fn_01", "i_ndvi"), ("fn_02", "i_ndwi"), ("fn_03", "i_evi"), ("fn_04", "i_mavi"), ("fn_05", "i_ndre"),
    ("fn_06", "i_ci_re"), ("fn_07", "i_ndsvi"), ("fn_08", "i_b12_b11"), ("fn_12", "vh_db"), ("fn_13", "vh_vv"),
    ("fn_14", "rvi")
):
    R.add(_n, with_obs() + f"SELECT obs_id, round({_c}, 9) AS v FROM obs")(
        lambda spark, d, c=_c: obs(spark, d).select("obs_id", F.round(c, 9).alias("v"))
    )


@R.add(
    "fn_09",
    with_obs() + "SELECT obs_id, " + ", ".join(f"{b} / 10000.0::DOUBLE AS {b}" for b in BANDS if b != "B06")
    + f" FROM obs WHERE {GOOD}"
)
def fn_09(spark, d):
    return ob.optical(obs(spark, d)).select("obs_id", *[indices.reflectance(b).alias(b) for b in BANDS if b != "B06"])


@R.add("fn_10", with_obs() + f"SELECT point_id, round(stddev_pop(i_ndvi), 6) AS sigma FROM obs WHERE {GOOD} GROUP BY 1")
def fn_10(spark, d):
    return ob.optical(obs(spark, d)).groupBy("point_id").agg(r6(F.stddev_pop("i_ndvi"), "sigma"))


_Z = {b: f"coalesce({b} / 10000.0::DOUBLE, 0)" for b in BANDS}


@R.add(
    "fn_11",
    with_obs()
    + f"SELECT obs_id, round(least(greatest((({_Z['B07']} - {_Z['B05']}) / ({_Z['B07']} + {_Z['B05']} + 1e-9) + "
    f"({_Z['B08']} - {_Z['B11']}) / ({_Z['B08']} + {_Z['B11']} + 1e-9)) / 2, -1), 1), 6) AS v FROM obs WHERE source = 'S2'"
)
def fn_11(spark, d):
    bands = F.create_map(*[x for b in BANDS for x in (F.lit(b), indices.reflectance(b))])
    return obs(spark, d).where("source = 'S2'").select("obs_id", r6(indices.flowering_index(bands), "v"))


@R.add(
    "fn_15",
    with_obs()
    + "SELECT obs_id, round(scl_purity * (aot / 100.0::DOUBLE) * (view_zenith / 100.0::DOUBLE) * (sun_zenith / "
    "100.0::DOUBLE), 6) AS full_quality, round(aot / 100.0::DOUBLE, 6) AS air, scl_purity::DOUBLE AS cloud FROM obs "
    "WHERE source = 'S2'"
)
def fn_15(spark, d):
    terms = {
        "clear": F.col("scl_purity").cast("double"),
        **{n: F.col(n) / 100.0 for n in ("aot", "view_zenith", "sun_zenith")}
    }
    return obs(spark, d).where("source = 'S2'").select(
        "obs_id", r6(indices.quality(terms), "full_quality"), r6(indices.quality(terms, {"aot"}), "air"),
        indices.quality(terms, {"clear"}).alias("cloud")
    )


@R.add(
    "fn_16",
    with_obs(
        f"a AS (SELECT point_id, avg(i_ndvi) AS m, greatest(stddev_samp(i_ndvi), 1e-6) AS s FROM obs WHERE {GOOD} "
        f"GROUP BY 1)"
    )
    + f"SELECT obs_id, CASE WHEN i_ndvi IS NOT NULL THEN round(1 / (1 + abs((least(greatest(i_ndvi, -1), 1) - m) / "
    f"s)), 6) END AS v FROM obs JOIN a USING (point_id) WHERE {GOOD}"
)
def fn_16(spark, d):
    df = ob.optical(obs(spark, d))
    archive = df.groupBy("point_id").agg(
        F.avg("i_ndvi").alias("m"), F.greatest(F.stddev_samp("i_ndvi"), F.lit(1e-6)).alias("s")
    )
    return df.join(archive, "point_id").select(
        "obs_id", r6(indices.greenness(F.col("i_ndvi"), F.col("m"), F.col("s")), "v")
    )


@R.add(
    "fn_17",
    with_obs()
    + "SELECT obs_id, round(1 - least(aot * 0.001::DOUBLE, 1), 6) AS aot_q, round(greatest(0, 1 - view_zenith / "
    "90.0::DOUBLE), 6) AS zenith_q FROM obs WHERE source = 'S2'"
)
def fn_17(spark, d):
    return obs(spark, d).where("source = 'S2'").select(
        "obs_id", r6(indices.aerosol_quality(F.col("aot")), "aot_q"),
        r6(indices.zenith_quality(F.col("view_zenith")), "zenith_q")
    )


@R.add(
    "fn_18",
    with_obs(
        "g AS (SELECT obs_id, radians(sun_zenith * 0.6) AS s, radians(view_zenith * 0.1) AS v, radians((doy * 7 % "
        "180)::DOUBLE) AS a FROM obs WHERE source = 'S2')"
    )
    + "SELECT obs_id, " + ", ".join(f"round({indices.brdf_sql(b)}, 6) AS c_{b}" for b in BANDS) + " FROM g"
)
def fn_18(spark, d):
    sun, view, azimuth = F.col("sun_zenith") * 0.6, F.col("view_zenith") * 0.1, (F.col("doy") * 7 % 180).cast("double")
    df = indices.with_brdf_kernels(obs(spark, d).where("source = 'S2'"), sun, view, azimuth)
    return df.select("obs_id", *[r6(indices.brdf_from_kernels(b), f"c_{b}") for b in BANDS])


_GRID = "an AS (SELECT i, j, (i * 3 + j * j % 11)::DOUBLE AS angle FROM range(23) a(i), range(23) b(j))"


@R.add("fn_19", with_obs(_GRID, "p AS (SELECT point_id, (easting % 110) / 5.0::DOUBLE AS x, (northing % 110) / 5.0::DOUBLE AS y FROM (SELECT DISTINCT point_id, regexp_extract(point_id, '_([0-9]+)_([0-9]+)$', 1)::INT AS easting, regexp_extract(point_id, '_([0-9]+)_([0-9]+)$', 2)::INT AS northing FROM observations))", "c AS (SELECT *, least(floor(x), 21)::INT AS x0, least(floor(y), 21)::INT AS y0 FROM p)")
       + "SELECT point_id, round(sum(angle * (1 - abs(x - j)) * (1 - abs(y - i))), 6) AS angle FROM c JOIN an ON i IN (y0, y0 + 1) AND j IN (x0, x0 + 1) GROUP BY point_id")
def fn_19(spark, d):
    """Bilinear interpolation in a coarse grid of angles; places outside take the edge's value."""
    axis = F.sequence(F.lit(0), F.lit(22))
    grid = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    grid = grid.withColumn("angle", (F.col("i") * 3 + F.col("j") * F.col("j") % 11).cast("double"))
    p = table(spark, d, "observations").select("point_id").distinct()
    p = p.select(
        "point_id", (ids.easting(F.col("point_id")) % 110 / 5.0).alias("x"),
        (ids.northing(F.col("point_id")) % 110 / 5.0).alias("y")
    )
    x0, y0 = (F.least(F.floor(c), F.lit(21)).cast("int") for c in ("x", "y"))
    corners = p.withColumn("j", F.explode(F.array(x0, x0 + 1))).withColumn("i", F.explode(F.array(y0, y0 + 1)))
    weight = (1 - F.abs(F.col("x") - F.col("j"))) * (1 - F.abs(F.col("y") - F.col("i")))
    return corners.join(grid, ["i", "j"]).groupBy("point_id").agg(r6(F.sum(F.col("angle") * weight), "angle"))


@R.add(
    "fn_20",
    with_obs() + "SELECT DISTINCT doy, "
    + ", ".join(
        f"round(sin(2 * pi() * {k} / 365 * doy), 6) AS s{k}, round(cos(2 * pi() * {k} / 365 * doy), 6) AS c{k}"
        for k in (1, 2)
    )
    + " FROM obs"
)
def fn_20(spark, d):
    columns = []
    for k in (1, 2):
        s, c = indices.doy_encoding(F.col("doy"), k)
        columns += [r6(s, f"s{k}"), r6(c, f"c{k}")]
    return obs(spark, d).select("doy").distinct().select("doy", *columns)


@R.add("fn_21", with_obs() + "SELECT DISTINCT year, round(exp(-0.5 * (2022 - year)), 9) AS weight FROM obs")
def fn_21(spark, d):
    return obs(spark, d).select("year").distinct().select(
        "year", F.round(indices.decay(F.lit(2022) - F.col("year"), 0.5), 9).alias("weight")
    )


_STOPS = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in indices.COLOURS) + "]"


@R.add("fn_22", f"WITH s AS (SELECT score, score / 100.0::DOUBLE * 19 AS t, least(floor(score / 100.0::DOUBLE * 19), 18)::INT AS lo, {_STOPS} AS c FROM (SELECT unnest(range(0, 101))::INT AS score)) SELECT score, "
       + ", ".join(f"CASE WHEN score > 0 THEN round_even(c[lo + 1][{k + 1}] * (1 - (t - lo)) + c[lo + 2][{k + 1}] * (t - lo), 0)::INT ELSE 0 END AS {n}" for k, n in enumerate("rgb")) + ", CASE WHEN score > 0 THEN 255 ELSE 0 END AS a FROM s")
def fn_22(spark, d):
    return spark.range(101).select(F.col("id").cast("int").alias("score")).select(
        "score", indices.colour(F.col("score")).alias("c")
    ).select("score", "c.*")


@R.add(
    "fn_23",
    with_obs()
    + "SELECT obs_id, CASE WHEN vh IS NOT NULL THEN round(least(greatest((vh - 0.002) / (0.040 - 0.002), 0), 1), 6) "
    "END AS vh, CASE WHEN vv IS NOT NULL THEN round(least(greatest((vv - 0.014) / (0.151 - 0.014), 0), 1), 6) END AS "
    "vv FROM obs WHERE source = 'S1'"
)
def fn_23(spark, d):
    return ob.radar(obs(spark, d)).select(
        "obs_id",
        *[
            F.when(F.col(c).isNotNull(), F.round(indices.min_max(F.col(c), lo, hi), 6)).alias(c) for c, lo,
            hi in (("vh", 0.002, 0.040), ("vv", 0.014, 0.151))
        ]
    )


@R.add("fn_24", with_obs() + f"SELECT obs_id, round(1 / (1 + exp(-(i_ndvi * 6 - 2))), 6) AS p FROM obs WHERE {GOOD}")
def fn_24(spark, d):
    return ob.optical(obs(spark, d)).select("obs_id", r6(indices.sigmoid(F.col("i_ndvi") * 6 - 2), "p"))


# ---- strings --------------------------------------------------------------------------------------------------------


@R.add("fn_30", "SELECT obs_id, split_part(point_id, '_', -1) AS v FROM observations")
def fn_30(spark, d):
    return table(spark, d, "observations").select("obs_id", F.element_at(F.split("point_id", "_"), -1).alias("v"))


@R.add("fn_31", "SELECT obs_id, split_part(item_id, '_', 2) AS v FROM observations WHERE item_id IS NOT NULL")
def fn_31(spark, d):
    return table(spark, d, "observations").where("item_id IS NOT NULL").select(
        "obs_id", ids.tile_of_item(F.col("item_id")).alias("v")
    )


@R.add("fn_32", "SELECT file_id, nullif(regexp_extract(path, '_r([0-9]+)_c[0-9]+', 1), '') AS v FROM chunk_reports")
def fn_32(spark, d):
    return table(spark, d, "chunk_reports").select(
        "file_id", F.nullif(F.regexp_extract("path", "_r([0-9]+)_c[0-9]+", 1), F.lit("")).alias("v")
    )


@R.add("fn_33", "SELECT DISTINCT regexp_replace(point_id, '_[0-9]+_[0-9]+$', '') AS region FROM observations")
def fn_33(spark, d):
    return table(spark, d, "observations").select(ids.region(F.col("point_id")).alias("region")).distinct()


@R.add("fn_34", "SELECT id, starts_with(id, 'gate') AS a, contains(id, '_val_') AS b FROM training_regions")
def fn_34(spark, d):
    return table(spark, d, "training_regions").select(
        "id", F.col("id").startswith("gate").alias("a"), F.col("id").contains("_val_").alias("b")
    )


@R.add("fn_35", "SELECT file_id, printf('px_%04d_%04d', file_id % 97, n_rows) AS v FROM chunk_reports")
def fn_35(spark, d):
    return table(spark, d, "chunk_reports").select(
        "file_id", ids.point_name("px", F.col("file_id") % 97, F.col("n_rows")).alias("v")
    )


@R.add("fn_36", "SELECT obs_id, concat_ws('|', point_id, date::VARCHAR) AS k FROM observations")
def fn_36(spark, d):
    return table(spark, d, "observations").select(
        "obs_id", F.concat_ws("|", "point_id", F.col("date").cast("string")).alias("k")
    )


@R.add("fn_37", "SELECT id, CASE label WHEN 'presence' THEN 1 WHEN 'absence' THEN 0 END AS v FROM training_regions")
def fn_37(spark, d):
    codes = F.create_map(F.lit("presence"), F.lit(1), F.lit("absence"), F.lit(0))
    return table(spark, d, "training_regions").select("id", F.try_element_at(codes, F.col("label")).alias("v"))


@R.add("fn_38", "SELECT sample_id, coalesce(try_cast(split_part(point_id, '_', -1) AS INT), 0) AS v FROM tam_samples")
def fn_38(spark, d):
    return table(spark, d, "tam_samples").select("sample_id", ids.northing(F.col("point_id")).alias("v"))


# ---- dates ----------------------------------------------------------------------------------------------------------


@R.add("fn_40", "SELECT obs_id, year(date)::INT AS v FROM observations")
def fn_40(spark, d):
    return table(spark, d, "observations").select("obs_id", F.year("date").alias("v"))


@R.add("fn_41", "SELECT obs_id, dayofyear(date)::INT AS v FROM observations")
def fn_41(spark, d):
    return table(spark, d, "observations").select("obs_id", F.dayofyear("date").alias("v"))


@R.add("fn_42", "SELECT obs_id, month(date)::INT AS v FROM observations")
def fn_42(spark, d):
    return table(spark, d, "observations").select("obs_id", F.month("date").alias("v"))


@R.add("fn_43", "SELECT obs_id, date_trunc('month', date)::DATE AS v FROM observations")
def fn_43(spark, d):
    return table(spark, d, "observations").select("obs_id", F.trunc("date", "month").alias("v"))


@R.add(
    "fn_44",
    "SELECT sighting_id, try_cast(CASE WHEN regexp_full_match(eventDate, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN "
    "eventDate END AS DATE) AS v FROM sightings"
)
def fn_44(spark, d):
    day = F.when(F.col("eventDate").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("eventDate"))
    return table(spark, d, "sightings").select("sighting_id", F.try_to_date(day, "yyyy-MM-dd").alias("v"))


@R.add("fn_45", "SELECT obs_id, loaded_at::DATE AS v FROM observations")
def fn_45(spark, d):
    return table(spark, d, "observations").select("obs_id", F.col("loaded_at").cast("date").alias("v"))


@R.add("fn_46", "SELECT obs_id, year(loaded_at)::INT AS y, dayofyear(loaded_at)::INT AS doy FROM observations")
def fn_46(spark, d):
    """From microseconds since 1970 and back."""
    at = F.timestamp_micros(F.unix_micros("loaded_at"))
    return table(spark, d, "observations").select("obs_id", F.year(at).alias("y"), F.dayofyear(at).alias("doy"))


@R.add("fn_47", "SELECT obs_id, date_diff('day', date, loaded_at::DATE)::INT AS v FROM observations")
def fn_47(spark, d):
    return table(spark, d, "observations").select(
        "obs_id", F.datediff(F.col("loaded_at").cast("date"), "date").alias("v")
    )


@R.add("fn_48", "SELECT obs_id, strftime(date, '%Y-%m') AS v FROM observations")
def fn_48(spark, d):
    return table(spark, d, "observations").select("obs_id", F.date_format("date", "yyyy-MM").alias("v"))


@R.add(
    "fn_49", with_obs() + "SELECT DISTINCT doy, least(greatest(((doy - 1 + 182) % 365) + 1, 1), 365)::INT AS v FROM obs"
)
def fn_49(spark, d):
    return obs(spark, d).select("doy").distinct().select("doy", indices.shift_doy(F.col("doy"), 182).alias("v"))


# ---- arrays, maps, JSON -----------------------------------------------------------------------------------------------


@R.add("fn_50", "SELECT sample_id, doy[1] AS first, doy[2] AS second FROM tam_samples")
def fn_50(spark, d):
    return table(spark, d, "tam_samples").select(
        "sample_id", F.get("doy", F.lit(0)).alias("first"), F.get("doy", F.lit(1)).alias("second")
    )


@R.add("fn_51", "SELECT obs_id, coalesce(B08, 0) AS nir, 0 AS none FROM observations")
def fn_51(spark, d):
    bands = F.create_map(*[x for b in BANDS for x in (F.lit(b), F.col(b))])
    return table(spark, d, "observations").select(
        "obs_id", F.coalesce(F.try_element_at(bands, F.lit("B08")), F.lit(0)).alias("nir"),
        F.coalesce(F.try_element_at(bands, F.lit("B99")), F.lit(0)).alias("none")
    )


@R.add("fn_52", "SELECT sighting_id, year, month FROM sightings")
def fn_52(spark, d):
    text = F.to_json(F.struct("year", "month"))
    return table(spark, d, "sightings").withColumn(
        "j", F.from_json(text, "year int, month int")
    ).select("sighting_id", "j.*")


@R.add(
    "fn_53",
    "SELECT region_id, '[' || string_agg('{\"year\":' || year || ',\"n\":' || n || '}', ',' ORDER BY year) || ']' AS "
    "series FROM (SELECT region_id, year(date) AS year, count(*) AS n FROM observations GROUP BY ALL) GROUP BY "
    "region_id"
)
def fn_53(spark, d):
    counts = table(spark, d, "observations").groupBy(
        "region_id", F.year("date").alias("year")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("region_id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("year", "n")))).alias("series")
    )


@R.add(
    "fn_54",
    "SELECT id, list_has_any(tags, ['burnt', 'saline']) AS hit, list_filter(tags, lambda t: t NOT IN ('burnt', "
    "'saline')) AS rest FROM training_regions"
)
def fn_54(spark, d):
    wanted = F.array(F.lit("burnt"), F.lit("saline"))
    return table(spark, d, "training_regions").select(
        "id", F.arrays_overlap("tags", wanted).alias("hit"),
        F.filter("tags", lambda t: ~t.isin("burnt", "saline")).alias("rest")
    )


@R.add(
    "fn_55",
    "SELECT region_id, orbit FROM (SELECT region_id, orbit, row_number() OVER (PARTITION BY region_id ORDER BY n "
    "DESC, orbit) AS k FROM (SELECT region_id, orbit, count(*) AS n FROM observations WHERE orbit IS NOT NULL GROUP "
    "BY ALL)) WHERE k = 1"
)
def fn_55(spark, d):
    """The most frequent value; the first in the alphabet wins a tie."""
    counts = table(spark, d, "observations").where("orbit IS NOT NULL").groupBy("region_id", "orbit").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counts.groupBy("region_id").agg(F.max("n").alias("n"))
    return counts.join(best, ["region_id", "n"]).groupBy("region_id").agg(F.min("orbit").alias("orbit"))


@R.add("fn_56", "SELECT x::INT AS x, y::INT AS y FROM range(0, 20, 5) a(x), range(0, 15, 5) b(y)")
def fn_56(spark, d):
    both = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(15), F.lit(5))).alias("x"))
    return both.select("x", F.explode(F.sequence(F.lit(0), F.lit(10), F.lit(5))).alias("y"))


@R.add(
    "fn_57",
    "SELECT label, list_sort(list_distinct(flatten(list(years)))) AS years, list_min(flatten(list(years))) AS first, "
    "list_max(flatten(list(years))) AS last FROM training_regions GROUP BY label"
)
def fn_57(spark, d):
    """Years named by any region of a label: exploded and counted once, so that no group is collected before it is small."""
    years = table(spark, d, "training_regions").select("label", F.explode("years").alias("y")).distinct()
    return years.groupBy("label").agg(
        F.sort_array(F.collect_list("y")).alias("years"), F.min("y").alias("first"), F.max("y").alias("last")
    )


@R.add(
    "fn_58",
    "SELECT obs_id, (" + " OR ".join(f"{b} IS NULL" for b in BANDS) + ") AS some_null, ("
    + " AND ".join(f"{b} IS NULL" for b in BANDS) + ") AS all_null FROM observations"
)
def fn_58(spark, d):
    some, every = F.lit(False), F.lit(True)
    for b in BANDS:
        some, every = some | F.col(b).isNull(), every & F.col(b).isNull()
    return table(spark, d, "observations").select("obs_id", some.alias("some_null"), every.alias("all_null"))


# ---- nulls and shapes ---------------------------------------------------------------------------------------------------


@R.add("fn_60", "SELECT obs_id, coalesce(B04, -1) AS v FROM observations")
def fn_60(spark, d):
    return table(spark, d, "observations").select("obs_id", F.coalesce("B04", F.lit(-1)).alias("v"))


@R.add(
    "fn_61",
    "SELECT obs_id, CASE WHEN NOT isnan(NDVI) THEN NDVI END AS a, CASE WHEN isnan(NDVI) THEN 0 ELSE NDVI END AS b "
    "FROM observations"
)
def fn_61(spark, d):
    x = F.col("NDVI")
    return table(spark, d, "observations").select(
        "obs_id", F.nanvl(x, F.lit(None).cast("float")).alias("a"), F.nanvl(x, F.lit(0.0).cast("float")).alias("b")
    )


@R.add(
    "fn_62",
    "SELECT summary_id, CASE WHEN vhvv_dry < -10 THEN 'low' WHEN vhvv_dry < -5 THEN 'mid' WHEN vhvv_dry IS NOT NULL "
    "THEN 'high' ELSE 'none' END AS v FROM year_summaries"
)
def fn_62(spark, d):
    x = F.col("vhvv_dry")
    return table(spark, d, "year_summaries").select(
        "summary_id",
        F.when(x < -10, "low").when(x < -5, "mid").when(x.isNotNull(), "high").otherwise("none").alias("v")
    )


@R.add(
    "fn_63",
    "SELECT summary_id, CASE WHEN vhvv_dry IS NOT NULL THEN least(greatest(vhvv_dry, -8.0), -4.0) END AS v FROM "
    "year_summaries"
)
def fn_63(spark, d):
    return table(spark, d, "year_summaries").select(
        "summary_id", indices.clamp(F.col("vhvv_dry"), -8.0, -4.0).alias("v")
    )


@R.add(
    "fn_64",
    "SELECT sighting_id, round(lon, 3) AS a, round_even(coordinateUncertaintyInMeters / 10, 0) AS b FROM sightings"
)
def fn_64(spark, d):
    return table(spark, d, "sightings").select(
        "sighting_id", F.round("lon", 3).alias("a"), F.bround(F.col("coordinateUncertaintyInMeters") / 10, 0).alias("b")
    )


@R.add("fn_65", "SELECT obs_id FROM observations WHERE vv IS NOT NULL AND isfinite(vv)")
def fn_65(spark, d):
    x = F.col("vv")
    return table(spark, d, "observations").where(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ).select("obs_id")


#: A number in [0, 1) from a text, the same in every engine: the first 32 bits of its MD5.
def unit(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def unit_sql(*parts):
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@R.add(
    "fn_66",
    f"SELECT region_id, point_id, round((u - 0.5) * 0.02, 9) AS noise FROM (SELECT *, "
    f"{unit_sql('point_id', repr('noise'))} AS u, row_number() OVER (PARTITION BY region_id ORDER BY "
    f"{unit_sql('point_id', repr('42'))}, point_id) AS k FROM (SELECT DISTINCT region_id, point_id FROM "
    f"observations)) WHERE k <= 3"
)
def fn_66(spark, d):
    """A seeded sample of three points per region, with seeded noise: a sampling operator, so its limit is the feature."""
    from pyspark.sql import Window

    points = table(spark, d, "observations").select("region_id", "point_id").distinct()
    order = Window.partitionBy("region_id").orderBy(unit("point_id", F.lit("42")), "point_id")
    chosen = points.withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k")
    return chosen.withColumn("noise", F.round((unit("point_id", F.lit("noise")) - 0.5) * 0.02, 9))


# ---- spatial ------------------------------------------------------------------------------------------------------------

_PTS = "pts AS (SELECT point_id, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY 1)"


def pts(spark, d):
    return obs(spark, d).groupBy("point_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))


_UTM = "u AS (SELECT *, (floor((lon + 180) / 6) + 1)::INT AS zone FROM pts)"
_EAST, _NORTH = geodesy.utm_sql("lon", "lat", "zone")


def projected(spark, d):
    p = pts(spark, d).withColumn("zone", geodesy.utm_zone(F.col("lon")))
    p = geodesy.with_utm(p, F.col("lon"), F.col("lat"), F.col("zone"), "east", "north")
    return p.select("point_id", "zone", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"))


@R.add(
    "geo_02",
    with_obs(_PTS, _UTM) + f"SELECT point_id, zone, round({_EAST}, 2) AS east, round({_NORTH}, 2) AS north FROM u"
)
def geo_02(spark, d):
    return projected(spark, d)


_BOXES = "bb AS (SELECT id, bbox[1] AS w, bbox[2] AS s, bbox[3] AS e, bbox[4] AS n, (floor(((bbox[1] + bbox[3]) / 2 + 180) / 6) + 1)::INT AS zone FROM training_regions)"
_LOW, _HIGH = geodesy.utm_sql("w", "s", "zone"), geodesy.utm_sql("e", "n", "zone")
STEP = 1000.0
_SNAPPED = f"gr AS (SELECT *, floor(x0 / {STEP}) * {STEP} AS xs, floor(y0 / {STEP}) * {STEP} AS ys FROM (SELECT *, {_LOW[0]} AS x0, {_LOW[1]} AS y0, {_HIGH[0]} AS x1, {_HIGH[1]} AS y1 FROM bb))"


def boxes(spark, d):
    return table(spark, d, "training_regions").select(
        "id", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("wsen")]
    )


@R.add(
    "geo_01",
    "WITH " + ", ".join((_BOXES, _SNAPPED))
    + f", px AS (SELECT id, zone, i, j, xs + i * {STEP} AS x, ys + j * {STEP} AS y FROM gr, LATERAL (SELECT "
    f"unnest(range(ceil((x1 - xs) / {STEP})::BIGINT)) AS i), LATERAL (SELECT unnest(range(ceil((y1 - ys) / "
    f"{STEP})::BIGINT)) AS j)) SELECT id, printf('px_%04d_%04d', i, j) AS point_id, round(lon, 6) AS lon, round(lat, "
    f"6) AS lat FROM ({geodesy.utm_inverse_sql('px', 'x', 'y', 'zone')})"
)
def geo_01(spark, d):
    """A snapped grid of pixels for each box: projected, opened along both axes, and turned back to degrees."""
    g = geodesy.pixel_grid(boxes(spark, d), STEP)
    steps = lambda lo, hi: F.explode(F.sequence(F.lit(0), (F.ceil((F.col(hi) - F.col(lo)) / STEP) - 1).cast("int")))
    px = g.where("x1 > xs AND y1 > ys").withColumn("i", steps("xs", "x1")).withColumn("j", steps("ys", "y1"))
    px = geodesy.with_degrees(
        px, F.col("xs") + F.col("i") * STEP, F.col("ys") + F.col("j") * STEP, F.col("zone"), F.col("south"), "lon",
        "lat"
    )
    name = ids.point_name("px", F.col("i"), F.col("j"))
    return px.select("id", name.alias("point_id"), r6(F.col("lon"), "lon"), r6(F.col("lat"), "lat"))


@R.add(
    "geo_03",
    with_obs(_PTS)
    + "SELECT point_id, (CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6) + 1)::INT AS epsg FROM pts"
)
def geo_03(spark, d):
    return pts(spark, d).select("point_id", geodesy.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


CHUNK_PX = 8
_BLOCK = STEP * CHUNK_PX
_CHUNKS = (
    _BOXES,
    _SNAPPED,
    f"an AS (SELECT *, floor(x0 / 100000) * 100000 AS tile_x, ceil(y1 / 100000) * 100000 AS tile_y, xs + (ceil((x1 - "
    f"xs) / {STEP}) - 1) * {STEP} AS lx, ys + (ceil((y1 - ys) / {STEP}) - 1) * {STEP} AS ly FROM gr)",
    f"op AS (SELECT *, tile_x + chunk_col * {_BLOCK} AS x_left, tile_y - (chunk_row + 1) * {_BLOCK} AS y_lower FROM "
    f"an, LATERAL (SELECT unnest(range(floor((xs - tile_x) / {_BLOCK})::BIGINT, floor((lx - tile_x) / "
    f"{_BLOCK})::BIGINT + 1))::INT AS chunk_col), LATERAL (SELECT unnest(range(ceil((tile_y - ly) / "
    f"{_BLOCK})::BIGINT - 1, ceil((tile_y - ys) / {_BLOCK})::BIGINT))::INT AS chunk_row))",
    f"ck AS (SELECT *, greatest(x_left, xs) AS px0, greatest(y_lower, ys) AS py0, least(x_left + {_BLOCK - STEP}, "
    f"lx) AS px1, least(y_lower + {_BLOCK - STEP}, ly) AS py1 FROM op WHERE greatest(x_left, xs) <= least(x_left + "
    f"{_BLOCK - STEP}, lx) AND greatest(y_lower, ys) <= least(y_lower + {_BLOCK - STEP}, ly))",
    f"co AS (SELECT id, chunk_row, chunk_col, zone, unnest([px0, px0, px1, px1]) AS cx, unnest([py0, py1, py0, py1]) "
    f"AS cy FROM ck)",
    f"cd AS (SELECT id, chunk_row, chunk_col, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS "
    f"north FROM ({geodesy.utm_inverse_sql('co', 'cx', 'cy', 'zone')}) GROUP BY ALL)",
    "sl AS (SELECT cd.* FROM cd JOIN bb USING (id) WHERE greatest(west - (w + e) / 2, (w + e) / 2 - east, 0) / ((e - "
    "w) / 2) + greatest(south - (s + n) / 2, (s + n) / 2 - north, 0) / ((n - s) / 2) <= 1)",
)


def chunks(spark, d):
    """The chunks of each region that meet its polygon, here the diamond inside its box."""
    g = geodesy.chunk_grid(boxes(spark, d), STEP, CHUNK_PX)
    inner = [F.col(c) for c in ("px0", "py0", "px1", "py1")]
    g = geodesy.with_degree_box(g, F.col("zone"), F.col("south"), *inner, names=("west", "low", "east", "high"))
    away = lambda lo, hi, a, b: F.greatest(
        F.col(lo) - (F.col(a) + F.col(b)) / 2, (F.col(a) + F.col(b)) / 2 - F.col(hi), F.lit(0.0)
    ) / ((F.col(b) - F.col(a)) / 2)
    return g.where(away("west", "east", "w", "e") + away("low", "high", "s", "n") <= 1)


@R.add(
    "geo_04",
    "WITH " + ", ".join(_CHUNKS)
    + " SELECT id, chunk_row, chunk_col, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, "
    "round(north, 6) AS north, row_number() OVER (PARTITION BY id ORDER BY chunk_row, chunk_col) AS place FROM sl"
)
def geo_04(spark, d):
    """Chunks on the tile's own grid, in rows from the north, with the box of their pixels."""
    from gridwake.operators.order_stats import numbered

    g = chunks(spark, d).select(
        "id", "chunk_row", "chunk_col", r6(F.col("west"), "west"), r6(F.col("low"), "south"), r6(F.col("east"), "east"),
        r6(F.col("high"), "north")
    )
    return numbered(g, ["id"], ["chunk_row", "chunk_col"], "place")


_SPAN = 10_980 * 10.0 + 20_000.0


@R.add(
    "geo_05",
    "WITH " + ", ".join(_CHUNKS)
    + f" SELECT id, chunk_row, chunk_col, printf('px_%04d_%04d', round((x - tile_x) / {STEP})::BIGINT, round((y - "
    f"(tile_y - {_SPAN})) / {STEP})::BIGINT) AS point_id, x >= xs AND x <= lx AND y >= ys AND y <= ly AS clipped "
    f"FROM (SELECT ck.*, x_left + i * {STEP} AS x, y_lower + j * {STEP} AS y FROM ck SEMI JOIN sl USING (id, "
    f"chunk_row, chunk_col), range({CHUNK_PX}) a(i), range({CHUNK_PX}) b(j))"
)
def geo_05(spark, d):
    """All points of the chunks, named from the tile's corner, so that two requests give a place the same name.

    ``clipped`` tells which of them lie inside the request: those alone are fetched unless full chunks are asked for.
    """
    opened = chunks(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_PX - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_PX - 1)))
    )
    x, y = F.col("x_left") + F.col("i") * STEP, F.col("y_lower") + F.col("j") * STEP
    index = lambda c: F.round(c / STEP).cast("long")
    name = ids.point_name("px", index(x - F.col("tile_x")), index(y - (F.col("tile_y") - _SPAN)))
    return opened.select(
        "id", "chunk_row", "chunk_col", name.alias("point_id"),
        (x.between(F.col("xs"), F.col("lx")) & y.between(F.col("ys"), F.col("ly"))).alias("clipped")
    )


@R.add(
    "geo_06",
    with_obs()
    + f"SELECT (regexp_extract(point_id, '_([0-9]+)$', 1)::INT // 16)::INT AS row, (regexp_extract(point_id, "
    f"'_([0-9]+)_[0-9]+$', 1)::INT // 16)::INT AS col, max(round(i_ndvi, 6)) AS value FROM obs WHERE {GOOD} GROUP BY ALL"
)
def geo_06(spark, d):
    df = ob.optical(obs(spark, d)).withColumn("score", F.round("i_ndvi", 6))
    return scoring.to_grid(
        df, F.floor(ids.northing(F.col("point_id")) / 16).cast("int"),
        F.floor(ids.easting(F.col("point_id")) / 16).cast("int")
    )


@R.add(
    "geo_07",
    with_obs(_PTS)
    + "SELECT point_id, floor((lon + 180) / 360 * 1024)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1 / "
    "cos(radians(lat))) / pi()) / 2 * 1024)::INT AS y, round(floor((lon + 180) / 360 * 1024) / 1024 * 360 - 180, 6) "
    "AS west FROM pts"
)
def geo_07(spark, d):
    x, y = geodesy.slippy(F.col("lon"), F.col("lat"), 10)
    return pts(spark, d).select("point_id", x.alias("x"), y.alias("y")).select(
        "point_id", "x", "y", r6(geodesy.slippy_bounds(F.col("x"), F.col("y"), 10)["west"], "west")
    )


_N = 256.0 * 2**8
_MERC = "(1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2"
_WARP = (
    f"gr AS (SELECT round(lon * 100 + 1e-9)::BIGINT AS cx, round(lat * 100 + 1e-9)::BIGINT AS cy, max(round(i_ndvi, "
    f"6)) AS v FROM obs WHERE {GOOD} GROUP BY ALL)",
    f"cd AS (SELECT *, unnest(range(floor((cx / 100.0::DOUBLE - 0.005 + 180) / 360 * {_N})::BIGINT, floor((cx / "
    f"100.0::DOUBLE + 0.005 + 180) / 360 * {_N})::BIGINT + 1)) AS px, "
    f"floor({_MERC.format(y='(cy / 100.0::DOUBLE + 0.005)')} * {_N})::BIGINT AS p0, "
    f"floor({_MERC.format(y='(cy / 100.0::DOUBLE - 0.005)')} * {_N})::BIGINT AS p1 FROM gr WHERE v IS NOT NULL)",
    "pp AS (SELECT *, unnest(range(p0, p1 + 1)) AS py FROM cd)",
    f"pc AS (SELECT *, (px + 0.5) / {_N} * 360 - 180 AS x, degrees(atan(sinh(pi() * (1 - 2 * (py + 0.5) / {_N})))) "
    f"AS y FROM pp)",
)


@R.add(
    "geo_08",
    with_obs(*_WARP)
    + "SELECT px // 256 AS tx, py // 256 AS ty, count(*) AS n_pixels, round(sum(v), 4) AS total FROM pc WHERE "
    "round(x * 100 + 1e-9) = cx AND round(y * 100 + 1e-9) = cy GROUP BY ALL"
)
def geo_08(spark, d):
    """A grid in degrees warped to map pixels by the nearest cell, zoom 8 and 256 pixels a tile; tiles without pixels aren't made.

    Each cell opens into the few pixels it may cover, and keeps those whose middle it is nearest to, so no pixel is computed
    that holds nothing.
    """
    cell = lambda c: F.round(F.col(c) * 100 + 1e-9).cast("long")
    grid = ob.optical(obs(spark, d)).groupBy(
        cell("lon").alias("cx"), cell("lat").alias("cy")
    ).agg(F.max(F.round("i_ndvi", 6)).alias("v")).where("v IS NOT NULL")
    x, y = F.col("cx") / 100.0, F.col("cy") / 100.0
    (x0, y0), (x1, y1) = geodesy.slippy(x - 0.005, y + 0.005, 16), geodesy.slippy(x + 0.005, y - 0.005, 16)
    opened = grid.withColumn("px", F.explode(F.sequence(x0, x1))).withColumn("py", F.explode(F.sequence(y0, y1)))
    middle = geodesy.slippy_bounds(F.col("px") + 0.5, F.col("py") + 0.5, 16)
    kept = opened.withColumns({"x": middle["west"], "y": middle["north"]}).where(
        (cell("x") == F.col("cx")) & (cell("y") == F.col("cy"))
    )
    tile = lambda c: F.floor(F.col(c) / 256)
    return kept.groupBy(tile("px").alias("tx"), tile("py").alias("ty")).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.round(F.sum("v"), 4).alias("total")
    )


def meeting_tiles(spark, d):
    """Tiles that meet each region's box, compared only where both touch the same cell of a degree."""
    tiles = obs(spark, d).where("tile_id IS NOT NULL").groupBy("tile_id").agg(
        F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n")
    )
    areas = table(spark, d, "training_regions").select(
        "id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("bw", "bs", "be", "bn"))]
    )

    def cells(df, w, s, e, n):
        span = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")))
        return df.withColumn("cx", span(w, e)).withColumn("cy", span(s, n))

    near = cells(areas, "bw", "bs", "be", "bn").join(cells(tiles, "w", "s", "e", "n"), ["cx", "cy"])
    met = near.where(
        geodesy.overlaps(tuple(F.col(c) for c in ("bw", "bs", "be", "bn")), tuple(F.col(c) for c in "wsen"))
    )
    return met.select("id", "tile_id", "bw", "bs", "be", "bn", *"wsen").distinct()


R.add(
    "geo_09",
    with_obs(
        "t AS (SELECT tile_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM obs WHERE tile_id IS "
        "NOT NULL GROUP BY 1)"
    )
    + "SELECT id, tile_id FROM training_regions, t WHERE bbox[1] <= e AND bbox[3] >= w AND bbox[2] <= n AND bbox[4] >= s"
)(lambda spark, d: meeting_tiles(spark, d).select("id", "tile_id"))


@R.add("geo_09_needed")
def geo_09_needed(spark, d):
    """Of the tiles that meet a region, those that are needed: one whose share of the region its kept neighbours cover is dropped."""
    from gridwake.operators.tiles import needed_tiles

    return needed_tiles(meeting_tiles(spark, d))


@R.add(
    "geo_10",
    f"SELECT id, (bbox[1] <= {BOX[2]} AND bbox[3] >= {BOX[0]} AND bbox[2] <= {BOX[3]} AND bbox[4] >= {BOX[1]}) AS "
    f"hit FROM training_regions"
)
def geo_10(spark, d):
    return table(spark, d, "training_regions").select(
        "id",
        geodesy.overlaps(tuple(F.get("bbox", F.lit(i)) for i in range(4)), tuple(F.lit(x) for x in BOX)).alias("hit")
    )


@R.add(
    "geo_11",
    "SELECT id, round((bbox[3] - bbox[1]) * 111320 * cos(radians((bbox[2] + bbox[4]) / 2)), 3) AS width, "
    "round((bbox[4] - bbox[2]) * 111320, 3) AS height FROM training_regions"
)
def geo_11(spark, d):
    w, s, e, n = (F.get("bbox", F.lit(i)) for i in range(4))
    kx, ky = geodesy.metres_per_degree((s + n) / 2)
    return table(spark, d, "training_regions").select(
        "id", F.round((e - w) * kx, 3).alias("width"), F.round((n - s) * ky, 3).alias("height")
    )


_TILE_M = 2560.0
_L55, _H55 = geodesy.utm_sql("w", "s", "55"), geodesy.utm_sql("e", "n", "55")
_SUBDIVIDED = (
    "bb AS (SELECT id, bbox[1] AS w, bbox[2] AS s, bbox[3] AS e, bbox[4] AS n FROM training_regions)",
    f"pr AS (SELECT *, {_L55[0]} AS x0, {_L55[1]} AS y0, {_H55[0]} AS x1, {_H55[1]} AS y1 FROM bb)",
    f"nt AS (SELECT *, greatest(ceil((x1 - x0) / {_TILE_M}), 1)::BIGINT AS n_cols, greatest(ceil((y1 - y0) / "
    f"{_TILE_M}), 1)::BIGINT AS n_rows FROM pr)",
    "op AS (SELECT *, unnest(range(n_cols)) AS col FROM nt)",
    f"tl AS (SELECT *, x0 + col * {_TILE_M} AS a0, least(x0 + (col + 1) * {_TILE_M}, x1) AS a1, y0 + row * {_TILE_M} "
    f"AS b0, least(y0 + (row + 1) * {_TILE_M}, y1) AS b1 FROM (SELECT *, unnest(range(n_rows)) AS row FROM op))",
    "cn AS (SELECT *, unnest([a0, a0, a1, a1]) AS cx, unnest([b0, b1, b0, b1]) AS cy, 55 AS zone FROM tl)",
    f"gb AS (SELECT id, row, col, n_cols, n_rows, w, s, e, n, min(lon) AS g0, min(lat) AS h0, max(lon) AS g1, "
    f"max(lat) AS h1 FROM ({geodesy.utm_inverse_sql('cn', 'cx', 'cy', 'zone')}) GROUP BY ALL)",
)


@R.add(
    "geo_12",
    "WITH " + ", ".join(_SUBDIVIDED)
    + " SELECT id, row, col, round(CASE WHEN col = 0 THEN w ELSE greatest(g0, w) END, 6) AS west, round(CASE WHEN "
    "row = 0 THEN s ELSE greatest(h0, s) END, 6) AS south, round(CASE WHEN col = n_cols - 1 THEN e ELSE least(g1, e) "
    "END, 6) AS east, round(CASE WHEN row = n_rows - 1 THEN n ELSE least(h1, n) END, 6) AS north FROM gb"
)
def geo_12(spark, d):
    """A box cut into tiles of a projected size; the outermost edges are the box's own, so that the tiles cover it without a gap."""
    g = geodesy.pixel_grid(boxes(spark, d), 1.0, zone=55)
    count = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / _TILE_M), F.lit(1))
    g = g.withColumns({"n_cols": count("x0", "x1"), "n_rows": count("y0", "y1")})
    g = g.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1))).withColumn(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1))
    )
    edge = lambda o, k, top: (F.col(o) + F.col(k) * _TILE_M, F.least(F.col(o) + (F.col(k) + 1) * _TILE_M, F.col(top)))
    (a0, a1), (b0, b1) = edge("x0", "col", "x1"), edge("y0", "row", "y1")
    g = g.withColumns({"a0": a0, "a1": a1, "b0": b0, "b1": b1})
    corners = [F.col(c) for c in ("a0", "b0", "a1", "b1")]
    g = geodesy.with_degree_box(g, F.lit(55), F.lit(True), *corners, names=("west", "low", "east", "high"))
    west, low, east, high = (F.col(c) for c in ("west", "low", "east", "high"))
    first, last = lambda k: F.col(k) == 0, lambda k: F.col(k) == F.col(f"n_{k}s") - 1
    return g.select(
        "id", "row", "col",
        r6(F.when(first("col"), F.col("w")).otherwise(F.greatest(west, F.col("w"))), "west"),
        r6(F.when(first("row"), F.col("s")).otherwise(F.greatest(low, F.col("s"))), "south"),
        r6(F.when(last("col"), F.col("e")).otherwise(F.least(east, F.col("e"))), "east"),
        r6(F.when(last("row"), F.col("n")).otherwise(F.least(high, F.col("n"))), "north"),
    )


@R.add(
    "geo_14", with_obs() + "SELECT obs_id, round(lon * 10000)::BIGINT AS cx, round(lat * 10000)::BIGINT AS cy FROM obs"
)
def geo_14(spark, d):
    return obs(spark, d).select(
        "obs_id", *[F.round(F.col(c) * 10000).cast("long").alias(n) for c, n in (("lon", "cx"), ("lat", "cy"))]
    )


@R.add(
    "geo_15",
    "WITH "
    + ", ".join(
        (
            *_CHUNKS,
            f"rg AS (SELECT id, chunk_row, chunk_col, zone, unnest([0, 1, 2, 3, 4]) AS k, unnest([x_left, x_left + "
            f"{_BLOCK}, x_left + {_BLOCK}, x_left, x_left]) AS cx, unnest([y_lower, y_lower, y_lower + {_BLOCK}, "
            f"y_lower + {_BLOCK}, y_lower]) AS cy FROM ck SEMI JOIN sl USING (id, chunk_row, chunk_col))"
        )
    )
    + f" SELECT id, chunk_row, chunk_col, list([round(lon, 6), round(lat, 6)] ORDER BY k) AS ring FROM "
    f"({geodesy.utm_inverse_sql('rg', 'cx', 'cy', 'zone')}) GROUP BY ALL"
)
def geo_15(spark, d):
    """The ring of each chunk's block in degrees, closed, from its projected corners."""
    x0, y0 = F.col("x_left"), F.col("y_lower")
    df = chunks(spark, d)
    for k, (x, y) in enumerate([(x0, y0), (x0 + _BLOCK, y0), (x0 + _BLOCK, y0 + _BLOCK), (x0, y0 + _BLOCK)]):
        df = geodesy.with_degrees(df, x, y, F.col("zone"), F.col("south"), f"lon{k}", f"lat{k}")
    ring = [F.array(F.round(f"lon{k}", 6), F.round(f"lat{k}", 6)) for k in (0, 1, 2, 3, 0)]
    return df.select("id", "chunk_row", "chunk_col", F.array(*ring).alias("ring"))


QUERIES, SQL = R.queries, R.sql
