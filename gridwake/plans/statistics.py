"""Aggregations and window functions over observations."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwake.functions import ids, indices
from gridwake.operators import evaluation as ev
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.operators import windows as wi
from gridwake.plans.base import BANDS, BOX, GOOD, obs, with_obs, table
from gridwake.plans.registry import Registry

R = Registry()
r6 = lambda c, name: F.round(c, 6).alias(name)


def q(x, f):
    return f"round(quantile_cont({x}, {f}), 6)"


def rounded(df, keys):
    kinds = dict(df.dtypes)
    return df.select(
        *keys, *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys]
    )


#: Added before rounding where exact ties are common (means of few decimals, medians of pairs), so that they round alike
#: whatever the last bit of the sum.
TIE = 1e-9


def steady(df, keys, digits=6):
    """As ``rounded``, with ties upwards."""
    kinds = dict(df.dtypes)
    return df.select(
        *keys,
        *[
            F.round(F.col(c) + TIE, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns
            if c not in keys
        ]
    )


def steady_sql(x, digits=6):
    return f"round({x} + {TIE}, {digits})"


@R.add(
    "agg_01",
    with_obs()
    + f"SELECT point_id, year, {q('i_ndvi', 0.05)} AS p05, {q('i_ndvi', 0.25)} AS p25, {q('i_ndvi', 0.5)} AS p50, "
    f"{q('i_ndvi', 0.75)} AS p75, {q('i_ndvi', 0.95)} AS p95, round(stddev_pop(i_ndvi), 6) AS std, "
    f"round(quantile_cont(i_ndvi, 0.95) - quantile_cont(i_ndvi, 0.05), 6) AS amplitude, count(i_ndvi) AS n_obs FROM "
    f"obs WHERE {GOOD} GROUP BY ALL"
)
def agg_01(spark, d):
    return rounded(ob.optical(obs(spark, d)).groupBy(*wi.WINDOW).agg(*wi.summarise(F.col("i_ndvi"))), wi.WINDOW)


@R.add(
    "agg_02",
    with_obs()
    + f"SELECT point_id, year, round(avg(vh_db) FILTER (doy BETWEEN 121 AND 304), 6) AS dry_mean, "
    f"round(stddev_pop(vh_db) FILTER (doy BETWEEN 121 AND 304), 6) AS dry_std, count(vh_db) FILTER (doy BETWEEN 121 "
    f"AND 304) AS dry_n, {q('vh_db', 0.5)} AS p50 FROM obs WHERE source = 'S1' GROUP BY ALL"
)
def agg_02(spark, d):
    df = ob.radar(obs(spark, d)).groupBy(*wi.WINDOW).agg(
        *wi.dry_summary(F.col("vh_db"), F.col("doy")), F.percentile("vh_db", F.lit(0.5)).alias("p50")
    )
    return rounded(df, wi.WINDOW)


#: The sixteen optical features: bands as reflectance, then indices; and the four of radar.
OPTICAL = {**{b: f"r_{b}" for b in BANDS}, **{n.lower(): f"i_{n.lower()}" for n in indices.INDICES}}
RADAR = {"s1_vh": "vh_db", "s1_vv": "vv_db", "s1_vh_vv": "vh_vv", "s1_rvi": "rvi"}


IS_RADAR = "source = 'S1'"


def _value_sql(column):
    return f"{column[2:]} / 10000.0::DOUBLE" if column.startswith("r_") else column


def _value(column):
    return indices.reflectance(column[2:]) if column.startswith("r_") else F.col(column)


def summary_sql(features, gate, digits=6):
    """The annual summaries of features in SQL, rounded unless ``digits`` is None."""
    at = (lambda x: x) if digits is None else (lambda x: f"round({x}, {digits})")
    parts = []
    for name, column in features.items():
        x = f"({_value_sql(column)})"
        few = f"count({x}) FILTER ({gate}) < 2"
        for f, end in ((0.05, "p5"), (0.95, "p95")):
            parts.append(
                f"CASE WHEN {few} THEN 0.0 ELSE {at(f'quantile_cont({x}, {f}) FILTER ({gate})')} END AS {name}_{end}"
            )
        parts.append(f"CASE WHEN {few} THEN 1.0 ELSE {at(f'stddev_pop({x}) FILTER ({gate})')} END AS {name}_std")
    return ", ".join(parts)


def annual_summaries(df, names=None):
    """5th and 95th percentile and deviation of the features per window that has an optical reading of enough purity.

    All twenty features unless some are named: only what is asked for is shuffled.
    """
    good, radar = F.expr(GOOD), F.col("source") == "S1"
    columns = {n: F.when(good, _value(c)) for n, c in OPTICAL.items() if names is None or n in names}
    columns |= {n: F.when(radar, F.col(c)) for n, c in RADAR.items() if names is None or n in names}
    used = df.where(good | radar).select(*wi.WINDOW, good.alias("_good"), *[c.alias(n) for n, c in columns.items()])
    return wi.band_summaries(used, wi.WINDOW, list(columns), needed="_good")


@R.add(
    "agg_03",
    with_obs()
    + f"SELECT point_id, year, {summary_sql(OPTICAL, GOOD)}, {summary_sql(RADAR, IS_RADAR)} FROM obs GROUP BY "
    f"point_id, year HAVING count(*) FILTER ({GOOD}) > 0"
)
def agg_03(spark, d):
    return rounded(annual_summaries(obs(spark, d)), wi.WINDOW)


def _stat(name, keys, value, fn, floor, where="true", sample=False):
    text = f"SELECT {', '.join(keys)}, round(coalesce(avg({value}), 0), 6) AS mean, round(CASE WHEN count({value}) = 0 THEN 1 ELSE greatest(coalesce({fn}({value}), {floor}), {floor}) END, 6) AS std FROM obs WHERE {where} GROUP BY ALL"
    R.add(name, with_obs() + text)(
        lambda spark, d: rounded(wi.scale_stats(obs(spark, d).where(where), keys, value, sample, floor), keys)
    )


_stat("agg_04", ["point_id", "year", "source"], "i_ndvi", "stddev_pop", 1e-6)
_stat("agg_06", ["point_id", "year"], "i_mavi", "stddev_samp", 1e-6, "source = 'S2' AND scl_purity >= 1", True)
_stat("agg_08", ["point_id"], "vh_db", "stddev_samp", 0.1, "source = 'S1'", True)

#: In this pass three indices have a denominator of at least 1e-6, as the scorer's own normalisation has.
_HELD = {
    "ndvi": ("B08 - B04", "B08 + B04"), "ndwi": ("B03 - B08", "B03 + B08"),
    "evi": ("2.5 * (B08 - B04)", "B08 + 6.0 * B04 - 7.5 * B02 + 1.0")
}


def _held_value(name, column):
    if name not in _HELD:
        return _value(column)
    top, bottom = (F.expr(re.sub(r"\b(B[01][0-9])\b", r"(CAST(\1 AS DOUBLE) / 10000D)", x)) for x in _HELD[name])
    return F.when(top.isNotNull() & bottom.isNotNull(), top / F.greatest(bottom, F.lit(1e-6)))


def _held_sql(name, column):
    if name not in _HELD:
        return f"({_value_sql(column)})"
    top, bottom = (
        re.sub(r"\b(B[01][0-9])\b", r"(\1 / 10000.0::DOUBLE)", re.sub(r"\b([0-9]+\.[0-9]+)\b", r"\1::DOUBLE", x))
        for x in _HELD[name]
    )
    return f"(CASE WHEN {top} IS NOT NULL AND {bottom} IS NOT NULL THEN ({top}) / greatest({bottom}, 1e-6::DOUBLE) END)"


_POINT_SQL = ", ".join(
    f"{steady_sql(f'coalesce(avg({x}), 0)')} AS {n}_mean, "
    f"{steady_sql(f'greatest(coalesce(stddev_samp({x}), 1.0), 1e-6)')} AS {n}_std"
    for n, x in ((n, _held_sql(n, c)) for n, c in OPTICAL.items())
)


def point_scales(df):
    """Mean and sample deviation of all sixteen features per point over all years, optical rows of enough purity.

    No value gives mean 0; a deviation that isn't known (fewer than two values) is 1, and one below 1e-6 is 1e-6.
    """
    flat = ob.optical(df).select("point_id", *[_held_value(n, c).alias(n) for n, c in OPTICAL.items()])
    columns = []
    for n in OPTICAL:
        columns.append(F.coalesce(F.avg(n), F.lit(0.0)).alias(f"{n}_mean"))
        columns.append(F.greatest(F.coalesce(F.stddev_samp(n), F.lit(1.0)), F.lit(1e-6)).alias(f"{n}_std"))
    return flat.groupBy("point_id").agg(*columns)


@R.add("agg_09", with_obs() + f"SELECT point_id, {_POINT_SQL} FROM obs WHERE {GOOD} GROUP BY point_id")
def agg_09(spark, d):
    return steady(point_scales(obs(spark, d)), ["point_id"])


_SOURCES = {"S2": OPTICAL, "S1": RADAR}
_GLOBAL_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS source, '{n}' AS feature, round(coalesce(avg({x}), 0), 6) AS mean, round(CASE WHEN "
    f"coalesce(stddev_samp({x}), 0) < 1e-6 THEN 1.0 ELSE stddev_samp({x}) END, 6) AS std FROM obs WHERE source = "
    f"'{kind}'"
    for kind, features in _SOURCES.items() for n, x in ((n, f"({_value_sql(c)})") for n, c in features.items())
)


def global_scales(df):
    """``(source, feature, mean, std)`` over the whole table in one aggregation; a deviation below 1e-6 or unknown is 1."""
    columns, out = [], []
    for kind, features in _SOURCES.items():
        for n, c in features.items():
            x = F.when(F.col("source") == kind, _value(c))
            columns += [F.avg(x).alias(f"{n}_m"), F.stddev_samp(x).alias(f"{n}_s")]
            std = F.when(F.coalesce(f"{n}_s", F.lit(0.0)) < 1e-6, 1.0).otherwise(F.col(f"{n}_s"))
            out.append(
                F.struct(
                    F.lit(kind).alias("source"), F.lit(n).alias("feature"),
                    F.coalesce(f"{n}_m", F.lit(0.0)).alias("mean"), std.alias("std")
                )
            )
    return df.agg(*columns).select(F.explode(F.array(*out)).alias("e")).select("e.*")


@R.add("agg_10", with_obs() + _GLOBAL_SQL)
def agg_10(spark, d):
    return rounded(global_scales(obs(spark, d)), ["source", "feature"])


@R.add(
    "agg_05",
    with_obs()
    + "SELECT point_id, year, count(*) FILTER (source = 'S2') AS n_s2, count(*) FILTER (source = 'S1') AS n_s1 FROM "
    "obs GROUP BY ALL"
)
def agg_05(spark, d):
    return obs(spark, d).groupBy(*wi.WINDOW).agg(
        F.count_if(F.col("source") == "S2").alias("n_s2"), F.count_if(F.col("source") == "S1").alias("n_s1")
    )


@R.add(
    "agg_07",
    with_obs()
    + "SELECT obs_id, round(coalesce((i_ndvi - avg(i_ndvi) OVER w) / greatest(coalesce(stddev_samp(i_ndvi) OVER w, "
    "1e-6), 1e-6), 0), 4) AS z FROM obs WHERE source = 'S2' WINDOW w AS (PARTITION BY point_id)"
)
def agg_07(spark, d):
    return wi.z_score(
        obs(spark, d).where("source = 'S2'"), ["point_id"], "i_ndvi", "z", sample=True
    ).select("obs_id", F.round("z", 4).alias("z"))


_YEARLY = "y AS (SELECT point_id, year, round(1 / (1 + exp(-(avg(i_ndvi) * 4 - 1))), 6) AS score FROM obs WHERE " + GOOD + " GROUP BY ALL)"


def yearly(spark, d):
    return ob.optical(obs(spark, d)).groupBy(*wi.WINDOW).agg(
        F.round(indices.sigmoid(F.avg("i_ndvi") * 4 - 1), 6).alias("score")
    )


@R.add(
    "agg_11",
    with_obs(_YEARLY)
    + "SELECT point_id, round(sum(exp(-0.3 * (2022 - year)) * score) / sum(exp(-0.3 * (2022 - year))), 6) AS score "
    "FROM y GROUP BY 1"
)
def agg_11(spark, d):
    return scoring.over_years(yearly(spark, d), 2022, 0.3).select("point_id", r6("score", "score"))


@R.add("agg_12", with_obs(_YEARLY) + "SELECT point_id, max(score) AS score FROM y GROUP BY 1")
def agg_12(spark, d):
    return yearly(spark, d).groupBy("point_id").agg(F.max("score").alias("score"))


@R.add(
    "agg_13",
    with_obs()
    + "SELECT point_id, year, round(avg(vh_db), 6) AS vh_dry FROM obs WHERE source = 'S1' AND doy BETWEEN 121 AND "
    "304 GROUP BY ALL"
)
def agg_13(spark, d):
    return ob.radar(obs(spark, d)).where(wi.flags_dry(F.col("doy"))).groupBy(*wi.WINDOW).agg(
        r6(F.avg("vh_db"), "vh_dry")
    )


@R.add(
    "agg_14",
    with_obs()
    + "SELECT point_id, year, round(avg(i_ndvi), 6) AS ndvi_dry FROM obs WHERE source = 'S2' AND scl IN (4, 5) AND "
    "doy BETWEEN 121 AND 304 GROUP BY ALL"
)
def agg_14(spark, d):
    return obs(spark, d).where(
        (F.col("source") == "S2") & F.col("scl").isin(4, 5) & wi.flags_dry(F.col("doy"))
    ).groupBy(*wi.WINDOW).agg(r6(F.avg("i_ndvi"), "ndvi_dry"))


_MEANS = ("i_ndvi", "i_ndwi", "i_evi", "i_mavi", "i_ndre", "i_ci_re", "i_ndsvi")


@R.add(
    "agg_15",
    with_obs() + "SELECT point_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS)
    + f" FROM obs WHERE {GOOD} AND doy BETWEEN 121 AND 304 GROUP BY 1"
)
def agg_15(spark, d):
    return ob.optical(obs(spark, d)).where(wi.flags_dry(F.col("doy"))).groupBy("point_id").agg(
        *[r6(F.avg(c), c) for c in _MEANS]
    )


@R.add(
    "agg_16",
    with_obs()
    + "SELECT region_id, round(avg(m), 6) AS vh_dry, count(*) AS n FROM (SELECT region_id, point_id, avg(vh_db) AS m "
    "FROM obs WHERE source = 'S1' AND doy BETWEEN 121 AND 304 AND vh_db IS NOT NULL GROUP BY ALL) GROUP BY 1"
)
def agg_16(spark, d):
    dry = ob.radar(obs(spark, d)).where(wi.flags_dry(F.col("doy")) & F.col("vh_db").isNotNull())
    return dry.groupBy("region_id", "point_id").agg(F.avg("vh_db").alias("m")).groupBy("region_id").agg(
        r6(F.avg("m"), "vh_dry"), F.count(F.lit(1)).alias("n")
    )


_SERIES_PARTS = [
    ("ndvi", "i_ndvi", "source = 'S2' AND scl_purity >= 1"), ("mavi", "i_mavi", "source = 'S2' AND scl_purity >= 1"),
    ("vh_vv", "vh_vv", "source = 'S1'")
]
_SERIES_SQL = ", ".join(
    f"{steady_sql(f'avg(round({c} + {TIE}, 5)) FILTER ({w})')} AS {n}, "
    f"{steady_sql(f'quantile_cont(round({c} + {TIE}, 5), 0.25) FILTER ({w})')} AS {n}_p25, "
    f"{steady_sql(f'quantile_cont(round({c} + {TIE}, 5), 0.75) FILTER ({w})')} AS {n}_p75"
    for n, c, w in _SERIES_PARTS
)
_SEEN = "(source = 'S1' OR scl_purity >= 1)"


def series(df, *keys):
    """Mean and quartiles per date of both sensors, in one aggregation over the dates of either.

    Values are taken to five decimals (an error of 5e-6 at most), so a date's state is its counts of at most some
    200,000 different index values, however many points were seen on it.
    """
    columns = []
    for name, c, where in _SERIES_PARTS:
        value = F.when(F.expr(where), F.round(F.col(c) + TIE, 5))
        columns += [
            F.avg(value).alias(name), F.percentile(value, F.lit(0.25)).alias(f"{name}_p25"),
            F.percentile(value, F.lit(0.75)).alias(f"{name}_p75")
        ]
    return steady(ob.mixed(df).groupBy(*keys, "date").agg(*columns), [*keys, "date"])


@R.add("agg_17", with_obs() + f"SELECT date, {_SERIES_SQL} FROM obs WHERE {_SEEN} GROUP BY date")
def agg_17(spark, d):
    return series(obs(spark, d))


_YEARS = f"""s AS (SELECT region_id, date, year(date) AS year, month(date) AS month, {_SERIES_SQL} FROM obs WHERE {_SEEN} GROUP BY region_id, date),
 ys AS (SELECT region_id, year::INT AS year, round(1e-9 + max(ndvi) FILTER (month BETWEEN 1 AND 5), 6) AS wet_peak, round(1e-9 + min(ndvi) FILTER (month BETWEEN 6 AND 10), 6) AS dry_floor,
   round(avg(vh_vv) FILTER (month BETWEEN 6 AND 10) + 1e-9, 6) AS vhvv_dry, round(max(ndvi_p75 - ndvi_p25) + 1e-9, 6) AS iqr_max, count(*) FILTER (month BETWEEN 1 AND 5 AND ndvi < 0.05) AS n_notes FROM s GROUP BY ALL)"""


def reduced(df):
    """Per region and year: wet peak, dry floor, their difference, dry radar ratio, widest spread and odd dates."""
    s = series(df, "region_id").withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    wet, dry = F.col("month").between(1, 5), F.col("month").between(6, 10)
    out = s.groupBy("region_id", "year").agg(
        F.max(F.when(wet, F.col("ndvi"))).alias("wet_peak"), F.min(F.when(dry, F.col("ndvi"))).alias("dry_floor"),
        F.avg(F.when(dry, F.col("vh_vv"))).alias("vhvv_dry"),
        F.max(F.col("ndvi_p75") - F.col("ndvi_p25")).alias("iqr_max"),
        F.count_if(wet & (F.col("ndvi") < 0.05)).alias("n_notes")
    )
    return steady(out, ["region_id", "year"])


@R.add("agg_18", with_obs(_YEARS) + "SELECT *, round(wet_peak - dry_floor, 6) AS delta FROM ys")
def agg_18(spark, d):
    return reduced(obs(spark, d)).withColumn("delta", F.round(F.col("wet_peak") - F.col("dry_floor"), 6))


_REGION_QA = (
    "s2 AS (SELECT * FROM obs WHERE source = 'S2')",
    "pp AS (SELECT region_id, point_id, count(*) AS n FROM s2 GROUP BY ALL)",
    "pa AS (SELECT region_id, count(*) AS n_points, min(n) AS obs_min, median(n) AS obs_median, max(n) AS obs_max "
    "FROM pp GROUP BY 1)",
    "dp AS (SELECT region_id, sum(c - 1)::BIGINT AS n_dup FROM (SELECT region_id, point_id, date, count(*) AS c FROM "
    "s2 GROUP BY ALL) GROUP BY 1)",
    "fa AS (SELECT region_id, count(*) AS n_obs, (" + " + ".join(f"count(*) FILTER ({b} IS NULL)" for b in BANDS)
    + ") AS n_null, "
    + f"({' + '.join(f'avg({b})' for b in BANDS)}) / {len(BANDS)} AS band_mean, "
    f"({' + '.join(f'stddev_samp({b})' for b in BANDS)}) / {len(BANDS)} AS band_std, "
    + f"greatest({', '.join(f'avg({b})' for b in BANDS)}) AS top, least({', '.join(f'avg({b})' for b in BANDS)}) AS "
    f"bottom FROM s2 GROUP BY 1)",
    "vm AS (SELECT region_id, median(vh) AS vh_median FROM obs WHERE source = 'S1' AND vh IS NOT NULL GROUP BY 1)",
    "qa AS (SELECT region_id, n_points, n_obs, n_dup, obs_min, obs_median, obs_max, n_null, band_mean, band_std, "
    "top, bottom, vh_median FROM (SELECT DISTINCT region_id FROM obs) LEFT JOIN fa USING (region_id) LEFT JOIN pa "
    "USING (region_id) LEFT JOIN dp USING (region_id) LEFT JOIN vm USING (region_id))",
)


@R.add(
    "agg_19",
    with_obs(*_REGION_QA)
    + "SELECT region_id, n_points, n_obs, n_dup, obs_min, obs_median, obs_max, n_null, round(band_mean, 4) AS "
    "band_mean, round(band_std, 4) AS band_std, round(vh_median, 6) AS vh_median FROM qa",
    repeated=True
)
def agg_19(spark, d):
    """Quality of each region's optical rows as delivered, repeated rows included: they are what is looked for."""
    from gridwake.operators.checks import region_tags

    qa = region_tags(obs(spark, d, repeated=True))
    return qa.select(
        "region_id", "n_points", "n_obs", "n_dup", "obs_min", "obs_median", "obs_max", "n_null",
        F.round("band_mean", 4).alias("band_mean"), F.round("band_std", 4).alias("band_std"),
        r6("vh_median", "vh_median")
    )


_CHUNK_SQL = """c AS (SELECT file_id, point_id, date, source, regexp_extract(point_id, '_([0-9]+)$', 1)::INT AS y FROM chunk_rows),
 sh AS (SELECT file_id, count(DISTINCT point_id) AS n_points, count(DISTINCT y) AS n_rows FROM c GROUP BY 1),
 pt AS (SELECT file_id, count(*) FILTER (n1 >= 4) AS n_enough FROM (SELECT file_id, point_id, count(*) FILTER (source = 'S1') AS n1 FROM c GROUP BY ALL) GROUP BY 1),
 dt AS (SELECT file_id, date, count(DISTINCT y) AS cover FROM c WHERE source = 'S1' GROUP BY ALL),
 ju AS (SELECT file_id, count(*) AS n_dates, median(cover) AS cover_median, max(cover) AS cover_max, count(*) FILTER (cover >= 0.95 * n_rows) AS n_complete FROM dt JOIN sh USING (file_id) GROUP BY 1),
 al AS (SELECT file_id, coalesce(n_points, 0) AS n_points, coalesce(n_rows, 0) AS n_rows, coalesce(n_enough, 0) AS n_enough, coalesce(n_dates, 0) AS n_dates, cover_median, cover_max, coalesce(n_complete, 0) AS n_complete
   FROM (SELECT DISTINCT file_id FROM chunk_reports) FULL JOIN sh USING (file_id) LEFT JOIN pt USING (file_id) LEFT JOIN ju USING (file_id))"""


def chunk_quality(spark, d):
    from gridwake.operators.checks import chunk_completeness

    return chunk_completeness(table(spark, d, "chunk_rows"), ["file_id"], listed=table(spark, d, "chunk_reports"))


@R.add("agg_20", "WITH " + _CHUNK_SQL + " SELECT * FROM al")
def agg_20(spark, d):
    return chunk_quality(spark, d).drop("verdict")


@R.add(
    "agg_21",
    "SELECT date_trunc('month', date)::DATE AS month, count(DISTINCT item_id) AS n_scenes, count(DISTINCT date) AS "
    "n_dates FROM observations GROUP BY 1"
)
def agg_21(spark, d):
    return table(spark, d, "observations").groupBy(F.trunc("date", "month").alias("month")).agg(
        F.countDistinct("item_id").alias("n_scenes"), F.countDistinct("date").alias("n_dates")
    )


@R.add(
    "agg_22",
    with_obs()
    + "SELECT round(lat, 1) AS band, count(*) AS n_obs, count(DISTINCT point_id) AS n_points, round(count(*) / "
    "count(DISTINCT point_id), 6) AS per_point, round(avg(B08) FILTER (month NOT BETWEEN 4 AND 9), 6) AS wet, "
    "round(avg(B08) FILTER (month BETWEEN 4 AND 9), 6) AS dry, round(avg(B08), 6) AS every FROM obs GROUP BY 1"
)
def agg_22(spark, d):
    dry = F.col("month").between(4, 9)
    return obs(spark, d).groupBy(F.round("lat", 1).alias("band")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.countDistinct("point_id").alias("n_points"),
        r6(F.count(F.lit(1)) / F.countDistinct("point_id"), "per_point"), r6(F.avg(F.when(~dry, F.col("B08"))), "wet"),
        r6(F.avg(F.when(dry, F.col("B08"))), "dry"), r6(F.avg("B08"), "every")
    )


@R.add(
    "agg_23",
    with_obs(_YEARLY, "p AS (SELECT point_id, round(min(lat), 1) AS band FROM obs GROUP BY 1)")
    + "SELECT band, round(median(score) + 1e-9, 6) AS score_median, round(stddev_samp(score), 6) AS score_std FROM y "
    "JOIN p USING (point_id) GROUP BY 1"
)
def agg_23(spark, d):
    bands = obs(spark, d).groupBy("point_id").agg(F.round(F.min("lat"), 1).alias("band"))
    return yearly(spark, d).join(bands, "point_id").groupBy("band").agg(
        r6(F.median("score") + TIE, "score_median"), r6(F.stddev_samp("score"), "score_std")
    )


@R.add(
    "agg_24",
    with_obs()
    + "SELECT point_id, count(*) AS n, round(avg(doy), 6) AS doy_mean, round(stddev_pop(doy), 6) AS doy_std, "
    "min(doy) AS doy_min, max(doy) AS doy_max, max(doy) - min(doy) AS doy_range, count(*) FILTER (doy >= 305 OR doy "
    "<= 90) AS n_wet, count(*) FILTER (doy BETWEEN 121 AND 273) AS n_dry, round(avg(B11), 6) AS b11_mean, "
    "round(stddev_pop(B11), 6) AS b11_std FROM obs WHERE source = 'S2' GROUP BY 1"
)
def agg_24(spark, d):
    doy = F.col("doy")
    return obs(spark, d).where("source = 'S2'").groupBy("point_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(doy), "doy_mean"), r6(F.stddev_pop(doy), "doy_std"),
        F.min(doy).alias("doy_min"), F.max(doy).alias("doy_max"), (F.max(doy) - F.min(doy)).alias("doy_range"),
        F.count_if((doy >= 305) | (doy <= 90)).alias("n_wet"), F.count_if(doy.between(121, 273)).alias("n_dry"),
        r6(F.avg("B11"), "b11_mean"), r6(F.stddev_pop("B11"), "b11_std")
    )


@R.add(
    "agg_25",
    with_obs(
        "k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY i_ndvi) - 1 AS k, count(i_ndvi) OVER "
        "(PARTITION BY point_id) AS n FROM obs WHERE "
        + GOOD + " AND i_ndvi IS NOT NULL)"
    )
    + "SELECT point_id, round(max(i_ndvi) FILTER (k = round(0.05 * (n - 1))), 6) AS p5, round(max(i_ndvi) FILTER (k "
    "= round(0.95 * (n - 1))), 6) AS p95, round(stddev_samp(i_ndvi), 6) AS std, count(*) AS n FROM k GROUP BY point_id"
)
def agg_25(spark, d):
    """Percentiles by the nearest rank."""
    order, every = Window.partitionBy("point_id").orderBy("i_ndvi"), Window.partitionBy("point_id")
    k = ob.optical(obs(spark, d)).where("i_ndvi IS NOT NULL").withColumn(
        "k", F.row_number().over(order) - 1
    ).withColumn("n", F.count(F.lit(1)).over(every))
    nearest = lambda f: r6(
        F.max(F.when(F.col("k") == F.round(F.lit(f) * (F.col("n") - 1)), F.col("i_ndvi"))), f"p{round(f * 100)}"
    )
    return k.groupBy("point_id").agg(
        nearest(0.05), nearest(0.95), r6(F.stddev_samp("i_ndvi"), "std"), F.count(F.lit(1)).alias("n")
    )


@R.add(
    "agg_26",
    "SELECT tile_id, count(*) AS n FROM observations WHERE tile_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, tile_id LIMIT 1"
)
def agg_26(spark, d):
    return table(spark, d, "observations").where("tile_id IS NOT NULL").groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "tile_id").limit(1)


@R.add(
    "agg_27",
    with_obs()
    + "SELECT a.tile_id, a.year, count(*) AS n, round(median(round(a.B08 / b.B08 + 1e-9, 5)), 6) AS ratio FROM obs a "
    "JOIN obs b ON a.point_id = b.point_id AND a.date = b.date AND a.tile_id != b.tile_id WHERE a.B08 > 0 AND b.B08 "
    "> 0 GROUP BY ALL"
)
def agg_27(spark, d):
    side = obs(spark, d).where("B08 > 0 AND tile_id IS NOT NULL").select("point_id", "date", "tile_id", "year", "B08")
    pairs = side.alias("a").join(side.alias("b"), ["point_id", "date"]).where("a.tile_id <> b.tile_id")
    return pairs.groupBy("a.tile_id", "a.year").agg(
        F.count(F.lit(1)).alias("n"), r6(F.median(F.round(F.col("a.B08") / F.col("b.B08") + TIE, 5)), "ratio")
    )


@R.add(
    "agg_28",
    "SELECT site, signal, min(median) AS weighted_median FROM (SELECT site, signal, median, sum(n_pixels) OVER "
    "(PARTITION BY site, signal ORDER BY median) AS c, sum(n_pixels) OVER (PARTITION BY site, signal) AS t FROM "
    "class_stats WHERE median IS NOT NULL) WHERE c * 2 >= t GROUP BY ALL"
)
def agg_28(spark, d):
    return ev.weighted_median(table(spark, d, "class_stats"), ["site", "signal"], "median", "n_pixels")


@R.add(
    "agg_29",
    with_obs()
    + "SELECT round(lon * 10000)::BIGINT AS cx, round(lat * 10000)::BIGINT AS cy, date, count(DISTINCT tile_id) AS "
    "n_tiles FROM obs GROUP BY ALL HAVING count(DISTINCT tile_id) > 1"
)
def agg_29(spark, d):
    return obs(spark, d).groupBy(
        F.round(F.col("lon") * 10000).cast("long").alias("cx"), F.round(F.col("lat") * 10000).cast("long").alias("cy"),
        "date"
    ).agg(F.countDistinct("tile_id").alias("n_tiles")).where("n_tiles > 1")


@R.add(
    "agg_30",
    with_obs()
    + f"SELECT round(avg(i_ndvi), 6) AS mean, round(greatest(stddev_samp(i_ndvi), 1e-6), 6) AS std, count(i_ndvi) AS "
    f"n FROM obs WHERE {GOOD}"
)
def agg_30(spark, d):
    return ob.optical(obs(spark, d)).agg(
        r6(F.avg("i_ndvi"), "mean"), r6(F.greatest(F.stddev_samp("i_ndvi"), F.lit(1e-6)), "std"),
        F.count("i_ndvi").alias("n")
    )


_WAVE = f"""u AS (SELECT point_id, year, doy, obs_id, i_ndvi * scl_purity AS w FROM obs WHERE source = 'S2' AND scl_purity >= 0.3 AND doy BETWEEN 200 AND 340 AND i_ndvi IS NOT NULL),
 pk AS (SELECT point_id, year, max(w) AS peak, arg_max(doy, struct_pack(w := w, a := -doy)) AS peak_doy, count(*) FILTER (w >= 0.075) AS long FROM u GROUP BY ALL HAVING max(w) >= 0.15)"""


@R.add(
    "agg_31",
    with_obs(_WAVE)
    + "SELECT point_id, round(max(peak), 6) AS peak_value, arg_max(peak_doy, struct_pack(p := peak, y := -year)) AS "
    "peak_doy, round(avg(long), 6) AS spike_duration, round(avg(peak_doy), 6) AS peak_doy_mean, "
    "round(stddev_pop(peak_doy), 6) AS peak_doy_sd, count(*) AS years_detected FROM pk GROUP BY 1 HAVING count(*) >= 2"
)
def agg_31(spark, d):
    df = obs(spark, d).where("source = 'S2'")
    return rounded(wi.waveform(df, "i_ndvi", "scl_purity", min_years=2), ["point_id"])


@R.add(
    "agg_32",
    with_obs()
    + "SELECT point_id, round(coalesce(avg(scl_purity * (aot / 100.0::DOUBLE) * (view_zenith / 100.0::DOUBLE) * "
    "(sun_zenith / 100.0::DOUBLE)), 0), 6) AS mean_quality FROM obs GROUP BY 1"
)
def agg_32(spark, d):
    quality = indices.quality(
        {
            "clear": F.col("scl_purity").cast("double"),
            **{n: F.col(n) / 100.0 for n in ("aot", "view_zenith", "sun_zenith")}
        }
    )
    return obs(spark, d).groupBy("point_id").agg(r6(F.coalesce(F.avg(quality), F.lit(0.0)), "mean_quality"))


@R.add(
    "agg_33",
    with_obs()
    + "SELECT point_id, year, round(CASE WHEN coalesce(sum(scl_purity) FILTER (i_ndvi IS NOT NULL), 0) = 0 THEN "
    "avg(i_ndvi) ELSE sum(scl_purity * i_ndvi) / sum(scl_purity) FILTER (i_ndvi IS NOT NULL) END, 6) AS composite "
    "FROM obs WHERE source = 'S2' GROUP BY ALL"
)
def agg_33(spark, d):
    df = obs(spark, d).where("source = 'S2'").withColumn("w", F.col("scl_purity").cast("double"))
    return rounded(wi.composite(df, wi.WINDOW, "i_ndvi", "w"), wi.WINDOW)


@R.add(
    "agg_34",
    with_obs()
    + f"SELECT label, count(i_ndvi) AS n, round(avg(i_ndvi), 6) AS mean, {q('i_ndvi', 0.5)} AS median, "
    f"{q('i_ndvi', 0.25)} AS p25, {q('i_ndvi', 0.75)} AS p75, round(quantile_cont(i_ndvi, 0.75) - "
    f"quantile_cont(i_ndvi, 0.25), 6) AS iqr FROM obs WHERE {GOOD} GROUP BY label"
)
def agg_34(spark, d):
    """Few groups with most rows each: exact percentiles from value counts, by the distributed sort."""
    from gridwake.operators.order_stats import percentiles, value_counts

    df = ob.optical(obs(spark, d))
    counts = value_counts(df, ["label"], "i_ndvi")
    quartiles = percentiles(counts, ["label"], {"median": 0.5, "p25": 0.25, "p75": 0.75})
    means = counts.groupBy("label").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return quartiles.join(means, "label").select(
        "label", F.col("n_rows").alias("n"), r6("mean", "mean"), r6("median", "median"), r6("p25", "p25"),
        r6("p75", "p75"), r6(F.col("p75") - F.col("p25"), "iqr")
    )


@R.add("agg_35", with_obs() + "SELECT source, doy, count(*) AS n FROM obs GROUP BY ALL")
def agg_35(spark, d):
    return obs(spark, d).groupBy("source", "doy").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "agg_36",
    with_obs(
        "h AS (SELECT doy, count(*) AS n FROM obs GROUP BY 1)", "g AS (SELECT unnest(range(1, 367))::INT AS doy)",
        "m AS (SELECT avg(1.0::DOUBLE / n) AS m FROM h)"
    )
    + "SELECT doy, round(coalesce(1.0::DOUBLE / n / m, 1.0), 6) AS weight FROM g LEFT JOIN h USING (doy), m"
)
def agg_36(spark, d):
    h = obs(spark, d).groupBy("doy").agg(F.count(F.lit(1)).alias("n"))
    inverse = h.select("doy", (F.lit(1.0) / F.col("n")).alias("w"))
    scaled = inverse.withColumn("weight", F.col("w") / F.avg("w").over(Window.partitionBy()))  # 366 rows at most
    days = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"))
    return days.join(scaled, "doy", "left").select("doy", F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"))


@R.add(
    "agg_37",
    with_obs()
    + f"SELECT label, least((doy - 1) // 10, 36)::BIGINT AS bin, round(avg(i_mavi), 6) AS mean, "
    f"round(stddev_pop(i_mavi), 6) AS std, count(i_mavi) AS n FROM obs WHERE {GOOD} GROUP BY ALL HAVING "
    f"count(i_mavi) >= 3"
)
def agg_37(spark, d):
    return ob.optical(obs(spark, d)).groupBy(
        "label", F.least(F.floor((F.col("doy") - 1) / 10), F.lit(36)).alias("bin")
    ).agg(
        r6(F.avg("i_mavi"), "mean"), r6(F.stddev_pop("i_mavi"), "std"), F.count("i_mavi").alias("n")
    ).where("n >= 3")


@R.add(
    "agg_38",
    with_obs()
    + f"SELECT label, round(avg(i_mavi), 6) AS mean, round(stddev_samp(i_mavi), 6) AS std, round(min(i_mavi), 6) AS "
    f"low FROM obs WHERE {GOOD} AND doy BETWEEN 121 AND 304 GROUP BY 1"
)
def agg_38(spark, d):
    return ob.optical(obs(spark, d)).where(wi.flags_dry(F.col("doy"))).groupBy("label").agg(
        r6(F.avg("i_mavi"), "mean"), r6(F.stddev_samp("i_mavi"), "std"), r6(F.min("i_mavi"), "low")
    )


_SCENE = with_obs(
    _YEARLY,
    "l AS (SELECT point_id, min(label) AS label FROM obs GROUP BY 1)",
    "f AS (SELECT point_id, max(score) AS score FROM y GROUP BY 1)",
    "j AS (SELECT label, score FROM f LEFT JOIN l USING (point_id) WHERE score IS NOT NULL)",
    "k AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM j)",
)


@R.add("agg_39", _SCENE + """SELECT label AS part, count(*) AS n, round(avg(score), 6) AS mean, round(median(score) + 1e-9, 6) AS median, round(stddev_samp(score), 6) AS std, NULL::DOUBLE AS p75, NULL::DOUBLE AS p90, NULL::DOUBLE AS p95 FROM j WHERE label IN ('presence', 'absence') GROUP BY label
UNION ALL SELECT 'scene', count(*), round(avg(score), 6), round(median(score) + 1e-9, 6), round(stddev_samp(score), 6), """ + ", ".join(f"max(score) FILTER (i = floor({f} * (n - 1) + 0.5))" for f in (0.75, 0.90, 0.95)) + " FROM k")
def agg_39(spark, d):
    """Mean, median and deviation of the points' scores per class, and of the whole scene with its upper percentiles.

    Percentiles are order statistics by the nearest rank, from the distributed sort of the scores' counts.
    """
    from gridwake.operators.order_stats import order_statistics, percentiles, value_counts

    df = obs(spark, d)
    labels = df.groupBy("point_id").agg(F.min("label").alias("label"))
    scores = yearly(spark, d).groupBy("point_id").agg(
        F.max("score").alias("score")
    ).join(labels, "point_id", "left").where("score IS NOT NULL")
    parts = F.array_compact(F.array(F.lit("scene"), F.when(F.col("label").isin("presence", "absence"), F.col("label"))))
    tall = scores.select(F.explode(parts).alias("part"), "score")
    counts = value_counts(tall, ["part"], "score")
    nearest = lambda f: lambda n: F.floor(F.lit(f) * (n - 1) + 0.5) + 1
    upper = order_statistics(
        counts.where("part = 'scene'"), ["part"], {f"p{p}": nearest(p / 100) for p in (75, 90, 95)}
    ).drop("n_rows")
    middle = percentiles(counts, ["part"], {"median": 0.5}).drop("n_rows")
    facts = tall.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean"), r6(F.stddev_samp("score"), "std")
    )
    return facts.join(middle, "part").join(upper, "part", "left").select(
        "part", "n", "mean", r6(F.col("median") + TIE, "median"), "std", "p75", "p90", "p95"
    )


@R.add(
    "agg_40",
    with_obs(
        "w AS (SELECT point_id, year, region_id, min(lat) AS lat, min(label) AS label, count(*) FILTER (source = "
        "'S2') AS n2, count(*) FILTER (source = 'S1') AS n1 FROM obs GROUP BY point_id, year, region_id)",
        "pt AS (SELECT point_id, min(lat) AS lat, min(label) AS label FROM w GROUP BY 1)",
        "sp AS (SELECT point_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY lat, point_id) <= "
        "greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.2)) THEN 'validation' ELSE 'train' END AS split "
        "FROM pt)"
    )
    + "SELECT regexp_replace(CASE WHEN regexp_matches(region_id, '_(presence|absence)') THEN "
    "regexp_extract(region_id, '^(.+?)_(presence|absence)', 1) ELSE region_id END, '_val$', '') AS site, CASE WHEN "
    "contains(region_id, '_presence') THEN 'presence' WHEN contains(region_id, '_absence') THEN 'absence' ELSE "
    "'unknown' END AS class, split, count(*) AS n, count(*) FILTER (n2 >= 40 AND n1 >= 20) AS kept, count(*) FILTER "
    "(NOT (n2 >= 40 AND n1 >= 20)) AS dropped FROM w JOIN sp USING (point_id) GROUP BY ALL"
)
def agg_40(spark, d):
    """Windows kept and dropped for their number of readings, by site, class and split."""
    w = obs(spark, d).groupBy("point_id", "year", "region_id").agg(
        F.min("lat").alias("lat"), F.min("label").alias("label"), F.count_if(F.col("source") == "S2").alias("n2"),
        F.count_if(F.col("source") == "S1").alias("n1")
    )
    splits = ev.southern_split(
        w.groupBy("point_id").agg(F.min("lat").alias("lat"), F.min("label").alias("label")), 0.2
    ).select("point_id", "split")
    kept = (F.col("n2") >= 40) & (F.col("n1") >= 20)
    return w.join(splits, "point_id").groupBy(
        ids.site(F.col("region_id")).alias("site"), ids.site_class(F.col("region_id")).alias("class"), "split"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


@R.add("agg_41", with_obs() + "SELECT point_id, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY 1")
def agg_41(spark, d):
    return obs(spark, d).groupBy("point_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))


@R.add(
    "agg_42",
    with_obs()
    + "SELECT point_id, year, round(stddev_pop(vh_db), 6) AS dry_std, round(stddev_pop(vh_db) / "
    "nullif(abs(avg(vh_db)), 0), 6) AS dry_cv FROM obs WHERE source = 'S1' AND doy BETWEEN 121 AND 304 GROUP BY ALL "
    "HAVING count(vh_db) >= 2"
)
def agg_42(spark, d):
    dry = ob.radar(obs(spark, d)).where(wi.flags_dry(F.col("doy"))).groupBy(*wi.WINDOW)
    return dry.agg(
        r6(F.stddev_pop("vh_db"), "dry_std"), r6(F.try_divide(F.stddev_pop("vh_db"), F.abs(F.avg("vh_db"))), "dry_cv"),
        F.count("vh_db").alias("n")
    ).where("n >= 2").drop("n")


_WIDE = ("i_ndvi", "i_mavi", "i_ndre", "i_ci_re", "i_ndsvi", "i_b12_b11")


@R.add(
    "agg_43",
    with_obs() + "SELECT point_id, year, "
    + ", ".join(f"round(quantile_cont({c}, 0.05) FILTER ({GOOD}), 6) AS {c}_p05" for c in _WIDE)
    + ", round(avg(vh_db) FILTER (doy BETWEEN 121 AND 304), 6) AS vh_dry, round(avg(vv_db) FILTER (doy BETWEEN 121 "
    "AND 304), 6) AS vv_dry, round(avg(rvi) FILTER (doy BETWEEN 121 AND 304), 6) AS rvi_dry FROM obs GROUP BY ALL "
    "HAVING count(*) FILTER (source = 'S2') >= 10"
)
def agg_43(spark, d):
    good, dry = F.expr(GOOD), wi.flags_dry(F.col("doy"))
    wide = obs(spark, d).groupBy(*wi.WINDOW).agg(
        *[r6(F.percentile(F.when(good, F.col(c)), F.lit(0.05)), f"{c}_p05") for c in _WIDE],
        *[
            r6(F.avg(F.when(dry, F.col(c))), n) for c,
            n in (("vh_db", "vh_dry"), ("vv_db", "vv_dry"), ("rvi", "rvi_dry"))
        ],
        F.count_if(F.col("source") == "S2").alias("n2")
    )
    return wide.where("n2 >= 10").drop("n2")


# ---- window functions ---------------------------------------------------------------------------------------------


@R.add(
    "win_01",
    with_obs()
    + "SELECT obs_id, round(quantile_cont(vh, 0.5) OVER w, 8) AS vh, round(quantile_cont(vv, 0.5) OVER w, 8) AS vv "
    "FROM obs WHERE source = 'S1' WINDOW w AS (PARTITION BY point_id ORDER BY date, obs_id ROWS BETWEEN 2 PRECEDING "
    "AND 2 FOLLOWING)"
)
def win_01(spark, d):
    df = ob.radar(obs(spark, d)).select("obs_id", "point_id", "date", "vh", "vv")
    return wi.despeckle(df, ["vh", "vv"], 5).select(
        "obs_id", F.round("vh", 8).alias("vh"), F.round("vv", 8).alias("vv")
    )


@R.add(
    "win_02",
    with_obs()
    + "SELECT obs_id, place::INT AS place FROM (SELECT obs_id, row_number() OVER (PARTITION BY point_id, year ORDER "
    "BY date, source NULLS FIRST, item_id NULLS FIRST, obs_id, loaded_at) AS place FROM obs) WHERE place <= 32"
)
def win_02(spark, d):
    return wi.earliest(obs(spark, d), 32).select("obs_id", "place")


@R.add(
    "win_03",
    with_obs(_YEARLY, "s AS (SELECT point_id, max(score) AS score FROM y GROUP BY 1)")
    + "SELECT point_id, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, "
    "point_id)::INT END AS rank FROM s"
)
def win_03(spark, d):
    scores = yearly(spark, d).groupBy("point_id").agg(F.max("score").alias("score"))
    return scoring.ranking(
        scores.select("point_id"), scores, scores.select("point_id", F.lit(None).cast("string").alias("label"))
    ).select("point_id", "rank")


_BEST = "SELECT obs_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id, date ORDER BY scl_purity DESC NULLS LAST, item_id ASC NULLS LAST, obs_id, loaded_at) AS n FROM obs WHERE source = 'S2') WHERE n = 1"


@R.add("win_04", with_obs() + _BEST)
def win_04(spark, d):
    return ob.best_per_day(obs(spark, d)).where("source = 'S2'").select("obs_id")


@R.add("win_05", with_obs() + _BEST + " UNION ALL SELECT obs_id FROM obs WHERE source != 'S2'")
def win_05(spark, d):
    return ob.best_per_day(obs(spark, d)).select("obs_id")


@R.add(
    "win_06",
    with_obs(
        "b AS (SELECT * FROM obs SEMI JOIN (" + _BEST
        + ") k USING (obs_id) WHERE i_mavi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY "
        "loaded_at) = 1)"
    )
    + "SELECT obs_id, round(CASE WHEN date_diff('day', lag(date) OVER w, date) > 0 THEN (i_mavi - lag(i_mavi) OVER "
    "w) / date_diff('day', lag(date) OVER w, date) END, 8) AS rate FROM b WINDOW w AS (PARTITION BY point_id ORDER "
    "BY date, obs_id)"
)
def win_06(spark, d):
    best = ob.best_per_day(obs(spark, d)).where("source = 'S2' AND i_mavi IS NOT NULL")
    return wi.rate_of_change(best, "i_mavi").select("obs_id", F.round("rate", 8).alias("rate"))


@R.add("win_07", with_obs() + "SELECT count(*) AS n_windows FROM (SELECT DISTINCT point_id, year FROM obs)")
def win_07(spark, d):
    """Window starts, counted where the key changes in each point's order of time."""
    order = Window.partitionBy("point_id").orderBy("date")
    starts = obs(spark, d).withColumn("before", F.lag("year").over(order))
    return starts.agg(F.count_if(F.col("before").isNull() | (F.col("before") != F.col("year"))).alias("n_windows"))


@R.add(
    "win_08",
    with_obs()
    + "SELECT obs_id, round(coalesce((i_evi - avg(i_evi) OVER w) / greatest(stddev_pop(i_evi) OVER w, 1e-6), 0), 4) "
    "AS z FROM obs WHERE source = 'S2' WINDOW w AS (PARTITION BY point_id, year)"
)
def win_08(spark, d):
    return wi.z_score(
        obs(spark, d).where("source = 'S2'"), wi.WINDOW, "i_evi", "z"
    ).select("obs_id", F.round("z", 4).alias("z"))


@R.add(
    "win_09",
    with_obs("g AS (SELECT avg(i_ndvi) AS m, stddev_samp(i_ndvi) AS s FROM obs WHERE source = 'S2')")
    + "SELECT obs_id, round(coalesce((i_ndvi - m) / s, 0), 4) AS z FROM obs, g WHERE source = 'S2'"
)
def win_09(spark, d):
    df = obs(spark, d).where("source = 'S2'")
    stats = df.agg(F.avg("i_ndvi").alias("m"), F.stddev_samp("i_ndvi").alias("s")).first()  # one row
    return df.select(
        "obs_id",
        F.round(F.coalesce((F.col("i_ndvi") - F.lit(stats["m"])) / F.lit(stats["s"]), F.lit(0.0)), 4).alias("z")
    )


@R.add(
    "win_10",
    with_obs(
        "b AS (SELECT * FROM obs SEMI JOIN (" + _BEST
        + ") k USING (obs_id) WHERE source = 'S2' QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at) = 1)"
    )
    + "SELECT point_id, year, count(*) AS n_obs, list(doy ORDER BY doy, obs_id)[1:16] AS doys, list(round(i_ndvi, 6) "
    "ORDER BY doy, obs_id)[1:16] AS \"values\" FROM b GROUP BY ALL"
)
def win_10(spark, d):
    best = ob.best_per_day(obs(spark, d)).where("source = 'S2'")
    return wi.sequences(best, F.round("i_ndvi", 6), 16)


@R.add("win_11")
def win_11(spark, d):
    return wi.subsample(
        ob.optical(obs(spark, d)).select("obs_id", "point_id", "year", "date", "doy", "source"), 16
    ).select("obs_id", "point_id", "year", "doy")


@R.add("win_12")
def win_12(spark, d):
    return wi.subsample(
        ob.mixed(obs(spark, d)).select("obs_id", "point_id", "year", "date", "doy", "source"), 64, all_optical=True
    ).select("obs_id", "point_id", "year", "doy", "source")


@R.add("win_13")
def win_13(spark, d):
    return wi.subsample(
        ob.mixed(obs(spark, d)).select("obs_id", "point_id", "year", "date", "doy", "source"), 8
    ).groupBy("point_id", "year").agg(F.sort_array(F.collect_list("doy")).alias("doys"))


@R.add("win_14", "SELECT count(DISTINCT point_id) AS runs, count(DISTINCT point_id) AS points FROM observations")
def win_14(spark, d):
    return wi.is_one_run(
        table(spark, d, "observations").select("point_id", "date", "obs_id"), ["point_id", "date", "obs_id"]
    )


_SITE_AUC = """sc AS (SELECT regexp_replace(CASE WHEN regexp_matches(region_id, '_(presence|absence)') THEN regexp_extract(region_id, '^(.+?)_(presence|absence)', 1) ELSE region_id END, '_val$', '') AS site, CASE WHEN label = 'presence' THEN 1 ELSE 0 END AS label, point_id, round(avg(i_ndvi), 6) AS score FROM obs WHERE source = 'S2' AND scl_purity >= 1 GROUP BY ALL),
 rk AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2 AS r FROM sc WHERE score IS NOT NULL),
 au AS (SELECT site, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0), 6) AS auc FROM rk GROUP BY site)"""


def labelled_scores(spark, d):
    df = ob.optical(obs(spark, d))
    return df.groupBy(
        ids.site(F.col("region_id")).alias("site"), F.when(F.col("label") == "presence", 1).otherwise(0).alias("label"),
        "point_id"
    ).agg(r6(F.avg("i_ndvi"), "score"))


def site_auc(spark, d):
    return ev.auroc(labelled_scores(spark, d), ["site"]).select("site", "n_pos", "n_neg", r6("auc", "auc"))


@R.add(
    "win_15",
    with_obs(
        _SITE_AUC,
        "o AS (SELECT auc, row_number() OVER (ORDER BY auc, site) AS k, count(*) OVER () AS n FROM au WHERE auc IS "
        "NOT NULL)"
    )
    + "SELECT round(avg(auc), 6) AS tail_mean, count(*) AS n_tail FROM o WHERE k <= greatest(1, ceil(n * 0.25))"
)
def win_15(spark, d):
    return ev.tail_mean(
        site_auc(spark, d).select("site", "auc"), "auc", 0.25
    ).select(r6("tail_mean", "tail_mean"), "n_tail")


@R.add("win_16", with_obs(_SITE_AUC) + "SELECT point_id, round(r, 6) AS r FROM rk")
def win_16(spark, d):
    return ev.average_rank(
        labelled_scores(spark, d), "score", ["site"], "r"
    ).select("point_id", F.round("r", 6).alias("r"))


_CURVE = """ct AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM sc WHERE score IS NOT NULL GROUP BY 1),
 cu AS (SELECT threshold, (sum(p) OVER (ORDER BY threshold DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY threshold DESC))::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS pos, (sum(n) OVER ())::BIGINT AS neg FROM ct)"""


@R.add(
    "win_17",
    with_obs(_SITE_AUC, _CURVE)
    + "SELECT threshold, round(tp / nullif(pos, 0) + 1 - fp / nullif(neg, 0), 9) AS j FROM cu ORDER BY j DESC, "
    "threshold LIMIT 1"
)
def win_17(spark, d):
    return ev.youden(labelled_scores(spark, d))


QUERIES, SQL = R.queries, R.sql
