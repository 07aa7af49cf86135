"""Splits, evaluation of signals, models and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwake.functions import ids, indices
from gridwake.operators import checks
from gridwake.operators import evaluation as ev
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.operators import windows as wi
from gridwake.plans.base import BANDS, BOX, GOOD, obs, with_obs, table
from gridwake.plans.formulas import unit, unit_sql
from gridwake.plans.registry import Registry
from gridwake.plans.statistics import IS_RADAR, OPTICAL, RADAR, _CHUNK_SQL, _CURVE, TIE, _REGION_QA, annual_summaries, summary_sql, _SITE_AUC, _WAVE, chunk_quality, labelled_scores, rounded, site_auc

R = Registry()
r6 = lambda c, name: F.round(c, 6).alias(name)
_POINTS = "pl AS (SELECT point_id, min(lat) AS lat, min(label) AS label, min(region_id) AS region_id FROM obs GROUP BY 1)"


def points(spark, d):
    return obs(spark, d).groupBy("point_id").agg(
        F.min("lat").alias("lat"), F.min("label").alias("label"), F.min("region_id").alias("region_id")
    )


@R.add(
    "ml_01",
    with_obs(_POINTS)
    + "SELECT point_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY lat, point_id) <= greatest(1, "
    "floor(count(*) OVER (PARTITION BY label) * 0.2)) THEN 'validation' ELSE 'train' END AS split FROM pl"
)
def ml_01(spark, d):
    return ev.southern_split(points(spark, d), 0.2).select("point_id", "split")


@R.add(
    "ml_02",
    with_obs(_POINTS)
    + "SELECT point_id, CASE WHEN region_id IN ('luninya_spur_presence_01', 'quoribo_bend_presence_01') THEN "
    "'validation' ELSE 'train' END AS split FROM pl"
)
def ml_02(spark, d):
    return ev.hold_out(
        points(spark, d), "region_id", ["luninya_spur_presence_01", "quoribo_bend_presence_01"]
    ).select("point_id", "split")


@R.add(
    "ml_03",
    with_obs(_POINTS)
    + "SELECT point_id, CASE WHEN starts_with(region_id, 'luninya_spur_') THEN 'validation' ELSE 'train' END AS "
    "split FROM pl"
)
def ml_03(spark, d):
    return ev.hold_out(
        points(spark, d).withColumn("site", ids.site(F.col("region_id"))), "site", ["luninya_spur"]
    ).select("point_id", "split")


@R.add(
    "ml_04",
    with_obs(
        _SITE_AUC,
        "ra AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM "
        "sc WHERE score IS NOT NULL)"
    )
    + "SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(r) FILTER (label = 1) - "
    "sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM ra"
)
def ml_04(spark, d):
    return ev.auroc(labelled_scores(spark, d), []).select("n_pos", "n_neg", r6("auc", "auc"))


@R.add("ml_05", with_obs(_SITE_AUC) + "SELECT * FROM au")
def ml_05(spark, d):
    return site_auc(spark, d)


@R.add(
    "ml_06",
    with_obs(_SITE_AUC, _CURVE)
    + "SELECT threshold, round(2 * tp / (tp + fp + pos), 9) AS f1, tp, fp, pos - tp AS fn, neg - fp AS tn, round(tp "
    "/ (tp + fp), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall FROM cu ORDER BY f1 DESC, threshold DESC LIMIT 1"
)
def ml_06(spark, d):
    return rounded(ev.best_f1(labelled_scores(spark, d)), ["threshold", "f1"])


@R.add(
    "ml_07",
    with_obs(_SITE_AUC)
    + "SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM (SELECT "
    "least(floor(least(greatest(score, 0), 1) * 10), 9) AS bin, count(*) AS n, avg(least(greatest(score, 0), 1)) AS "
    "p, avg(label) AS y FROM sc WHERE score IS NOT NULL GROUP BY 1)"
)
def ml_07(spark, d):
    df = labelled_scores(spark, d).withColumn("score", indices.clamp(F.col("score"), 0.0, 1.0))
    return ev.calibration_error(df).select(r6("ece", "ece"), "n")


@R.add("ml_08", with_obs(_SITE_AUC) + "SELECT site, auc, auc >= 0.85 AS passed FROM au")
def ml_08(spark, d):
    return site_auc(spark, d).select("site", "auc", (F.col("auc") >= 0.85).alias("passed"))


_SIGNALS = {"ndvi": "i_ndvi", "mavi": "i_mavi", "ndre": "i_ndre", "vh": "vh_db"}
_SITE_OF = "regexp_replace(CASE WHEN regexp_matches(region_id, '_(presence|absence)') THEN regexp_extract(region_id, '^(.+?)_(presence|absence)', 1) ELSE region_id END, '_val$', '')"
#: Presence windows darker than this in the dry season are left out, and windows with fewer readings of a signal.
LEAST_VH, LEAST_OBS = -16.0, 6


def one_row(*frames):
    """Frames of one row each, beside each other."""
    union = ob.merged(*frames)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def signal_windows(spark, d, signals=_SIGNALS):
    """``(signal, site, label, point_id, year, v)``: each signal's 5th percentile per window, after the evaluation's filters.

    One aggregation gives all signals; the rows are stacked after it, when there is one per window.
    """
    dry = wi.flags_dry(F.col("doy"))
    used = obs(spark, d).where(F.expr(f"({GOOD}) OR source = 'S1'"))
    columns = [
        x for n, c in signals.items() for x in (r6(F.percentile(c, F.lit(0.05)), f"v_{n}"), F.count(c).alias(f"n_{n}"))
    ]
    w = used.groupBy(*wi.WINDOW).agg(
        F.min("region_id").alias("region_id"), F.min("label").alias("label"),
        F.avg(F.when(dry, F.col("vh_db"))).alias("vh_dry"), *columns
    )
    w = w.where("label IN ('presence', 'absence')").where(
        f"NOT (label = 'presence' AND coalesce(vh_dry < {LEAST_VH}, false))"
    )
    stacked = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("signal"), F.col(f"v_{n}").alias("v"), F.col(f"n_{n}").alias("n"))
                for n in signals
            ]
        )
    )
    tall = w.select(ids.site(F.col("region_id")).alias("site"), "label", *wi.WINDOW, stacked.alias("e"))
    return tall.where(f"e.n >= {LEAST_OBS} AND e.v IS NOT NULL").select("e.signal", "site", "label", *wi.WINDOW, "e.v")


def _signal_sql(signals=_SIGNALS):
    columns = ", ".join(f"round(quantile_cont({c}, 0.05), 6) AS v_{n}, count({c}) AS n_{n}" for n, c in signals.items())
    stacked = " UNION ALL ".join(
        f"SELECT '{n}' AS signal, site, label, point_id, year, v_{n} AS v FROM wk WHERE n_{n} >= {LEAST_OBS} AND "
        f"v_{n} IS NOT NULL"
        for n in signals
    )
    return (
        f"wd AS (SELECT point_id, year, min(region_id) AS region_id, min(label) AS label, avg(vh_db) FILTER (doy "
        f"BETWEEN 121 AND 304) AS vh_dry, {columns} FROM obs WHERE ({GOOD}) OR source = 'S1' GROUP BY point_id, year)",
        f"wk AS (SELECT *, {_SITE_OF} AS site FROM wd WHERE label IN ('presence', 'absence') AND NOT (label = "
        f"'presence' AND coalesce(vh_dry < {LEAST_VH}, false)))",
        f"sw AS ({stacked})",
    )


def _evaluation_sql(keys):
    by = ", ".join(keys)
    stats = f"count(*) AS n, count(DISTINCT point_id) AS np, avg(v) AS m, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3"
    return (
        f"cs AS (SELECT {by}, label, {stats} FROM sw GROUP BY {by}, label)",
        f"rk AS (SELECT {by}, CASE WHEN label = 'presence' THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY {by} "
        f"ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2 AS r FROM sw)",
        f"au AS (SELECT {by}, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) "
        f"AS auc FROM rk GROUP BY {by})",
        f"jn AS (SELECT {by}, p.n AS n_presence, a.n AS n_absence, p.np AS points_presence, a.np AS points_absence, "
        f"p.m AS mean_presence, a.m AS mean_absence, p.q2 AS median_presence, a.q2 AS median_absence, "
        f"p.q3 - p.q1 AS iqr_presence, a.q3 - a.q1 AS iqr_absence, p.q1 AS p1, p.q3 AS p3, a.q1 AS a1, a.q3 AS a3, "
        f"auc FROM au LEFT JOIN (SELECT * FROM cs WHERE label = 'presence') p USING ({by}) LEFT JOIN (SELECT * FROM "
        f"cs WHERE label = 'absence') a USING ({by}))",
    )


_EVALUATED = "coalesce(n_presence, 0) AS n_presence, coalesce(n_absence, 0) AS n_absence, points_presence, points_absence, " + ", ".join(
    f"round({c} + {TIE}, 6) AS {c}" for k in ("mean", "median", "iqr") for c in (f"{k}_presence", f"{k}_absence")
) + ", CASE WHEN n_presence >= 4 AND n_absence >= 4 AND greatest(p3, a3) - least(p1, a1) > 0 THEN round(greatest(0, least(p3, a3) - greatest(p1, a1)) / (greatest(p3, a3) - least(p1, a1)), 6) END AS overlap, round(auc, 6) AS auc"


def evaluate(df, keys):
    """Per group: the two classes' statistics of a signal, their quartile overlap and the AUROC between them."""
    stats = ev.class_stats(df, keys, "v")
    wide = stats.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("label") == k, F.col("n_pixel_years"))), F.lit(0)).alias(f"n_{k}")
            for k in ("presence", "absence")
        ],
        *[F.max(F.when(F.col("label") == k, F.col("n_pixels"))).alias(f"points_{k}") for k in ("presence", "absence")],
        *[
            r6(F.max(F.when(F.col("label") == k, F.col(c))) + TIE, f"{c}_{k}") for c in ("mean", "median", "iqr")
            for k in ("presence", "absence")
        ],
    )
    overlap = ev.quartile_overlap(stats, keys).select(*keys, r6("overlap", "overlap"))
    area = ev.auroc(
        df.withColumn("y", F.when(F.col("label") == "presence", 1).otherwise(0)), keys, "v", "y"
    ).select(*keys, r6("auc", "auc"))
    return wide.join(overlap, keys).join(area, keys)


for _name, _column in _SIGNALS.items():
    R.add(
        f"ml_09_{_name}",
        with_obs(*_signal_sql({_name: _column}), *_evaluation_sql(["site"])) + f"SELECT site, {_EVALUATED} FROM jn"
    )(
        lambda spark, d, s={_name: _column}: evaluate(signal_windows(spark, d, s), ["site"])
    )


@R.add(
    "fn_25",
    with_obs(*_signal_sql({"evi": "i_evi"}), *_evaluation_sql(["signal"]))
    + f"SELECT overlap, n_presence AS na, n_absence AS nb FROM (SELECT {_EVALUATED} FROM jn)"
)
def fn_25(spark, d):
    """Quartile overlap of one signal over all sites."""
    stats = ev.class_stats(signal_windows(spark, d, {"evi": "i_evi"}), [], "v")
    return ev.quartile_overlap(stats, []).select(r6("overlap", "overlap"), "na", "nb")


_OPTICAL_SIGNALS, _RADAR_SIGNALS = {"ndvi": "i_ndvi", "mavi": "i_mavi"}, {"vh": "vh_db", "rvi": "rvi"}
_PAIRS = (
    "w AS (SELECT point_id, year, min(label) AS label, "
    + ", ".join(f"round(quantile_cont({c}, 0.05) FILTER ({GOOD}), 6) AS o_{n}" for n, c in _OPTICAL_SIGNALS.items())
    + ", "
    + ", ".join(f"round(avg({c}) FILTER (doy BETWEEN 121 AND 304), 6) AS r_{n}" for n, c in _RADAR_SIGNALS.items())
    + " FROM obs GROUP BY point_id, year)",
    f"b AS (SELECT *, CASE WHEN label = 'presence' THEN 1 ELSE 0 END AS y FROM w WHERE label IN ('presence', "
    f"'absence') AND NOT (label = 'presence' AND r_vh < {LEAST_VH}) AND "
    + " AND ".join(
        f"{c} IS NOT NULL" for c in [*(f"o_{n}" for n in _OPTICAL_SIGNALS), *(f"r_{n}" for n in _RADAR_SIGNALS)]
    )
    + ")",
    "os AS (" + " UNION ALL ".join(f"SELECT '{n}' AS optical, o_{n} AS a, y FROM b" for n in _OPTICAL_SIGNALS) + ")",
    "oc AS (SELECT optical, a, sum(y) AS p, sum(1 - y) AS n FROM os GROUP BY ALL)",
    "ou AS (SELECT optical, a, round(sum(p) OVER d / nullif(sum(p) OVER g, 0) + 1 - sum(n) OVER d / nullif(sum(n) "
    "OVER g, 0), 9) AS j FROM oc WINDOW d AS (PARTITION BY optical ORDER BY a DESC), g AS (PARTITION BY optical))",
    "th AS (SELECT optical, a AS threshold FROM ou QUALIFY row_number() OVER (PARTITION BY optical ORDER BY j DESC "
    "NULLS LAST, a) = 1)",
    "t AS ("
    + " "
    "UNION ALL ".join(
        f"SELECT '{o}' AS optical, '{r}' AS radar, o_{o} AS a, r_{r} AS b, y FROM b" for o in _OPTICAL_SIGNALS
        for r in _RADAR_SIGNALS
    )
    + ")",
    "ranked AS (SELECT *, rank() OVER (PARTITION BY optical, radar ORDER BY a) + (count(*) OVER (PARTITION BY "
    "optical, radar, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY optical, radar ORDER BY b) + (count(*) OVER "
    "(PARTITION BY optical, radar, b) - 1) / 2 AS rb FROM t)",
    "rho AS (SELECT optical, radar, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM ranked GROUP BY ALL)",
    "fl AS (SELECT t.*, rank() OVER (PARTITION BY optical, radar ORDER BY b) + (count(*) OVER (PARTITION BY optical, "
    "radar, b) - 1) / 2 AS r FROM t JOIN th USING (optical) WHERE (y = 1) != (a >= threshold))",
    "ra AS (SELECT optical, radar, count(*) AS n_fail, CASE WHEN count(*) >= 8 THEN round((sum(r) FILTER (y = 1) - "
    "sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) END AS residual_auc FROM fl GROUP BY ALL)",
)


@R.add(
    "ml_10",
    with_obs(*_PAIRS)
    + "SELECT optical, radar, n, rho, n_fail, residual_auc FROM rho LEFT JOIN ra USING (optical, radar)"
)
def ml_10(spark, d):
    """How much radar scores add to optical ones: rank correlation, and AUROC among the optical score's failures."""
    dry = wi.flags_dry(F.col("doy"))
    w = obs(spark, d).groupBy(*wi.WINDOW).agg(
        F.min("label").alias("label"),
        *[r6(F.percentile(F.when(F.expr(GOOD), F.col(c)), F.lit(0.05)), f"o_{n}") for n, c in _OPTICAL_SIGNALS.items()],
        *[r6(F.avg(F.when(dry, F.col(c))), f"r_{n}") for n, c in _RADAR_SIGNALS.items()],
    )
    base = w.where(f"label IN ('presence', 'absence') AND NOT (label = 'presence' AND r_vh < {LEAST_VH})").dropna()
    base = base.withColumn("y", F.when(F.col("label") == "presence", 1).otherwise(0))
    stacked = lambda names, kind, out: F.explode(
        F.array(*[F.struct(F.lit(n).alias(kind), F.col(f"{kind[0]}_{n}").alias(out)) for n in names])
    )
    one = base.select(
        "y", *[f"r_{n}" for n in _RADAR_SIGNALS], stacked(_OPTICAL_SIGNALS, "optical", "a").alias("o")
    ).select("y", *[f"r_{n}" for n in _RADAR_SIGNALS], "o.*")
    both = one.select(
        "y", "optical", "a", stacked(_RADAR_SIGNALS, "radar", "b").alias("s")
    ).select("y", "optical", "a", "s.*")
    keys = ["optical", "radar"]
    residual = ev.residual_auroc(both, keys, "a", "b", "y", ev.youden(one, "a", "y", ["optical"]), ["optical"])
    rho = ev.spearman(both, "a", "b", keys).select(*keys, "n", r6("rho", "rho"))
    return rho.join(residual, keys, "left").select(*keys, "n", "rho", "n_fail", r6("residual_auc", "residual_auc"))


def features(spark, d):
    """Per window: annual summaries of all features, and the label."""
    df = obs(spark, d)
    labels = df.groupBy("point_id").agg(F.min("label").alias("label"))
    return annual_summaries(df).join(labels, "point_id")


FEATURE_NAMES = [f"{n}_{end}" for n in (*OPTICAL, *RADAR) for end in ("p5", "p95", "std")]
#: A linear model over all annual features; its weights follow a rule, so that any engine can write them down.
_WEIGHTS = {n: (k * 7 % 11 - 5) / 20 for k, n in enumerate(FEATURE_NAMES)}
_BIAS = -0.5
_FEATURES = f"fe AS (SELECT point_id, year, min(label) AS label, {summary_sql(OPTICAL, GOOD, None)}, {summary_sql(RADAR, IS_RADAR, None)} FROM obs GROUP BY point_id, year HAVING count(*) FILTER ({GOOD}) > 0)"


def _linear_sql(weights, bias):
    return f"1 / (1 + exp(-({' + '.join(f'{w} * {n}' for n, w in weights.items())} + {bias})))".replace("+ -", "- ")


_PROB = _linear_sql(_WEIGHTS, _BIAS)


@R.add("ml_11")
def ml_11(spark, d):
    """A logistic model over all annual features, by distributed optimisation over the training windows.

    Presence windows weigh as many times as there are absence windows for each; validation points are the southernmost fifth of each
    label. More iterations are tried while the mean AUROC of the worst quarter of validation sites gets better.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    labelled = features(spark, d).where(F.col("label").isin("presence", "absence"))
    splits = ev.southern_split(points(spark, d), 0.2).select("point_id", "region_id", "split")
    df = labelled.join(splits, "point_id").withColumn(
        "y", F.when(F.col("label") == "presence", 1.0).otherwise(0.0)
    ).withColumn("site", ids.site(F.col("region_id")))
    vectors = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="raw").transform(df).persist()
    train = vectors.where("split = 'train'")
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    counts = train.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    weight = (counts["n"] - counts["pos"]) / counts["pos"] if counts["pos"] else 1.0
    ready = scaler.transform(vectors).withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0))
    best, best_tail = None, None
    for iterations in (5, 20, 80):
        model = LogisticRegression(
            featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, maxIter=iterations
        ).fit(ready.where("split = 'train'"))
        scored = model.transform(ready.where("split = 'validation'")).select(
            "site", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score")
        )
        tail = ev.tail_mean(
            ev.auroc(scored, ["site"], "score", "y").select("site", "auc"), "auc", 0.25
        ).first()["tail_mean"]
        if best is not None and (tail is None or (best_tail is not None and tail <= best_tail)):
            break
        best, best_tail = (model, iterations), tail
    vectors.unpersist()
    model, iterations = best
    rows = [
        (n, float(w), iterations) for n, w in zip([*FEATURE_NAMES, "intercept"], [*model.coefficients, model.intercept])
    ]
    return spark.createDataFrame(rows, "feature string, weight double, iterations int")


@R.add("ml_12", with_obs(_FEATURES) + f"SELECT point_id, year, round({_PROB}, 6) AS prob FROM fe")
def ml_12(spark, d):
    return features(spark, d).select(*wi.WINDOW, r6(scoring.linear_scorer(_WEIGHTS, _BIAS), "prob"))


@R.add("ml_12_arrow", with_obs(_FEATURES) + f"SELECT point_id, year, round({_PROB}, 6) AS prob FROM fe")
def ml_12_arrow(spark, d):
    """The same model through the boundary that any other model would use."""
    import numpy as np
    import pyarrow as pa

    def model(batches):
        for b in batches:
            x = sum(w * b.column(n).to_numpy() for n, w in _WEIGHTS.items()) + _BIAS
            yield pa.RecordBatch.from_arrays(
                [b.column("point_id"), b.column("year"), pa.array(np.round(1 / (1 + np.exp(-x)), 6))],
                names=["point_id", "year", "prob"]
            )

    return scoring.score_with(
        features(spark, d).select(*wi.WINDOW, *_WEIGHTS), model, "point_id string, year int, prob double"
    )


_GATE = {"ndvi_p5": 2.0}


@R.add(
    "ml_13",
    with_obs(_FEATURES)
    + f"SELECT point_id, year, round(CASE WHEN {_linear_sql(_GATE, -0.2)} >= 0.5 THEN {_PROB} ELSE 0 END, 6) AS "
    f"score FROM fe"
)
def ml_13(spark, d):
    gated = scoring.cascade(
        features(spark, d), scoring.linear_scorer(_GATE, -0.2), scoring.linear_scorer(_WEIGHTS, _BIAS), 0.5
    )
    return gated.select(*wi.WINDOW, r6("score", "score"))


_AUGMENTED = {"drop": 0.1, "noise": 0.02, "jitter": 3, "shift": 10, "gate": 8}


@R.add("ml_14", with_obs("a AS (SELECT *, floor(" + unit_sql("obs_id", repr("jitter")) + " * 7)::INT - 3 AS jitter, floor(" + unit_sql("point_id", "year", repr("shift")) + " * 21)::INT - 10 AS shift, (" + unit_sql("point_id", "year", repr("noise")) + " - 0.5) * 0.02 AS noise FROM obs WHERE " + GOOD + " AND " + unit_sql("obs_id", repr("drop")) + " >= 0.1)")
       + "SELECT obs_id, least(greatest(((doy - 1 + shift + jitter + 365) % 365) + 1, 1), 365)::INT AS doy, round(B08 / 10000.0::DOUBLE + noise, 6) AS B08, round(B04 / 10000.0::DOUBLE + noise, 6) AS B04, row_number() OVER (PARTITION BY point_id, year ORDER BY " + unit_sql("obs_id", repr("gate")) + ", obs_id) <= 8 AS in_gate FROM a")
def ml_14(spark, d):
    """Seeded augmentation of the training rows.

    A tenth of the rows is dropped; days move by a phase per window and a jitter per row; bands get an offset per window; and eight
    random rows of each window make the gate's short view.
    """
    from pyspark.sql import Window

    df = ob.optical(obs(spark, d)).where(unit("obs_id", F.lit("drop")) >= _AUGMENTED["drop"])
    between = lambda u, most: F.floor(u * (2 * most + 1)).cast("int") - most
    shift, jitter = between(
        unit("point_id", "year", F.lit("shift")), _AUGMENTED["shift"]
    ), between(unit("obs_id", F.lit("jitter")), _AUGMENTED["jitter"])
    noise = (unit("point_id", "year", F.lit("noise")) - 0.5) * _AUGMENTED["noise"]
    view = F.row_number().over(
        Window.partitionBy(*wi.WINDOW).orderBy(unit("obs_id", F.lit("gate")), "obs_id")
    ) <= _AUGMENTED["gate"]
    return df.select(
        "obs_id", indices.shift_doy(F.col("doy"), shift + jitter).alias("doy"),
        *[F.round(indices.reflectance(b) + noise, 6).alias(b) for b in ("B08", "B04")], view.alias("in_gate")
    )


#: Five qualities of a reading: clear sky, air, two zeniths (stored as hundredths), and the distance of its greenness from the point's mean.
_ARCHIVE = f"ar AS (SELECT point_id, avg(i_ndvi) AS m, greatest(stddev_samp(i_ndvi), 1e-6) AS s FROM obs WHERE {GOOD} GROUP BY 1)"
_Z = {b: f"coalesce({b} / 10000.0::DOUBLE, 0)" for b in BANDS}
_FLOWERS = f"least(greatest((({_Z['B07']} - {_Z['B05']}) / ({_Z['B07']} + {_Z['B05']} + 1e-9) + ({_Z['B08']} - {_Z['B11']}) / ({_Z['B08']} + {_Z['B11']} + 1e-9)) / 2, -1), 1)"
_QUALITY = "CASE WHEN i_ndvi IS NOT NULL THEN scl_purity * (aot / 100.0::DOUBLE) * (view_zenith / 100.0::DOUBLE) * (sun_zenith / 100.0::DOUBLE) / (1 + abs((least(greatest(i_ndvi, -1), 1) - m) / s)) END"
_VECTOR = with_obs(
    _ARCHIVE,
    f"sq AS (SELECT point_id, year, doy, obs_id, {_FLOWERS} AS f, {_QUALITY} AS q FROM obs JOIN ar USING (point_id) "
    f"WHERE source = 'S2')",
    "ny AS (SELECT point_id FROM sq GROUP BY 1 HAVING count(DISTINCT year) >= 2)",
    "uq AS (SELECT *, f * q AS w FROM sq SEMI JOIN ny USING (point_id) WHERE q >= 0.1 AND doy BETWEEN 200 AND 340 "
    "AND f * q IS NOT NULL)",
    "pq AS (SELECT point_id, year, max(w) AS peak, arg_max(doy, struct_pack(w := w, a := -doy)) AS peak_doy, "
    "count(*) FILTER (w >= 0.02) AS long FROM uq GROUP BY ALL HAVING max(w) >= 0.04)",
    "wv AS (SELECT point_id, max(peak) AS peak_value, arg_max(peak_doy, struct_pack(p := peak, y := -year)) AS "
    "peak_doy, avg(long) AS spike_duration, avg(peak_doy) AS peak_doy_mean, stddev_pop(peak_doy) AS peak_doy_sd, "
    "count(*) AS years_detected FROM pq GROUP BY 1 HAVING count(*) >= 2)",
    "mq AS (SELECT point_id, avg(coalesce(q, 0)) AS mean_quality FROM sq GROUP BY 1)",
    "st AS (SELECT point_id, abs(lat) * 2 AS HAND, abs(lon - 141.0) * 111320.0 * cos(radians(lat)) AS dist_to_water "
    "FROM (SELECT point_id, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY 1))",
)
VECTOR = (
    "peak_value", "peak_doy", "spike_duration", "peak_doy_mean", "peak_doy_sd", "years_detected", "HAND",
    "dist_to_water", "mean_quality"
)
_VECTOR_SQL = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in VECTOR)


def flowering(spark, d):
    """Optical readings with their flowering index ``f`` and quality ``q``, the product of all five terms."""
    df = obs(spark, d).where("source = 'S2'")
    archive = ob.optical(df).groupBy("point_id").agg(
        F.avg("i_ndvi").alias("_m"), F.greatest(F.stddev_samp("i_ndvi"), F.lit(1e-6)).alias("_s")
    )
    bands = F.create_map(*[x for b in BANDS for x in (F.lit(b), indices.reflectance(b))])
    terms = {
        "clear": F.col("scl_purity").cast("double"),
        **{n: F.col(n) / 100.0 for n in ("aot", "view_zenith", "sun_zenith")},
        "green": indices.greenness(F.col("i_ndvi"), F.col("_m"), F.col("_s"))
    }
    return df.join(archive, "point_id").withColumns({"f": indices.flowering_index(bands), "q": indices.quality(terms)})


def structure(spark, d):
    """What a terrain model would give for each point; here by a rule from its place, as the tables hold no terrain."""
    p = obs(spark, d).groupBy("point_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    return p.select(
        "point_id", (F.abs("lat") * 2).alias("HAND"),
        (F.abs(F.col("lon") - 141.0) * 111_320.0 * F.cos(F.radians("lat"))).alias("dist_to_water")
    )


@R.add("ml_15", _VECTOR + f"SELECT point_id, {_VECTOR_SQL} FROM wv JOIN st USING (point_id) JOIN mq USING (point_id)")
def ml_15(spark, d):
    """The feature vector of a point in its fixed order: six waveform features, two of structure, mean quality."""
    df = flowering(spark, d)
    wave = wi.waveform(df, "f", "q", threshold=0.04, min_quality=0.1, min_years=2)
    quality = df.groupBy("point_id").agg(F.avg(F.coalesce("q", F.lit(0.0))).alias("mean_quality"))
    vector = wi.feature_vector(wave, structure(spark, d), quality, VECTOR)
    return vector.select("point_id", *[r6(F.col(c), c) for c in VECTOR])


_COMPOSITE = with_obs(
    _ARCHIVE,
    f"sq AS (SELECT point_id, B05, B07, B08, B11, {_QUALITY} AS q FROM obs JOIN ar USING (point_id) WHERE source = "
    f"'S2' AND year = 2018)",
    "cp AS (SELECT point_id, "
    + ", ".join(
        f"CASE WHEN coalesce(sum(q) FILTER ({b} IS NOT NULL), 0) = 0 THEN avg({b} / 10000.0::DOUBLE) ELSE sum(q * "
        f"({b} / 10000.0::DOUBLE)) / sum(q) FILTER ({b} IS NOT NULL) END AS {b}"
        for b in ("B05", "B07", "B08", "B11")
    )
    + ", avg(coalesce(q, 0)) AS mean_quality FROM sq GROUP BY 1)",
    "st AS (SELECT point_id, abs(lat) * 2 AS HAND, abs(lon - 141.0) * 111320.0 * cos(radians(lat)) AS dist_to_water "
    "FROM (SELECT point_id, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY 1))",
)
_COMPOSITE_INDEX = _FLOWERS.replace(" / 10000.0::DOUBLE", "")


@R.add(
    "ml_16",
    _COMPOSITE
    + f"SELECT point_id, round({_COMPOSITE_INDEX}, 6) AS peak_value, 270.0::DOUBLE AS peak_doy, 1.0::DOUBLE AS "
    f"spike_duration, 270.0::DOUBLE AS peak_doy_mean, 0.0::DOUBLE AS peak_doy_sd, 1.0::DOUBLE AS years_detected, "
    f"round(HAND, 6) AS HAND, round(dist_to_water, 6) AS dist_to_water, round(mean_quality, 6) AS mean_quality FROM "
    f"cp JOIN st USING (point_id)"
)
def ml_16(spark, d):
    """The same vector from one quality-weighted composite, as a scene is scored: the waveform's place is fixed, its height the index."""
    df = flowering(spark, d).where("year = 2018")
    w = lambda b: F.sum(F.when(F.col(b).isNotNull(), F.col("q")))
    value = lambda b: F.when(
        F.coalesce(w(b), F.lit(0.0)) == 0, F.avg(indices.reflectance(b))
    ).otherwise(F.sum(F.col("q") * indices.reflectance(b)) / w(b))
    used = ("B05", "B07", "B08", "B11")
    composite = df.groupBy("point_id").agg(
        *[value(b).alias(b) for b in used], F.avg(F.coalesce("q", F.lit(0.0))).alias("mean_quality")
    )
    index = indices.flowering_index(F.create_map(*[x for b in used for x in (F.lit(b), F.col(b))]))
    fixed = {
        "peak_doy": 270.0, "spike_duration": 1.0, "peak_doy_mean": 270.0, "peak_doy_sd": 0.0, "years_detected": 1.0
    }
    joined = composite.join(structure(spark, d), "point_id").withColumn("peak_value", index).withColumns(
        {n: F.lit(v) for n, v in fixed.items()}
    )
    return joined.select("point_id", *[r6(F.col(c), c) if c not in fixed else c for c in VECTOR])


@R.add("ml_17")
def ml_17(spark, d):
    """Five clusters of the dry-season means, named by the rank of their mean NDVI."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.sql import Window

    dry = ob.optical(obs(spark, d)).where(wi.flags_dry(F.col("doy"))).groupBy("point_id").agg(
        F.avg("i_ndvi").alias("ndvi"), F.avg("i_ndwi").alias("ndwi"), F.avg("i_ndsvi").alias("ndsvi")
    ).dropna()
    ready = VectorAssembler(inputCols=["ndvi", "ndwi", "ndsvi"], outputCol="raw").transform(dry)
    ready = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(ready).transform(ready)
    found = KMeans(k=5, seed=42, featuresCol="x").fit(ready).transform(ready)
    ranks = found.groupBy("prediction").agg(F.avg("ndvi").alias("m")).withColumn(
        "rank", F.row_number().over(Window.orderBy("m", "prediction"))
    )  # five rows
    return found.join(F.broadcast(ranks), "prediction").select(
        "point_id", F.col("rank").alias("cluster"), (F.col("rank") / 5).alias("prob")
    )


@R.add(
    "ml_18",
    with_obs("h AS (SELECT point_id, avg(vh_db) FILTER (doy BETWEEN 121 AND 304) AS v FROM obs GROUP BY 1)")
    + "SELECT point_id, round(v, 6) AS vh_dry, CASE WHEN v >= -16 THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN "
    "0.0::DOUBLE END AS score FROM h"
)
def ml_18(spark, d):
    return scoring.dry_heuristic(obs(spark, d), -16.0).select("point_id", r6("vh_dry", "vh_dry"), "score")


_HARM = f"""cl AS (SELECT tile_id, year, date, round(lon * 10000) AS cx, round(lat * 10000) AS cy, {', '.join(BANDS)} FROM obs WHERE tile_id IS NOT NULL),
 rf AS (SELECT tile_id AS ref FROM cl GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 ta AS (SELECT tile_id, year, date, cx, cy, band, avg(v)::DOUBLE AS v FROM (SELECT * FROM cl UNPIVOT (v FOR band IN ({', '.join(BANDS)}))) WHERE v > 0 GROUP BY ALL),
 co AS (SELECT a.tile_id, a.band, a.year, least(greatest(1 / median(round(least(greatest(a.v / b.v, 0.5), 2) + 1e-9, 5)), 0.85), 1.15) AS scale_factor FROM ta a JOIN ta b USING (year, date, cx, cy, band) WHERE a.tile_id != (SELECT ref FROM rf) AND b.tile_id = (SELECT ref FROM rf) GROUP BY ALL)"""
_WIDE_FACTORS = "wd AS (SELECT tile_id, year, " + ", ".join(
    f"max(scale_factor) FILTER (band = '{b}') AS f_{b}" for b in BANDS
) + " FROM co GROUP BY ALL)"


@R.add("ml_20", with_obs(_HARM) + "SELECT tile_id, band, year, round(scale_factor, 6) AS scale_factor FROM co")
def ml_20(spark, d):
    return scoring.harmonise(obs(spark, d), BANDS).select("tile_id", "band", "year", r6("scale_factor", "scale_factor"))


@R.add(
    "join_11",
    with_obs(_HARM, _WIDE_FACTORS) + "SELECT obs_id, "
    + ", ".join(f"round({b} * coalesce(f_{b}, 1), 4) AS {b}" for b in BANDS)
    + " FROM obs LEFT JOIN wd USING (tile_id, year)"
)
def join_11(spark, d):
    df = obs(spark, d)
    return scoring.apply_corrections(df, scoring.harmonise(df, BANDS), BANDS).select(
        "obs_id", *[F.round(b, 4).alias(b) for b in BANDS]
    )


# ---- data quality -----------------------------------------------------------------------------------------------------


DQ: list[tuple[str, str, str, str]] = []  # (check, its measure in SQL, when it fails, when it warns)


def _dq(name, measure, fail, warn, f, check, repeated=False):
    DQ.append((check, measure, fail, warn))
    R.add(
        name, with_obs() + dq_sql(check, measure, fail, warn), repeated=repeated
    )(lambda spark, d: f(obs(spark, d, repeated)))


def dq_sql(check, measure, fail, warn):
    verdict = f"CASE WHEN coalesce({fail}, false) THEN 'FAIL' WHEN coalesce({warn}, false) THEN 'WARN' ELSE 'PASS' END"
    return f"SELECT '{check}' AS check_name, {verdict} AS status, round(measure::DOUBLE, 6) AS measure FROM ({measure})"


def _worst(test, among="source = 'S2'"):
    return "greatest(" + ", ".join(test.format(b=b, among=among) for b in BANDS) + ")"


_dq("dq_01", "SELECT count(*) AS measure FROM obs", "measure = 0", "false", checks.row_count, "row_count")
_dq(
    "dq_03", "SELECT count(*) FILTER (source = 'S1') AS measure FROM obs", "false", "measure = 0",
    checks.radar_presence, "radar_presence"
)
_dq(
    "dq_04", "SELECT count(DISTINCT point_id) / 1000.0::DOUBLE AS measure FROM obs", "measure < 0.3", "measure < 0.8",
    lambda df: checks.pixel_ratio(df, 1000), "pixel_ratio"
)
_dq(
    "dq_05",
    "SELECT " + _worst("count(*) FILTER ({among} AND {b} IS NULL) / nullif(count(*) FILTER ({among}), 0)")
    + " AS measure FROM obs",
    "measure > 0.2", "measure > 0.01", checks.null_bands, "null_bands"
)
_dq(
    "dq_06", "SELECT " + _worst("count(*) FILTER ({b} NOT BETWEEN 0 AND 15000)") + " AS measure FROM obs",
    "measure > 0", "false", checks.band_range, "band_range"
)
_dq(
    "dq_07",
    "SELECT greatest(" + ", ".join(f"count(*) FILTER (i_{n} NOT BETWEEN -1 AND 1)" for n in ("ndvi", "ndwi", "ndre"))
    + ") AS measure FROM obs",
    "measure > 0", "false", checks.index_range, "index_range"
)
_dq("dq_08", "SELECT avg(scl_purity) AS measure FROM obs", "measure = 0", "measure < 0.5", checks.purity, "purity")
_dq(
    "dq_09",
    "SELECT count(*) AS measure FROM (SELECT point_id, date, source FROM obs GROUP BY ALL HAVING count(*) > 1)",
    "measure > 0", "false", checks.duplicates, "duplicates", repeated=True
)
_dq(
    "dq_10",
    "SELECT count(*) FILTER (source = 'S1' AND B02 IS NOT NULL) + count(*) FILTER (source = 'S1' AND orbit IS NULL) "
    "AS measure FROM obs",
    "measure > 0", "false", checks.radar_integrity, "radar_integrity"
)
_dq(
    "dq_12",
    f"SELECT count(*) FILTER (NOT (lon BETWEEN {BOX[0]} - 0.02 AND {BOX[2]} + 0.02 AND lat BETWEEN {BOX[1]} - 0.02 "
    f"AND {BOX[3]} + 0.02)) AS measure FROM obs",
    "measure > 0", "false", lambda df: checks.outside_box(df, BOX), "outside_box"
)
DQ += [
    ("dates", "SELECT count(DISTINCT date) AS measure FROM obs", "measure < 10", "false"),
    ("months", "SELECT count(DISTINCT month) AS measure FROM obs", "false", "measure < 6")
]


@R.add(
    "dq_11",
    with_obs()
    + "SELECT 'dates' AS check_name, CASE WHEN count(DISTINCT date) < 10 THEN 'FAIL' ELSE 'PASS' END AS status, "
    "count(DISTINCT date)::DOUBLE AS measure FROM obs UNION ALL SELECT 'months', CASE WHEN count(DISTINCT month) < 6 "
    "THEN 'WARN' ELSE 'PASS' END, count(DISTINCT month)::DOUBLE FROM obs"
)
def dq_11(spark, d):
    return checks.date_cover(obs(spark, d))


_KINDS = {
    "string": "VARCHAR", "float": "FLOAT", "date": "DATE", "int": "INTEGER", "tinyint": "TINYINT",
    "smallint": "SMALLINT"
}


@R.add(
    "dq_02",
    "WITH want(column_name, expected, kind) AS (VALUES "
    + ", ".join(
        f"('{f.name}', '{f.dataType.simpleString()}', '{_KINDS[f.dataType.simpleString()]}')" for f in ob.SCHEMA
    )
    + ") SELECT column_name, expected, CASE WHEN column_type = kind THEN 'PASS' ELSE 'FAIL' END AS status FROM want "
    "LEFT JOIN (DESCRIBE SELECT * FROM observations) USING (column_name)",
    repeated=True
)
def dq_02(spark, d):
    """Columns that the canonical schema asks for, and whether they are there with their type."""
    return checks.schema(table(spark, d, "observations"), ob.SCHEMA)


@R.add(
    "dq_13",
    "WITH " + _CHUNK_SQL
    + " SELECT file_id, CASE WHEN n_points = 0 THEN 'EMPTY' WHEN n_dates = 0 THEN 'S1_MISS' WHEN n_complete < 0.95 * "
    "n_dates THEN CASE WHEN 100 * n_enough / n_points >= 90 AND cover_median < 0.5 * n_rows THEN 'S1_TRUNC_OK' ELSE "
    "'S1_INCOMPLETE' END ELSE 'OK' END AS verdict FROM al"
)
def dq_13(spark, d):
    return chunk_quality(spark, d).select("file_id", "verdict")


@R.add(
    "dq_14",
    with_obs(*_REGION_QA)
    + "SELECT region_id, CASE WHEN n_obs IS NULL THEN 'EMPTY' ELSE concat_ws(',', CASE WHEN n_dup > 0 THEN 'DUPES' "
    "END, CASE WHEN n_points < 5 THEN 'SPARSE' END, CASE WHEN obs_min < 4 THEN 'LOW_OBS' END, CASE WHEN n_null > 0 "
    "THEN 'NAN' END, CASE WHEN top > 12000 OR bottom < 0 THEN 'RANGE' END, CASE WHEN vh_median IS NULL THEN "
    "'S1_MISS' END, CASE WHEN vh_median > 1 THEN 'S1_SCALE' END) END AS tags FROM qa",
    repeated=True
)
def dq_14(spark, d):
    return checks.region_tags(obs(spark, d, repeated=True)).select("region_id", "tags")


@R.add(
    "dq_15",
    with_obs()
    + f"SELECT count(*) FILTER (NOT i_ndvi BETWEEN -1 AND 1) AS n_outside, round(count(*) FILTER (i_ndvi IS NULL) / "
    f"count(*), 6) AS null_share, round(median(i_ndvi), 6) AS middle FROM obs WHERE {GOOD}"
)
def dq_15(spark, d):
    from gridwake.operators.order_stats import percentiles, value_counts

    df = ob.optical(obs(spark, d))
    middle = percentiles(value_counts(df, [], "i_ndvi"), [], {"middle": 0.5}).select(r6("middle", "middle"))
    facts = df.agg(
        F.count_if(~F.col("i_ndvi").between(-1, 1)).alias("n_outside"),
        r6(F.count_if(F.col("i_ndvi").isNull()) / F.count(F.lit(1)), "null_share")
    )
    return one_row(facts, middle)


QUERIES, SQL = R.queries, R.sql
