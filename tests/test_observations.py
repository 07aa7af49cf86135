import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.functions import geodesy, ids, indices
from gridwake.operators import evaluation as ev
from gridwake.operators import observations as ob
from gridwake.operators import scoring
from gridwake.operators import windows as wi
from gridwake.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame(
        [tuple(values.values())],
        ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    ) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_indices_by_hand(spark):
    bands = {b: float(1000 + 100 * i) for i, b in enumerate(indices.BANDS)}
    r = {k: v / 10_000 for k, v in bands.items()}
    want = {
        "NDVI": (r["B08"] - r["B04"]) / (r["B08"] + r["B04"]),
        "EVI": 2.5 * (r["B08"] - r["B04"]) / (r["B08"] + 6 * r["B04"] - 7.5 * r["B02"] + 1),
        "MAVI": (r["B08"] - r["B04"]) / (r["B08"] + r["B04"] + r["B11"]), "CI_RE": r["B07"] / r["B05"] - 1
    }
    for name, value in want.items():
        assert one(spark, indices.spectral_index(name), **bands) == pytest.approx(value)
    assert one(spark, indices.spectral_index("NDVI"), **{**bands, "B08": 0.0, "B04": 0.0}) is None


def test_shaping(spark):
    x = F.col("x")
    assert one(spark, indices.to_storage(x), x=0.03125) == 312 and one(
        spark, indices.to_storage(x), x=0.09375
    ) == 938 and one(spark, indices.to_storage(x), x=9.0) == 65535
    assert one(spark, indices.to_storage(x), x=float("nan")) is None
    assert one(spark, indices.decibel(x), x=0.0) is None and one(spark, indices.decibel(x), x=0.1) == pytest.approx(-10)
    assert one(spark, indices.shift_doy(x, 300), x=100.0) == 35 and one(spark, indices.percent(x), x=1.7) == 100
    assert [one(spark, c, x=0.0) for c in indices.doy_encoding(x)] == [0.0, 0.0]
    assert one(spark, indices.brdf_factor("B04", F.lit(45.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(1)


def test_projection_against_known_places(spark):
    zone = geodesy.utm_zone(F.col("lon"))
    east, north = geodesy.utm(F.col("lon"), F.col("lat"), zone)
    assert one(spark, east, lon=141.0, lat=-18.0) == pytest.approx(500_000, abs=1e-6)
    assert one(spark, north, lon=141.0, lat=-18.0) == pytest.approx(8_009_814, abs=2)
    assert one(spark, geodesy.utm_epsg(F.col("lon"), F.col("lat")), lon=141.0, lat=-18.0) == 32754
    x, y = geodesy.slippy(F.col("lon"), F.col("lat"), 1)
    assert (one(spark, x, lon=10.0, lat=-10.0), one(spark, y, lon=10.0, lat=-10.0)) == (1, 1)


def test_identifiers(spark):
    p = F.col("p")
    assert one(spark, ids.northing(p), p="px_0001_0042") == 42 and one(spark, ids.northing(p), p="odd") == 0
    assert one(spark, ids.site(p), p="a_b_val_presence_01") == "a_b" and one(spark, ids.site(p), p="gate_1") == "gate_1"
    assert one(spark, ids.cover_type(p), p="x_bare_1") == "bare" and one(
        spark, ids.overpass(p), p="S2A_54LWH_20220101_0_L2A"
    ) == "S2A_54LWH_20220101"


def test_farthest():
    doys = np.array([1, 2, 3, 100, 200, 201, 360], float)
    assert list(wi.farthest(doys, 3)) == [0, 4, 6] and list(wi.farthest(doys, 1)) == [0] and list(
        wi.farthest(doys, 0)
    ) == []
    assert list(wi.farthest(doys, 9)) == list(range(7)) and list(wi.farthest(np.zeros(5), 4)) == [0, 1, 2, 4]


def history(spark):
    start = date(2020, 1, 1)
    data = [
        ("p", 2020, start + timedelta(days=5 * i), 5 * i + 1, "S1" if i % 3 == 0 else "S2", i, 0.1 * i)
        for i in range(70)
    ]
    return spark.createDataFrame(
        data, "point_id string, year int, date date, doy int, source string, obs_id long, v double"
    )


def test_subsampling_keeps_optical_rows(spark):
    out = wi.subsample(history(spark), 50, all_optical=True).collect()
    assert len(out) == 50 and sum(r.source == "S2" for r in out) == 46
    assert wi.subsample(history(spark), 4).count() == 4 and wi.subsample(history(spark).limit(0), 4).count() == 0


def test_despeckle_and_runs(spark):
    df = history(spark)
    assert wi.despeckle(df, ["v"], 1) is df
    assert [round(r.v, 3) for r in wi.despeckle(df, ["v"], 3).orderBy("date").limit(2).collect()] == [0.05, 0.1]
    both = df.unionByName(df.withColumn("point_id", F.lit("q")))
    assert tuple(wi.is_one_run(both.repartition(5), ["point_id", "date"]).first()) == (2, 2)
    assert tuple(wi.is_one_run(both.repartition(5), ["date", "point_id"]).first())[0] > 100


def test_no_optical_columns_pass_whole(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert ob.optical(df).count() == 1


def test_conform(spark):
    out = ob.conform(spark.createDataFrame([("p", "x", 1.5)], "point_id string, B02 string, extra double"))
    assert out.columns == ob.SCHEMA.names and out.first().B02 is None


def scored(spark, data):
    return spark.createDataFrame(data, "score double, label int")


def test_evaluation_by_hand(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0), (None, 1)])
    assert ev.auroc(df, []).first().auc == pytest.approx((3 + 2 + 0.5) / 6)
    assert ev.auroc(scored(spark, [(0.5, 1)]), []).first().auc is None
    best = ev.best_f1(df).first()
    assert (best.threshold, best.tp, best.fp, best.fn, best.tn) == (0.8, 2, 1, 0, 2)
    assert ev.youden(df).first().threshold == 0.8
    assert ev.calibration_error(scored(spark, [(1.0, 1), (0.0, 0), (0.45, 1)])).first().ece == pytest.approx(0.55 / 3)
    assert ev.tail_mean(df.where("score IS NOT NULL"), "score", 0.3).first().tail_mean == pytest.approx(0.2)


def test_decay(spark):
    df = spark.createDataFrame(
        [("a", 2020, 1.0), ("a", 2021, 0.0), ("b", 2020, 0.4)], "point_id string, year int, score double"
    )
    got = {r.point_id: r.score for r in scoring.over_years(df, 2021, 1.0).collect()}
    assert got["a"] == pytest.approx(math.exp(-1) / (1 + math.exp(-1))) and got["b"] == pytest.approx(0.4)
    assert {r.point_id: r.score for r in scoring.over_years(df, 2021, 0.0).collect()}["a"] == 0.5
    assert scoring.over_years(df.limit(0), 2021, 1.0).count() == 0


def test_ranking(spark):
    points = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "point_id string")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("d", 0.9)], "point_id string, score double")
    got = {
        r.point_id: r["rank"] for r in scoring.ranking(points, scores, points.withColumn("label", F.lit(1))).collect()
    }
    assert got == {"b": 1, "d": 2, "a": 3, "c": None}


def test_harmonising_one_tile_gives_nothing(spark):
    data = [("T", 2020, date(2020, 1, 1), 141.0, -18.0, 100.0)]
    assert scoring.harmonise(
        spark.createDataFrame(data, "tile_id string, year int, date date, lon double, lat double, B04 double"), ["B04"]
    ).count() == 0
    two = [(t, 2020, date(2020, 1, k), 141.0, -18.0, v) for k in range(1, 6) for t, v in (("A", 100.0), ("B", 102.0))]
    assert scoring.harmonise(
        spark.createDataFrame(two, "tile_id string, year int, date date, lon double, lat double, B04 double"), ["B04"]
    ).first().scale_factor == pytest.approx(1 / 1.02)


def test_labels_of_overlapping_boxes(spark):
    points = spark.createDataFrame(
        [("a", 0.5, 0.5), ("b", 1.5, 0.5), ("c", 9.0, 9.0)], "point_id string, lon double, lat double"
    )
    regions = spark.createDataFrame(
        [(1, "x", [0.0, 0.0, 2.0, 1.0]), (2, "y", [1.0, 0.0, 2.0, 1.0])],
        "ordinal int, label string, bbox array<double>"
    )
    assert {r.point_id: r.label for r in ob.label_by_box(points, regions).collect()} == {"a": "x", "b": "y", "c": None}


def test_region_configuration():
    got = readers.regions_from_config([{"id": "a", "year": 2020}, {"id": "b", "years": [2019]}])
    assert got[0]["years"] == list(range(2015, 2021)) and [
        r["id"] for r in readers.select_regions(got, ["b", "a"])
    ] == ["b", "a"]
    with pytest.raises(KeyError):
        readers.select_regions(got, ["z"])
    with pytest.raises(ValueError):
        readers.regions_from_config([{"id": "a"}])
    with pytest.raises(ValueError):
        readers.restrict(None)


def test_kernels_shared_by_the_bands_give_the_same_factors(spark):
    angles = [
        (float(s), float(v), float(a)) for s in (0, 30, 45, 70) for v in (0, 5, 20) for a in (0, 90, 170)
    ] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(angles, "s double, v double, a double")
    kernels = indices.with_brdf_kernels(df, F.col("s"), F.col("v"), F.col("a"))
    both = [
        (indices.brdf_from_kernels(b), indices.brdf_factor(b, F.col("s"), F.col("v"), F.col("a")))
        for b in ("B02", "B08")
    ]
    for r in kernels.select(*[c for pair in both for c in pair]).collect():
        assert r[0] == (r[1] if r[1] is None else pytest.approx(r[1])) and r[2] == (
            r[3] if r[3] is None else pytest.approx(r[3])
        )
