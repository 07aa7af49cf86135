"""Summaries, evaluation, checks and vectors against numbers worked out here."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.functions import indices
from gridwake.operators import checks
from gridwake.operators import evaluation as ev
from gridwake.operators import observations as ob
from gridwake.operators import windows as wi
from gridwake.sources import readers


def test_band_summaries_of_windows_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    groups = {
        ("p", y): rng.normal(size=n) for y, n in enumerate([1, 2, 3, 17, 64, 65, 900], 2000)
    } | {("none", 2000): np.full(4, np.nan)}
    rows = [
        (p, y, None if k % 5 == 4 else float(v), float(v) * 2, y != 2001) for (p, y), values in groups.items() for k,
        v in enumerate(values)
    ]
    df = spark.createDataFrame(rows, "point_id string, year int, a double, b double, ok boolean").repartition(5)
    got = {(r.point_id, r.year): r for r in wi.band_summaries(df, wi.WINDOW, ["a", "b"], needed="ok").collect()}
    assert set(got) == set(groups) - {("p", 2001)}
    for (p, y), values in groups.items():
        if (p, y) in got:
            some = np.array([v for k, v in enumerate(values) if k % 5 != 4 and not np.isnan(v)])
            want = (*np.quantile(some, (0.05, 0.95)), some.std()) if len(some) > 1 else (0.0, 0.0, 1.0)
            assert (got[p, y].a_p5, got[p, y].a_p95, got[p, y].a_std) == pytest.approx(tuple(want))
    assert wi.band_summaries(df.limit(0), wi.WINDOW, ["a"]).count() == 0


def test_class_statistics_overlap_and_residual(spark):
    rows = [
        ("s", "presence", f"p{i % 3}", float(i)) for i in range(8)
    ] + [("s", "absence", f"a{i}", float(i) + 4) for i in range(8)] + [
        ("t", "presence", "q", 1.0), ("s", None, "z", 1.0), ("s", "absence", "n", None)
    ]
    stats = ev.class_stats(
        spark.createDataFrame(rows, "site string, label string, point_id string, v double"), ["site"], "v"
    )
    by = {(r.site, r.label): r for r in stats.collect()}
    assert len(by) == 3 and (
        by["s", "presence"].n_pixel_years, by["s", "presence"].n_pixels, by["s", "presence"].mean
    ) == (8, 3, 3.5)
    assert (by["s", "absence"].p25, by["s", "absence"].median, by["s", "absence"].iqr) == (5.75, 7.5, 3.5)
    over = {r.site: (r.overlap, r.na, r.nb) for r in ev.quartile_overlap(stats, ["site"]).collect()}
    assert over["s"] == (0.0, 8, 8) or over["s"][0] == pytest.approx(0.0)
    assert over["t"] == (None, 1, 0)
    failed = [(1, float(i % 2), float(i), i % 2) for i in range(20)]
    df = spark.createDataFrame(failed, "k int, a double, b double, y int").withColumn("a", 1 - F.col("a"))
    out = ev.residual_auroc(
        df, ["k"], "a", "b", "y", spark.createDataFrame([(1, 0.5)], "k int, threshold double"), ["k"]
    ).first()
    assert out.n_fail == 20 and out.residual_auc == pytest.approx(0.55)
    few = ev.residual_auroc(
        df.limit(6), ["k"], "a", "b", "y", spark.createDataFrame([(1, 0.5)], "k int, threshold double"), ["k"]
    ).first()
    assert few.n_fail == 6 and few.residual_auc is None


def quality_rows(spark, data):
    bands = ", ".join(f"{b} int" for b in indices.BANDS)
    rows = [(r, p, d, s, *[v] * len(indices.BANDS), vh) for r, p, d, s, v, vh in data]
    return spark.createDataFrame(
        rows, f"region_id string, point_id string, date date, source string, {bands}, vh double"
    )


def test_region_tags(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    good = [
        ("good", f"p{p}", day(i), "S2", 3000, None) for p in range(5) for i in range(4)
    ] + [("good", "p0", day(9), "S1", None, 0.02)]
    bad = [
        ("bad", f"q{p}", day(i % 3), "S2", 13000 if i else None, None) for p in range(2) for i in range(4)
    ] + [("bad", "q0", day(9), "S1", None, 40.0)]
    data = [*good, *bad, ("radar", "r", day(0), "S1", None, 0.1), ("mute", "m", day(0), "S2", 100, None)]
    got = {r.region_id: r.tags for r in checks.region_tags(quality_rows(spark, data)).collect()}
    assert got == {
        "good": "", "bad": "DUPES,SPARSE,NAN,RANGE,S1_SCALE", "radar": "EMPTY", "mute": "SPARSE,LOW_OBS,S1_MISS"
    }


def test_a_report_stops_at_what_makes_the_rest_pointless(spark):
    df = quality_rows(spark, [("r", "p", date(2020, 1, 1), "S2", 1, None)])
    short = checks.report(df.limit(0), (0, 0, 1, 1), 1, ob.SCHEMA)
    assert [tuple(r) for r in short.collect()] == [("row_count", "FAIL", 0.0)]
    schema = checks.report(df, (0, 0, 1, 1), 1, ob.SCHEMA).collect()
    assert [(r.check_name, r.status) for r in schema] == [("schema", "FAIL")]
    assert [r.status for r in checks.verdicts(short).orderBy("check_name").collect()] == ["FAIL", "FAIL"]


def test_scores_without_coordinates(spark):
    scores = spark.range(2000).select(F.col("id").alias("p"), F.lit(0.5).alias("score"))
    coords = lambda n: spark.range(n).select(F.col("id").alias("p"), F.lit(1.0).alias("lon"))
    assert readers.covered(scores, coords(2000), "p").count() == 2000 and readers.covered(
        scores.limit(0), coords(3), "p"
    ).count() == 0
    with pytest.warns(UserWarning, match="0.50%"):
        assert readers.covered(scores, coords(1990), "p").count() == 1990
    with pytest.raises(ValueError, match="10.0%"):
        readers.covered(scores, coords(1800), "p")
    with pytest.raises(ValueError, match="none"):
        readers.covered(scores, coords(0), "p")


def test_feature_vectors_are_complete(spark):
    wave = spark.createDataFrame([("a", 0.5)], "point_id string, peak double")
    structure, quality = spark.createDataFrame(
        [("a", 2.0)], "point_id string, HAND double"
    ), spark.createDataFrame([("a", None)], "point_id string, q double")
    assert tuple(wi.feature_vector(wave, structure, quality, ["HAND", "peak"]).first()) == ("a", 2.0, 0.5)
    with pytest.raises(ValueError, match="dist"):
        wi.feature_vector(wave, structure, quality, ["dist"])
    with pytest.raises(Exception, match="q is missing"):
        wi.feature_vector(wave, structure, quality, ["q"]).collect()


def test_years_are_pinned_and_exempt_sites_stay(spark):
    points = spark.createDataFrame(
        [("a", 0.5, 0.5), ("b", 1.5, 0.5), ("far", 9.0, 9.0)], "point_id string, lon double, lat double"
    )
    regions = spark.createDataFrame(
        [("x", [0.0, 0.0, 2.0, 1.0], [2017, 2019]), ("y", [1.0, 0.0, 2.0, 1.0], [2018])],
        "id string, bbox array<double>, years array<int>"
    )
    rows = spark.createDataFrame(
        [(p, y) for p in ("a", "b", "far") for y in range(2016, 2021)], "point_id string, year int"
    )
    got = sorted(map(tuple, ob.pin_years(rows, points, regions).collect()))
    assert got == [("a", 2017), ("a", 2018), ("a", 2019), ("b", 2018), *(("far", y) for y in range(2016, 2021))]
    many = spark.range(20).select(
        F.format_string("s%02d", "id").alias("point_id"), F.lit(0.0).alias("lon"),
        F.col("id").cast("double").alias("lat")
    )
    kept = {r.point_id for r in ob.every_nth_point(many, 5, exempt=F.col("point_id") < "s03").collect()}
    assert kept == {"s00", "s01", "s02", "s03", "s08", "s13", "s18"}
