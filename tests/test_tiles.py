import numpy as np
from pyspark.sql import functions as F

from gridwake.functions import geodesy
from gridwake.operators.tiles import keep_needed, needed_tiles


def test_only_needed_tiles_stay():
    area = np.array([0.0, 0.0, 10.0, 4.0])
    left, right, middle = [-1, -1, 6, 5], [5, -1, 11, 5], [4, -1, 7, 5]
    tiles = np.array([left, middle, right], float)
    assert list(keep_needed(area, tiles)) == [True, False, True]
    assert list(keep_needed(area, tiles[:1])) == [True]
    assert list(keep_needed(area, np.array([left, left], float))) == [False, True]  # of two alike the last stays
    assert list(keep_needed(area, np.array([left, [20, 20, 30, 30]], float))) == [True, False]


def test_what_stays_covers_what_was_covered():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lo = rng.uniform(0, 8, (9, 2))
        tiles = np.hstack([lo, lo + rng.uniform(1, 5, (9, 2))])
        area = np.array([1.0, 1.0, 9.0, 9.0])
        kept = keep_needed(area, tiles)
        spots = rng.uniform(1, 9, (400, 2))
        held = ((spots[:, None, :] > tiles[None, :, :2]) & (spots[:, None, :] < tiles[None, :, 2:])).all(axis=2)
        assert (held.any(axis=1) == held[:, kept].any(axis=1)).all()


def test_tiles_by_area(spark):
    rows = [
        (a, t, 0.0, 0.0, 10.0, 4.0, *box) for a in ("x", "y") for t,
        box in (("l", (-1.0, -1.0, 6.0, 5.0)), ("m", (4.0, -1.0, 7.0, 5.0)), ("r", (5.0, -1.0, 11.0, 5.0)))
    ]
    df = spark.createDataFrame(
        rows,
        "id string, tile_id string, bw double, bs double, be double, bn double, w double, s double, e double, n double"
    )
    assert sorted(map(tuple, needed_tiles(df).collect())) == [("x", "l"), ("x", "r"), ("y", "l"), ("y", "r")]
    assert needed_tiles(df.limit(0)).count() == 0


def test_the_projection_turns_back(spark):
    df = spark.createDataFrame(
        [(138.9, -24.2), (141.0, -18.0), (146.4, -13.4), (143.9999, -0.01)], "lon double, lat double"
    ).withColumn("zone", geodesy.utm_zone(F.col("lon")))
    there = geodesy.with_utm(df, F.col("lon"), F.col("lat"), F.col("zone"), "x", "y")
    plain = geodesy.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    there = there.withColumns({"px": plain[0], "py": plain[1]})
    back = geodesy.with_degrees(there, F.col("x"), F.col("y"), F.col("zone"), F.lit(True), "lon_again", "lat_again")
    for r in back.collect():
        assert abs(r.lon - r.lon_again) < 1e-8 and abs(r.lat - r.lat_again) < 1e-8
        assert abs(r.x - r.px) < 1e-6 and abs(r.y - r.py) < 1e-6
