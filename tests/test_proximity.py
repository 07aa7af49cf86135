import numpy as np
from pyspark.sql import functions as F

from gridwake.operators.proximity import EARTH_M, SlabIndex, locate_in_boxes, locate_in_polygons, near_points


def level(boxes):
    """Boxes (x_lo, y_lo, x_hi, y_hi) as trapezoids with level edges."""
    return boxes[:, [0, 2, 1, 1, 3, 3]]


def pairs(index, points, **kw):
    return {
        (int(i), int(j)) for found, traps in index.locate(points[:, 0].copy(), points[:, 1].copy(), **kw) for i,
        j in zip(found, traps)
    }


def test_slabs_against_brute_force():
    rng = np.random.default_rng(5)
    lo = rng.integers(0, 20, (60, 2)).astype(float)
    boxes = np.hstack([lo, lo + rng.integers(0, 8, (60, 2))])
    points = rng.integers(-1, 30, (500, 2)) / 1.0
    points = np.vstack([points, points + 0.5])
    want = {
        (i, j) for i, (x, y) in enumerate(points) for j,
        b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3]
    }
    assert pairs(SlabIndex(level(boxes)), points) == want
    assert pairs(SlabIndex(level(boxes)), points, most=7) == want


def test_boxes_heaped_on_one_place_stay_small():
    import tracemalloc

    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1e-4, (5000, 2))
    boxes = np.hstack([centre - 1.5e-3, centre + 1.5e-3])
    points = rng.normal(0, 1e-3, (400, 2))
    tracemalloc.start()
    found = sum(len(a) for a, _ in SlabIndex(level(boxes)).locate(points[:, 0].copy(), points[:, 1].copy()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(
        int(((boxes[:, 0] <= x) & (x <= boxes[:, 2]) & (boxes[:, 1] <= y) & (y <= boxes[:, 3])).sum()) for x,
        y in points
    )
    assert peak < 200 << 20


def crossings(x, y, rings):
    return sum(
        1 for r in rings for (x1, y1),
        (x2, y2) in zip(r, r[1:] + r[:1]) if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    )


def test_polygons_with_slopes_holes_and_odd_rings(spark):
    star = [
        [float(np.cos(a) * r + 3), float(np.sin(a) * r + 3)] for k,
        a in enumerate(np.linspace(0, 2 * np.pi, 14, endpoint=False)) for r in [3.0 if k % 2 else 1.2]
    ]
    hole = [[2.7, 2.7], [3.3, 2.8], [3.1, 3.4]]
    wide = [[-40.0, 0.5], [40.0, 1.5], [40.0, 2.5], [-40.0, 1.0]]
    shapes = {
        "star": [star, hole], "wide": [wide], "flat": [[[0.0, 0.0], [1.0, 0.0]]], "none": None,
        "bad": [[[0.0, 0.0], None, [1.0, 1.0]]]
    }
    polygons = spark.createDataFrame(list(shapes.items()), "bid string, rings array<array<array<double>>>")
    rng = np.random.default_rng(8)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 7, (900, 2)))]
    got = {
        tuple(r)
        for r in locate_in_polygons(
            spark.createDataFrame(spots, "pid int, x double, y double"), polygons, tile=0.5, salt_rows=50, slab_boxes=3
        ).collect()
    }
    want = {(i, n) for i, x, y in spots for n in ("star", "wide") if crossings(x, y, shapes[n]) % 2}
    assert got == want and len(want) > 100


def boxes_of(spark, data):
    return spark.createDataFrame(data, "bid string, x_lo double, y_lo double, x_hi double, y_hi double, tx string")


def points_of(spark, data):
    return spark.createDataFrame(data, "pid long, x double, y double, tx string")


def test_boxes_with_nulls_edges_and_salting(spark, rows):
    p = points_of(
        spark,
        [(i, float(i % 7), float(i % 5), "c") for i in range(200)]
        + [(900, None, 1.0, "c"), (901, float("nan"), 1.0, "c")]
    )
    b = boxes_of(
        spark,
        [
            ("a", 0.0, 0.0, 3.0, 3.0, "c"), ("b", 3.0, 3.0, 3.0, 3.0, "c"), ("bad", 5.0, 0.0, 1.0, 9.0, "c"),
            ("null", None, 0.0, 1.0, 9.0, "c"), ("wide", -50.0, 2.0, 50.0, 2.5, "c")
        ]
    )
    want = sorted(
        (
            (i, n) for i in range(200) for n,
            (x0, y0, x1, y1) in {"a": (0, 0, 3, 3), "b": (3, 3, 3, 3), "wide": (-50, 2, 50, 2.5)}.items()
            if x0 <= i % 7 <= x1 and y0 <= i % 5 <= y1
        ),
        key=repr
    )
    assert rows(locate_in_boxes(p, b)) == want
    assert rows(locate_in_boxes(p, b, tile=2.0, salt_rows=3, slab_boxes=2)) == want


def test_empty(spark):
    assert locate_in_boxes(points_of(spark, []), boxes_of(spark, [("a", 0.0, 0.0, 1.0, 1.0, "")])).count() == 0
    assert locate_in_boxes(points_of(spark, [(1, 0.0, 0.0, "")]), boxes_of(spark, [])).count() == 0


def haversine(a, b):
    (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(min(h, 1)))


def test_near_points_everywhere(spark, rows):
    rng = np.random.default_rng(9)
    centres = [(0, 0), (180, 10), (-180, -40), (30, 89.9995), (10, -90), (140, -20)]
    spots = [
        (float(c[0] + rng.normal(0, 0.002)), float(np.clip(c[1] + rng.normal(0, 0.002), -90, 90))) for c in centres
        for _ in range(25)
    ]
    left, right = spots[::2] + [(0.0, 0.0)], spots[1::2] + [(0.0, 0.0), (360.0, 0.0)]
    df = lambda name, data: spark.createDataFrame(
        [(i, *s) for i, s in enumerate(data)], f"{name} int, lon double, lat double"
    )
    p = df("pid", left).union(
        spark.createDataFrame([(9000, None, 1.0), (9001, 0.0, 95.0)], "pid int, lon double, lat double")
    )
    want = sorted(((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if haversine(a, b) <= 150), key=repr)
    assert want and rows(near_points(p, df("bid", right), 150.0)) == want


def test_crowd_in_one_place(spark):
    p = spark.range(3000).select(F.col("id").alias("pid"), F.lit(140.0).alias("lon"), F.lit(-20.0).alias("lat"))
    o = spark.createDataFrame([("a", 140.0, -20.0)], "bid string, lon double, lat double")
    assert near_points(p, o, 150.0).count() == 3000
