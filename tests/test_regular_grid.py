import pytest

from gridwake.operators.regular_grid import regularise

SCHEMA = "src string, t double, v double, id long, cell string, rid string"


def grid(spark, data, **kw):
    real = lambda x: None if x is None else float(x)
    df = spark.createDataFrame([(s, real(t), real(v), i, "clash", "clash") for s, t, v, i in data], SCHEMA)
    return {
        (r.src, r.cell): (r.increment, r.covered, r.missing) for r in regularise(df, ["src"], "t", "v", **kw).collect()
    }


def test_increments_are_shared_by_overlap(spark):
    got = grid(spark, [("a", 5, 100, 1), ("a", 25, 140, 2)], step=10)
    assert got == {("a", 0): (10.0, 5.0, False), ("a", 1): (20.0, 10.0, False), ("a", 2): (10.0, 5.0, False)}


def test_resets(spark):
    got = grid(spark, [("a", 0, 90, 1), ("a", 10, 100, 2), ("a", 20, 7, 3)], step=10)
    assert got == {("a", 0): (10.0, 10.0, False), ("a", 1): (7.0, 10.0, False)}


def test_uncovered_cells_are_marked(spark):
    got = grid(spark, [("a", 1, 1, 1), ("a", 45, 2, 2)], step=16, max_span=1, delta=True)
    assert got == {("a", 0): (1.0, 1.0, False), ("a", 1): (None, 0.0, True), ("a", 2): (2.0, 1.0, False)}


def test_edges_ties_and_repeats(spark):
    data = [
        ("a", 16, 1, 1), ("a", 16, 1, 1), ("a", 16, 1, 2), ("a", 17, 1, 3), (None, 3, 1, 4), ("b", None, 1, 5),
        ("b", 1, None, 6), ("b", float("nan"), 1, 7)
    ]
    got = grid(spark, data, step=16, max_span=1, delta=True, rec_id="id")
    assert got == {("a", 0): (2.0, 1.0, False), ("a", 1): (1.0, 1.0, False), (None, 0): (1.0, 1.0, False)}


def test_empty_and_single(spark):
    assert grid(spark, [], step=1) == {}
    assert grid(spark, [("a", 1, 1, 1)], step=1) == {}


def test_totals_agree(spark):
    data = [("a", float(t), float(v), t) for t, v in zip(range(0, 200, 7), range(0, 2900, 100))]
    got = grid(spark, data, step=16)
    assert sum(x[0] for x in got.values()) == pytest.approx(data[-1][2]) and not any(x[2] for x in got.values())
