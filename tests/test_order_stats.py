import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators.order_stats import order_statistics, percentiles, running_totals, value_counts

SCHEMA = "g string, v double, n string, value string"


def frame(spark, data):
    return spark.createDataFrame([(g, v, "clash", "clash") for g, v in data], SCHEMA)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    data = [
        (g, float(v)) for g, n in (("hot", 3000), ("b", 7), ("c", 1), (None, 50)) for v in rng.normal(size=n).round(2)
    ]
    counts = value_counts(frame(spark, data).repartition(7), ["g"], "v")
    got = {r.g: r for r in percentiles(counts, ["g"], {"p25": 0.25, "p50": 0.5, "p95": 0.95}).collect()}
    for g in ("hot", "b", "c", None):
        values = [v for k, v in data if k == g]
        assert (got[g].p25, got[g].p50, got[g].p95) == pytest.approx(
            tuple(np.quantile(values, (0.25, 0.5, 0.95)))
        ) and got[g].n_rows == len(values)


def test_summaries_combine(spark):
    a, b = [("x", float(v)) for v in range(10)], [("x", float(v)) for v in range(5, 30)]
    both = value_counts(
        value_counts(frame(spark, a), ["g"], "v").unionByName(value_counts(frame(spark, b), ["g"], "v")), ["g"],
        "value", "n"
    )
    assert percentiles(both, ["g"], {"m": 0.5}).first().m == np.median([v for _, v in a + b])


def test_nulls_ties_empty_and_whole_table(spark):
    data = [("a", None), ("a", float("nan")), ("b", 1.0), ("b", 1.0), ("b", 2.0)]
    counts = value_counts(frame(spark, data), ["g"], "v")
    assert [tuple(r) for r in percentiles(counts, ["g"], {"m": 0.5}).collect()] == [("b", 3, 1.0)]
    assert percentiles(value_counts(frame(spark, []), ["g"], "v"), ["g"], {"m": 0.5}).count() == 0
    assert percentiles(value_counts(frame(spark, data), [], "v"), [], {"m": 0.5}).first().m == 1.0
    ranks = order_statistics(
        counts, ["g"], {"first": lambda n: F.lit(1), "beyond": lambda n: n + 1, "none": lambda n: F.lit(None)}
    ).first()
    assert (ranks.first, ranks.beyond, ranks.none) == (1.0, None, None)


def test_running_totals(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.lit(2).cast("long").alias("a")
    )
    got = {(r.g, r.o): r.upto for r in running_totals(df, ["g"], ["o"], "a").collect()}
    assert all(v == 2 * (o // 3 + 1) for (_, o), v in got.items()) and len(got) == 1000
    assert sorted(r.upto for r in running_totals(df, [], ["o"], "a").collect()) == [2 * i for i in range(1, 1001)]
