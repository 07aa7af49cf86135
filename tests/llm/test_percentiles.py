import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.llm.percentiles import order_statistics, percentiles, summary

SCHEMA = "g string, v double, n string, value string, _part string"


def frame(spark, data):
    return spark.createDataFrame([(g, v, "clash", "clash", "clash") for g, v in data], SCHEMA)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    data = [
        (g, float(v)) for g, n in (("hot", 3000), ("b", 7), ("c", 1), (None, 50)) for v in rng.normal(size=n).round(2)
    ]
    got = {
        r.g: r
        for r in percentiles(
            frame(spark, data).repartition(7), ["g"], "v", {"p25": 0.25, "p50": 0.5, "p95": 0.95}
        ).collect()
    }
    for g in ("hot", "b", "c", None):
        values = [v for k, v in data if k == g]
        assert (got[g].p25, got[g].p50, got[g].p95) == pytest.approx(
            tuple(np.quantile(values, (0.25, 0.5, 0.95)))
        ) and got[g].n_rows == len(values)


def test_summaries_of_days_combine(spark):
    a, b = [("x", float(v)) for v in range(10)], [("x", float(v)) for v in range(5, 30)]
    days = summary(frame(spark, a), ["g"], "v").unionByName(summary(frame(spark, b), ["g"], "v"))
    both = summary(days, ["g"], "value", "n")
    assert percentiles(both, ["g"], "value", {"m": 0.5}, "n").first().m == np.median([v for _, v in a + b])
    assert percentiles(
        summary(days, [], "value", "n"), [], "value", {"m": 0.5}, "n"
    ).first().m == np.median([v for _, v in a + b])


def test_nulls_ties_empty_and_whole_table(spark):
    data = [("a", None), ("a", float("nan")), ("b", 1.0), ("b", 1.0), ("b", 2.0), ("b", float("inf"))]
    df = frame(spark, data)
    assert [tuple(r) for r in percentiles(df, ["g"], "v", {"m": 1 / 3}).collect()] == [("b", 4, 1.0)]
    assert percentiles(frame(spark, []), ["g"], "v", {"m": 0.5}).count() == 0
    assert percentiles(frame(spark, []), [], "v", {"m": 0.5}).count() == 0
    assert percentiles(df, [], "v", {"m": 0.0}).first().m == 1.0
    ranks = order_statistics(
        df, ["g"], "v",
        {"one": lambda n: F.lit(1), "last": lambda n: n, "beyond": lambda n: n + 1, "none": lambda n: F.lit(None)}
    ).first()
    assert (ranks.one, ranks.last, ranks.beyond, ranks.none) == (1.0, float("inf"), None, None)


def test_one_value_in_a_third_of_all_rows(spark):
    df = spark.range(6000).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v")
    )
    values = [7.0 if i % 3 == 0 else float(i) for i in range(6000)]
    got = percentiles(df, ["g"], "v", {"p30": 0.3, "p50": 0.5}).first()
    assert (got.p30, got.p50) == pytest.approx(tuple(np.quantile(values, (0.3, 0.5))))
