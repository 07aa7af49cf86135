"""Rows that are delivered again count once, in every keyed table and in the SQL texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridwake.operators import observations as ob
from gridwake.plans import base


@pytest.mark.parametrize("name", list(base.KEYS))
def test_each_key_counts_once(spark, tmp_path, name):
    key, by = base.KEYS[name]
    kind = "string" if name == "science_points" else "long"
    rows = [(1, 5, 2, 0.1), (1, 5, 1, 0.2), (1, 7, 3, 0.3), (2, 5, 1, 0.4), (2, 5, 1, 0.4), (None, 5, 1, 0.5)]
    df = spark.createDataFrame(rows, "k int, x int, day int, y double")
    df = df.select(
        F.col("k").cast(kind).alias(key), "x", "y",
        F.make_timestamp(F.lit(2020), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("loaded_at")
    )
    df = df if by else df.drop("loaded_at")
    df.repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((int(r[key]), r.x, r.y) for r in base.table(spark, str(tmp_path), name).collect())
    assert got == [(1, 7, 0.3), (2, 5, 0.4)]
    text = base.once(f"SELECT * FROM {name} JOIN other USING (id)")
    assert f"PARTITION BY {key} ORDER BY" in text and "JOIN other" in text


def test_a_key_with_a_third_of_all_rows_is_reduced_before_the_shuffle(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("obs_id"), F.lit("v").alias("v"),
        F.timestamp_seconds("id").alias("loaded_at")
    )
    once = ob.latest_delivery(df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert once.count() == 2001
    assert once.where("obs_id = 0").first().loaded_at == datetime(1970, 1, 1, 0, 49, 57)


def test_unknown_moments_lose_to_known_ones(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, datetime(2020, 1, 1), "b"), (2, None, "c")], "obs_id long, loaded_at timestamp, v string"
    )
    assert sorted((r.obs_id, r.v) for r in ob.latest_delivery(df).collect()) == [(1, "b"), (2, "c")]
    assert ob.latest_delivery(df.limit(0)).count() == 0
