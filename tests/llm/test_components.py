import random

import pytest
from pyspark.sql import functions as F

from gridwake.llm.components import connected_components, split_groups


def groups(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.component, set()).add(r.vertex)
    return sorted(map(sorted, by.values()))


def plain(edges, extra=()):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[find(a)] = find(b)
    for x in extra:
        find(x)
    by = {}
    for x in list(root):
        by.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, by.values()))


def frame(spark, edges):
    return spark.createDataFrame(
        [(a, b, "clash", "clash") for a, b in edges], "a string, b string, u string, component string"
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_a_hub_and_a_path(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    edges += [("hub", f"h{i}") for i in range(100)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    edges += edges[:10] + [("x", None), (None, None), ("loop", "loop")]
    assert groups(connected_components(frame(spark, edges))) == plain(edges)


def test_isolated_and_empty(spark):
    lone = spark.createDataFrame([("z",), ("z",), (None,)], "vertex string")
    assert groups(connected_components(frame(spark, []), lone)) == [["z"]]
    assert connected_components(frame(spark, [])).count() == 0
    assert groups(connected_components(frame(spark, [("a", "b")]), lone)) == [["a", "b"], ["z"]]


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_split_shares(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("g"), "id").alias("g"), (F.col("id") % 5 + 1).alias("w"), F.lit("clash").alias("split")
    )
    df = df.unionByName(
        spark.createDataFrame(
            [("giant", 4500, ""), (None, 9, ""), ("none", None, "")], "g string, w long, split string"
        )
    )
    out = {r.g: (r.w, r.split) for r in split_groups(df, "g", "w", SHARES).collect()}
    total = sum(w for w, _ in out.values())
    assert None not in out and len(out) == 3002 and out["giant"][1] == "train"
    for name, share in SHARES.items():
        assert abs(sum(w for w, s in out.values() if s == name) / total - share) < 0.01
    assert out == {r.g: (r.w, r.split) for r in split_groups(df.repartition(3), "g", "w", SHARES).collect()}


def test_split_empty(spark):
    assert split_groups(spark.createDataFrame([], "g string, w long"), "g", "w", SHARES).count() == 0
