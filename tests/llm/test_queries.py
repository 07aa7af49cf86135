"""The llm queries on the smallest tables; those with SQL against it, groups against a plain union-find."""

import os
import re
from collections import Counter

import duckdb
import pytest

from gridwake.llm import queries

FOLDER = os.environ.get("GRIDWAKE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("observations", "training_regions", "class_stats", "tam_samples", "science_points"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    key = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    got = Counter(key(r) for r in df.collect())
    assert got
    if name in queries.SQL:
        relation = duck.sql(queries.SQL[name])
        order = [relation.columns.index(c) for c in df.columns]
        assert got == Counter(key([r[i] for i in order]) for r in relation.fetchall())


def test_groups_against_union_find(spark, duck):
    root, names = {}, {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    norm = lambda s: "_".join(re.findall("[a-z0-9]+", s.lower()))
    for i, tags in duck.sql("SELECT id, tags FROM training_regions").fetchall():
        m = re.match("(.+?)_(presence|absence)", i)
        root[find(i)] = find("s:" + (re.sub("_val$", "", m[1]) if m else i))
        for t in tags or []:
            if t.lower().startswith("crew"):
                root[find(i)] = find("c:" + re.sub("[^a-z0-9]", "", t.lower()[4:]))
    for (i,) in duck.sql("SELECT id FROM training_regions").fetchall():
        names[find(i)] = min(i, names.get(find(i), i))
    points = {
        p: re.sub("[^a-z0-9]", "", (c or "").lower()) or p for p,
        c in duck.sql("SELECT DISTINCT point_id, recordedBy FROM science_points").fetchall()
    }
    want = {
        s: points.get(norm(p)) or names[find(re.sub(r"_\d+_\d+$", "", norm(p)))] for s,
        p in duck.sql("SELECT DISTINCT sample_id, point_id FROM tam_samples").fetchall()
    }
    assert {r.sample_id: r.grp for r in queries.p1_found(spark, FOLDER).collect()} == want


def test_a_group_has_one_split(spark):
    from pyspark.sql import functions as F

    assert queries.p1_splits(spark, FOLDER).groupBy("grp").agg(
        F.countDistinct("split").alias("n")
    ).where("n > 1").count() == 0
