import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from gridwake.operators import compaction as co

FILES = "file_id long, path string, year int, tile string, chunk_row int, chunk_col int, size_bytes long, value string"
ROWS = "file_id long, point_id string, date date, source string, value float, year int"
DAY = date(2020, 1, 1)


def files(spark, data):
    return spark.createDataFrame(data, FILES)


def test_paths_of_every_style(spark):
    data = [
        (1, "store/2020/56JFE/56JFE_r09_c07/f1.parquet", None, None, -1, -1, 1, ""),
        (2, "/mnt/pix/2020/53LMC/f2.53LMC_r01_c09.parquet", None, None, -1, -1, 1, ""),
        (3, "store\\2019\\55KNH\\55KNH_r08_c05\\f3.parquet", None, None, -1, -1, 1, ""),
        (4, "store/2023/55jee/55jee_r7_c7/f4.parquet", None, None, -1, -1, 1, ""), (5, None, 2021, "55abc", 3, 4, 1, "")
    ]
    got = {r.file_id: (r.tile, r.year, r.chunk_row, r.chunk_col) for r in co.chunk_files(files(spark, data)).collect()}
    assert got == {
        1: ("56JFE", 2020, 9, 7), 2: ("53LMC", 2020, 1, 9), 3: ("55KNH", 2019, 8, 5), 4: ("55JEE", 2023, 7, 7),
        5: ("55ABC", 2021, 3, 4)
    }


def test_redundant_files(spark):
    path = "s/2020/56JFE/56JFE_r09_c07/f.parquet"
    f = co.chunk_files(
        files(
            spark,
            [(i, path, None, None, 0, 0, 1, "") for i in (1, 2, 3, 4)]
            + [(5, "s/2021/56JFE/56JFE_r09_c07/f.parquet", None, None, 0, 0, 1, "")]
        )
    )
    rows = [
        (1, "p", DAY, "S1", 1.0, 0), (1, None, None, None, None, 0), (2, "p", DAY, "S1", 1.0, 0),
        (2, None, None, None, None, 0), (2, "p", DAY, "S1", 1.0, 0), (3, "p", DAY, "S2", 1.0, 0),
        (5, "p", DAY, "S1", 1.0, 0), (9, "p", DAY, "S1", 1.0, 0), (None, "p", DAY, "S1", 1.0, 0)
    ]
    records = co.plan_records(f, spark.createDataFrame(rows, ROWS))
    assert records.count() == 4
    assert sorted(r.file_id for r in co.redundant_files(f, records).collect()) == [2, 4]
    plan = {
        r.year: (r.n_files, r.n_records, r.rewrite, r.n_out)
        for r in co.plan_partitions(f, records, 100, 2, 2).collect()
    }
    assert plan == {2020: (4, 3, True, 2), 2021: (1, 1, False, 1)}


def test_empty(spark):
    f = co.chunk_files(files(spark, []))
    records = co.plan_records(f, spark.createDataFrame([], ROWS))
    assert records.count() == 0 and co.redundant_files(f, records).count() == 0


def written(spark, tmp_path):
    """Partitions 0 and 1 of many small files, 2 of one; four copies of each record."""
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    df = spark.range(600).select(
        (F.col("id") % 3).cast("int").alias("k"), (F.col("id") % 150).alias("rec"), F.col("id").alias("v")
    )
    co.append(spark, root, df.where("k < 2").repartition(8), ["k"])
    co.append(spark, root, df.where("k = 2").coalesce(1), ["k"])
    return root


def state(spark, root, version=None):
    t = co.read(spark, root, version)
    return {
        r.k: (r.n, r.d, r.f)
        for r in t.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("rec").alias("d"),
            F.countDistinct(F.col("_metadata.file_path")).alias("f")
        ).collect()
    }


def rewrite(spark, root, min_small=2, **kw):
    return co.compact(spark, root, ["k"], ["rec"], small_bytes=1 << 20, min_small=min_small, target_bytes=1 << 20, **kw)


def test_rewrites_only_crowded_partitions(spark, tmp_path):
    root = written(spark, tmp_path)
    before = state(spark, root)
    assert rewrite(spark, root) == 3
    after = state(spark, root)
    assert after[0] == after[1] == (50, 50, 1) and after[2] == before[2] == (200, 50, 1)
    assert {
        r.rec: r.v for r in co.read(spark, root).where("k < 2").collect()
    } == {i: i for i in range(150) if i % 3 < 2}  # the smallest copy stays
    assert state(spark, root, 2) == before  # the earlier snapshot is still whole
    assert rewrite(spark, root) == 3  # nothing more to do
    assert co.expire(spark, root) == 2 and state(spark, root) == after


def test_split_into_files_of_the_wanted_size(spark, tmp_path):
    root = written(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join parts as small as these
    try:
        co.compact(spark, root, ["k"], ["rec"], 1 << 20, 2, target_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    after = state(spark, root)
    assert after[0][:2] == after[1][:2] == (50, 50) and after[0][2] > 1


def test_rows_appended_meanwhile_stay(spark, tmp_path):
    root = written(spark, tmp_path)

    def rival():
        co.append(spark, root, spark.createDataFrame([(1, 9999, 7)], "k int, rec long, v long"), ["k"])

    assert rewrite(spark, root, before_commit=rival) == 4
    assert state(spark, root)[1] == (51, 51, 2)
    assert co.read(spark, root).where("rec = 9999").count() == 1


def test_two_rewrites_of_a_partition_conflict(spark, tmp_path):
    root = written(spark, tmp_path)
    before = co.read(spark, root).distinct().count()
    with pytest.raises(co.ConflictError):
        rewrite(spark, root, before_commit=lambda: rewrite(spark, root))
    assert state(spark, root)[0] == (50, 50, 1) and co.read(
        spark, root
    ).select("rec").distinct().count() == 150 and before == 600
    # What the loser wrote is in no snapshot, and goes away.
    assert co.expire(spark, root, older_than_s=-1) >= 2 and state(spark, root)[1] == (50, 50, 1)


def test_a_writer_that_dies_before_the_commit_leaves_everything(spark, tmp_path):
    root = written(spark, tmp_path)
    before = state(spark, root)

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        rewrite(spark, root, before_commit=dies)
    assert state(spark, root) == before
    assert rewrite(spark, root) == 3 and state(spark, root)[0] == (50, 50, 1)


def test_a_number_is_taken_once_and_entries_are_whole(spark, tmp_path):
    root = written(spark, tmp_path)
    log = co.SnapshotLog(spark, root)
    assert not log._claim({"partitions": {}}, 2) and log.read(2)["note"] == "append"
    assert [s.getPath().getName() for s in log.fs.listStatus(log.path) if "draft" in s.getPath().getName()] == []


def test_null_keys_odd_characters_and_empty_writes(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert co.append(spark, root, spark.createDataFrame([], "a string, b int, rec long, x string"), ["a", "b"]) == 1
    assert co.read(spark, root).count() == 0 and co.compact(spark, root, ["a", "b"], ["rec"], 1 << 20, 1, 1 << 20) == 1
    rows = [
        (a, b, r, "x") for a in ("p/q=1 *[z]", None, "56JFE") for b in (1, None) for r in (1, 2, None) for _ in range(2)
    ]
    co.append(
        spark, root, spark.createDataFrame(rows, "a string, b int, rec long, x string").repartition(4), ["a", "b"]
    )
    co.compact(spark, root, ["a", "b"], ["rec"], 1 << 20, 1, 1 << 20)
    assert sorted(map(tuple, co.read(spark, root).collect()), key=repr) == sorted(set(rows), key=repr)
