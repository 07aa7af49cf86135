"""Queries take in their whole tables; the wanted rows are worked out here, apart from the queries' SQL."""

from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridwake.functions import indices

QUERIES = entry.queries()


def test_every_chunk_has_its_place(spark, tmp_path):
    chunks = [(i, 2019 + i % 3, ("56JFE", "56jfe", None)[i % 3], i % 7 - 1, i % 5 - 1) for i in range(1, 201)]
    spark.createDataFrame(
        chunks, "file_id long, year int, tile string, chunk_row int, chunk_col int"
    ).repartition(3).write.parquet(f"{tmp_path}/chunk_reports.parquet")
    want = {c[0]: n for n, c in enumerate(sorted(chunks, key=lambda c: (c[3], c[4], c[0])), 1)}
    assert {r.file_id: r.place for r in QUERIES["srt_06"](spark, str(tmp_path)).collect()} == want


def test_readings_delivered_again_are_despeckled_once(spark, tmp_path):
    # Reading 3 comes three times, the last time corrected; its neighbours' medians reach over it.
    first = {1: 0.01, 2: 0.09, 3: 0.5, 4: 0.03, 5: 0.07, 6: 0.02}
    came = [*((i, v, 1) for i, v in first.items()), (3, 0.04, 3), (3, 0.6, 2)]
    other = ", ".join(f"{b} int" for b in indices.BANDS)
    given = spark.createDataFrame(
        [
            (
                i, "x", "x_presence_1_1", 140.0, -18.0, date(2020, 1, i), *[None] * len(indices.BANDS), "S1", v, 2 * v,
                datetime(2020, 3, day)
            )
            for i,
            v, day in came
        ],
        f"obs_id long, region_id string, point_id string, lon float, lat float, date date, {other}, source string, "
        f"vh float, vv float, loaded_at timestamp",
    )
    given.repartition(3).write.parquet(f"{tmp_path}/observations.parquet")
    vh = {**first, 3: 0.04}
    want = {i: median(vh[k] for k in range(i - 2, i + 3) if k in vh) for i in vh}
    got = QUERIES["win_01"](spark, str(tmp_path)).collect()
    assert sorted(r.obs_id for r in got) == sorted(vh)
    assert {r.obs_id: (r.vh, r.vv) for r in got} == {i: pytest.approx((v, 2 * v), abs=1e-7) for i, v in want.items()}


# Three batches of 16 files: Spark drops rows by the watermark of the batch before the last, so from the third on.
def test_streams_count_late_events_of_later_batches(spark, tmp_path):
    events = [(datetime(2024, 1, 1) + timedelta(minutes=97 * i % 43_200), "abc"[i % 3]) for i in range(800)]
    spark.createDataFrame(
        events, "ts timestamp_ntz, event_type string"
    ).repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    assert len(list(Path(f"{tmp_path}/events.parquet").glob("*.parquet"))) == 40
    got = QUERIES["stream_02"](spark, str(tmp_path)).select(
        F.date_format("hour", "yyyy-MM-dd HH"), "event_type", "n"
    ).collect()
    assert sorted(map(tuple, got)) == sorted(
        (*k, n) for k, n in Counter((f"{t:%Y-%m-%d %H}", e) for t, e in events).items()
    )


def test_streams_deliver_late_observations_once(spark, tmp_path):
    # Every file holds dates of many years, and each observation comes again in the next file.
    rows = [
        ((i + again) % 39, i, "p", date(1985, 1, 1) + timedelta(days=71 * i % 14_000), "S2") for i in range(400)
        for again in (0, 1)
    ]
    df = spark.createDataFrame(rows, "file int, obs_id long, point_id string, date date, source string")
    df.repartitionByRange(39, "file").drop("file").write.parquet(f"{tmp_path}/observations.parquet")
    assert len(list(Path(f"{tmp_path}/observations.parquet").glob("*.parquet"))) == 39
    assert sorted(r.obs_id for r in QUERIES["stream_01"](spark, str(tmp_path)).collect()) == list(range(400))


def test_empty_files_and_least_radar_readings(spark, tmp_path):
    # File 1: two rows of the grid, the second seen on three of four dates. File 2: both on all four. File 3: no radar. File 4: no records.
    seen = {1: {1: (1, 2, 3, 4), 2: (1, 2, 3)}, 2: {1: (1, 2, 3, 4), 2: (1, 2, 3, 4)}}
    rows = [
        (f, f"x_1_{y}", date(2020, 1, day), "S1", 0.1) for f, by_row in seen.items() for y,
        days in by_row.items() for day in days
    ] + [(3, "x_1_1", date(2020, 1, 1), "S2", 0.1)]
    spark.createDataFrame(
        rows, "file_id long, point_id string, date date, source string, value double"
    ).write.parquet(f"{tmp_path}/chunk_rows.parquet")
    spark.createDataFrame(
        [(f,) for f in (1, 2, 3, 4)], "file_id long"
    ).write.parquet(f"{tmp_path}/chunk_reports.parquet")
    assert {
        r.file_id: r.verdict for r in QUERIES["dq_13"](spark, str(tmp_path)).collect()
    } == {1: "S1_INCOMPLETE", 2: "OK", 3: "S1_MISS", 4: "EMPTY"}
    columns = ("file_id", "n_points", "n_rows", "n_enough", "n_dates", "cover_median", "cover_max", "n_complete")
    want = [
        (1, 2, 2, 1, 4, 2.0, 2, 3), (2, 2, 2, 2, 4, 2.0, 2, 4), (3, 1, 1, 0, 0, None, None, 0),
        (4, 0, 0, 0, 0, None, None, 0)
    ]
    assert sorted(map(tuple, QUERIES["agg_20"](spark, str(tmp_path)).select(*columns).collect())) == want


def test_ranking_file_keeps_every_point_and_rounds_scaled_scores(spark, tmp_path):
    # B08 and B04 of each point; 0.81095 and 0.28855 lie below the half once scaled, 0.10545 does not. Two have no score.
    bands = {
        "dark": (0, 0), " up": (557, 1000), "b": (525, 500), "": (557, 1000), "c": (2091, 500), "a": (525, 500),
        None: (2091, 500), "bare": (None, None)
    }
    other = [b for b in indices.BANDS if b not in ("B08", "B04")]
    spark.createDataFrame(
        [
            (
                i, "x", p, 140.0, -18.0, date(2020, 1, i), *b, *[None] * len(other), "S2", 1, None, None, None,
                datetime(2020, 3, 1)
            )
            for i,
            (p, b) in enumerate(bands.items(), 1)
        ],
        f"obs_id long, region_id string, point_id string, lon float, lat float, date date, B08 int, B04 int, "
        f"{', '.join(f'{b} int' for b in other)}, source string, scl_purity byte, vh float, vv float, NDVI float, "
        f"loaded_at timestamp",
    ).repartition(3).write.parquet(f"{tmp_path}/observations.parquet")
    got = QUERIES["snk_05"](spark, str(tmp_path)).select("rank", "point_id", "score").collect()
    assert [tuple(r) for r in got] == [
        (1, "c", 0.8109), (2, None, 0.8109), (3, "a", 0.2885), (4, "b", 0.2885), (5, "", 0.1055), (6, " up", 0.1055),
        (7, "bare", None), (8, "dark", None)
    ]
