from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from gridwake.operators.timestamps import offset_periods, parse_moments, to_instants, zone_intervals

SYD = "Australia/Sydney"


def us(*a, zone="UTC", fold=0):
    d = datetime(*a, tzinfo=ZoneInfo(zone), fold=fold)
    return round((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


CASES = [
    ("2010-01-14T05:12:36", None, SYD, us(2010, 1, 14, 5, 12, 36, zone=SYD)),
    ("2010-01-14T05:12:36Z", None, SYD, us(2010, 1, 14, 5, 12, 36)),
    (" 2010-01-13 ", None, SYD, us(2010, 1, 13, zone=SYD)),
    ("2010-01-22/2010-01-28", None, SYD, us(2010, 1, 22, zone=SYD)),
    ("02/01/2010 02:09", 1, SYD, us(2010, 1, 2, 2, 9, zone=SYD)),
    ("02/01/2010 02:09", 2, SYD, us(2010, 2, 1, 2, 9, zone=SYD)),
    ("26/09/2024 05:39", 3, SYD, us(2024, 9, 26, 5, 39, zone=SYD)),
    ("1/27/2010 5:44 PM", None, SYD, us(2010, 1, 27, 17, 44, zone=SYD)),
    ("3/10/2010 12:12 AM", None, SYD, us(2010, 3, 10, 0, 12, zone=SYD)),
    ("06.01.10", None, SYD, us(2010, 1, 6, zone=SYD)),
    ("11 Jan 2010 10:53", None, "Etc/UTC", us(2010, 1, 11, 10, 53)),
    ("06 Jan 2010 23:59:44 ACST", None, SYD, us(2010, 1, 6, 14, 29, 44)),
    ("20100127T003536Z", None, SYD, us(2010, 1, 27, 0, 35, 36)),
    ("2010-01-14 05:20:59.749574+11:00", None, SYD, us(2010, 1, 13, 18, 20, 59, 749574)),
    ("2010-01-08T08:08:01+1100", None, SYD, us(2010, 1, 7, 21, 8, 1)),
    ("2010-06-27T21:22-05:00", None, SYD, us(2010, 6, 28, 2, 22)),
    ("1264394938495", None, SYD, 1264394938495000),
    ("1263995069", None, SYD, 1263995069000000),
    ("2021-04-04T02:30:00", None, SYD, us(2021, 4, 4, 2, 30, zone=SYD)),  # twice: the earlier
    ("2021-10-03T02:30:00", None, SYD, us(2021, 10, 3, 2, 30) - 36_000_000_000),  # skipped: offset before the change
    ("1850-03-01 12:00:00", None, SYD, us(1850, 3, 1, 12, zone=SYD)),
    ("1898-05-04 10:00:00", None, SYD, us(1898, 5, 4, 10, zone=SYD)),
    ("1776-07-04", None, SYD, us(1776, 7, 4, zone=SYD)),
    ("2150-01-15 12:00:00", None, SYD, us(2150, 1, 15, 12, zone=SYD)),
    ("2150-07-15 12:00:00", None, SYD, us(2150, 7, 15, 12, zone=SYD)),
    ("2499-12-31 23:00:00", None, SYD, us(2499, 12, 31, 23, zone=SYD)),
    ("2777-01-15 12:00:00", None, SYD, us(2777, 1, 15, 12, zone=SYD)),
    ("9998-07-15 12:00:00", None, SYD, us(9998, 7, 15, 12, zone=SYD)),
    ("9998-01-15", None, SYD, us(9998, 1, 15, zone=SYD)),
    ("86400", None, SYD, 86_400_000_000), ("12345678", None, SYD, 12_345_678_000_000),
    ("-86400", None, SYD, -86_400_000_000), ("201706", None, SYD, None), ("20170631", None, SYD, None),
    ("1234", None, SYD, None),
    ("2022-06", None, SYD, None), ("2017", None, SYD, None), ("spring 2017", None, SYD, None),
    ("??/??/2015", None, SYD, None), ("n/a", None, SYD, None), ("", None, SYD, None), (None, None, SYD, None),
    ("2021-02-30", None, SYD, None), ("2021-01-01T25:00:00", None, SYD, None), ("31/31/2020 10:00", None, SYD, None),
    ("2021-01-01", None, None, None), ("2021-01-01", None, "No/Where", None),
    ("2021-01-01T00:00:00Z", None, None, us(2021, 1, 1)), ("x" * 100_000, None, SYD, None),
]


@pytest.fixture(scope="module")
def placed(spark):
    df = spark.createDataFrame(
        [(i, t, m, z, "clash") for i, (t, m, z, _) in enumerate(CASES)],
        "i int, text string, month int, zone string, intervals string"
    )
    zones = zone_intervals(spark, [SYD, "Etc/UTC", "No/Where"])
    return {r.i: r for r in to_instants(parse_moments(df, "text", "month"), zones).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_formats(placed, i):
    assert placed[i].utc_us == CASES[i][3], CASES[i]
    assert placed[i].intervals == "clash"


def test_states(placed):
    by = {CASES[i][0]: r.zone_state for i, r in placed.items()}
    assert by["2021-04-04T02:30:00"] == "ambiguous" and by["2021-10-03T02:30:00"] == "skipped"
    assert by["2010-01-14T05:12:36"] == "exact" and by["2010-01-14T05:12:36Z"] == "stated" and by["n/a"] == "unknown"


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, month int, zone string")
    assert to_instants(parse_moments(df, "text", "month"), zone_intervals(spark, [SYD], 2020, 2021)).count() == 0


def test_periods_are_exact():
    p = offset_periods(SYD, 2021, 2021)
    assert len(offset_periods("Etc/UTC", 1900, 2100)) == 1
    assert [o for _, _, o in p] == [39600, 36000, 39600] and p[0][1] == us(2021, 4, 3, 16) // 10**6
