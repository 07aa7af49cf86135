"""Moments stated in many formats and zones, as one UTC instant.

``parse_moments`` reads what a text says: a wall time and, where stated, an offset. ``to_instants`` turns wall
times into instants by an as-of join with the zone's offset intervals, exploded by year: two matching
intervals mean an ambiguous time, none a skipped one, one gives the offset directly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in seconds.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "AEST": 36000, "AEDT": 39600, "ACST": 34200, "ACDT": 37800, "AWST": 28800}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"(?:\s*(Z|UTC|GMT|AEST|AEDT|ACST|ACDT|AWST|[+-][0-9]{2}(?::?[0-9]{2})?))?"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?"
ISO = rf"(?i)^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:(?:T|\s+){_CLOCK}{_ZONE})?(?:/.*)?$"
COMPACT = rf"(?i)^([0-9]{{4}})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:T([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?{_ZONE})?$"
NUMERIC = rf"(?i)^([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-]([0-9]{{4}}|[0-9]{{2}})(?:,?\s+{_CLOCK}\s*([AP]\.?M\.?)?{_ZONE})?$"
NAMED = rf"(?i)^([0-9]{{1,2}})[\s-]+({'|'.join(MONTHS)})[a-z]*\.?,?[\s-]+([0-9]{{4}})(?:,?\s+{_CLOCK}\s*([AP]\.?M\.?)?{_ZONE})?$"
EPOCH = r"^-?(?!(?:1[5-9]|20)[0-9]{2}(?:0[1-9]|1[0-2])$)[0-9]{5,19}$"
DAY = 86_400_000_000


def parse_moments(
    df: DataFrame, text: str, month: str | None = None, wall: str = "wall_us", offset: str = "offset_s"
) -> DataFrame:
    """``df`` with the wall time (microseconds, as if UTC) and the stated offset (seconds, or null).

    Read are ISO dates and times (also compact, with fractions, as ranges: their first day), ``d/m/y`` and
    ``m/d/y`` with / . or -, named months, 12-hour clocks, and bare numbers since 1970 (seconds,
    milliseconds, microseconds or nanoseconds by their number of digits; at least five digits that name neither a
    compact date nor a year and month). Where day and month could be
    confused the column ``month`` decides; if it is null or fits neither, a 12-hour clock means m/d/y and
    anything else d/m/y. Two-digit years are 20xx. Null, empty and other texts, and days or times that don't
    exist, give null. All other columns pass through.
    """
    # One pass per text: each format's groups are put into one order, and the parts are read from that array.
    layouts = {
        "c": (COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8"), "i": (ISO, "$1|$2|$3|$4|$5|$6|$7||$8"),
        "n": (NUMERIC, "$3|$1|$2|$4|$5|$6|$7|$8|$9"), "w": (NAMED, "$3|$2|$1|$4|$5|$6|$7|$8|$9")
    }
    clean = F.regexp_replace(F.col(text), "^[\\s\u00a0]+|[\\s\u00a0]+$|[\u200b\u2060\ufeff]", "")
    work = df.withColumn("__t", clean)
    t = F.col("__t")
    kind = F.when(t.rlike(COMPACT), "c").when(t.rlike(EPOCH), "e").when(t.rlike(ISO), "i").when(
        t.rlike(NUMERIC), "n"
    ).when(t.rlike(NAMED), "w")
    work = work.withColumn("__k", kind)
    k = F.col("__k")
    flat = F.lit(None).cast("string")
    for name, (pattern, layout) in layouts.items():
        flat = F.when(k == name, F.regexp_replace(t, pattern, layout)).otherwise(flat)
    work = work.withColumn("__p", F.split(flat, r"\|", -1))
    part = lambda i: F.nullif(F.get("__p", F.lit(i)), F.lit(""))
    month_number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(1))).cast("string")
    numbers = {
        "y": part(0), "a": F.when(k == "w", month_number).otherwise(part(1)), "b": part(2), "h": part(3), "mi": part(4),
        "s": part(5)
    }
    work = work.withColumns(
        {f"__{n}": c.cast("int") for n, c in numbers.items()}
        | {
            "__f": part(6), "__half": F.upper(F.substring(part(7), 1, 1)),
            "__z": F.when(k == "e", "Z").otherwise(F.upper(part(8)))
        }
    )
    y, a, b, h, mi, s, f, half, z = (F.col(f"__{n}") for n in ("y", "a", "b", "h", "mi", "s", "f", "half", "z"))
    given = F.col(month).cast("int") if month else F.lit(None).cast("int")
    first = F.when(k != "n", True).when(a > 12, False).when(b > 12, True).when((given == a) & (given != b), True).when(
        (given == b) & (given != a), False
    ).otherwise(half.isNotNull())
    work = work.withColumn("__first", first)
    first = F.col("__first")
    hour = F.when(half.isNull(), h).when(~h.between(1, 12), 24).otherwise(h % 12 + F.when(half == "P", 12).otherwise(0))
    work = work.withColumns(
        {
            "__year": F.when((k == "n") & (y < 100), y + 2000).otherwise(y), "__month": F.when(first, a).otherwise(b),
            "__day": F.when(first, b).otherwise(a), "__hour": F.coalesce(hour, F.lit(0))
        }
    )
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", "__year", "__month", "__day"), "yyyy-MM-dd")
    micros = F.coalesce(F.substring(F.rpad(f, 6, "0"), 1, 6).cast("long"), F.lit(0))
    work = work.withColumns(
        {
            "__date": date,
            "__clock": (
                F.col("__hour").cast("long") * 3600 + F.coalesce(mi, F.lit(0)) * 60 + F.coalesce(s, F.lit(0))
            ) * 1_000_000
            + micros
        }
    )
    valid = (F.col("__hour") < 24) & (F.coalesce(mi, F.lit(0)) < 60) & (F.coalesce(s, F.lit(0)) < 60)
    told = F.when(valid, F.unix_date("__date").cast("long") * DAY + F.col("__clock"))
    number = t.try_cast("decimal(20,0)")
    size = F.length(F.regexp_replace(t, "^-", ""))
    counted = F.when(
        size <= 11, number * 1_000_000
    ).when(size <= 14, number * 1000).when(size <= 17, number).otherwise(F.floor(number / 1000)).try_cast("long")
    named = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    digits = F.regexp_replace(z, "[^0-9]", "")
    stated = F.substring(digits, 1, 2).cast("int") * 3600 + F.coalesce(
        F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0)
    ) * 60
    seconds = F.when(z.startswith("-"), -stated).when(z.startswith("+"), stated).otherwise(F.try_element_at(named, z))
    out = work.withColumns({wall: F.when(k == "e", counted).otherwise(told), offset: seconds})
    return out.select(*[c for c in out.columns if c in df.columns or c in (wall, offset)])


def offset_periods(zone: str, first: int, last: int) -> list[tuple[int, int, int]]:
    """``(start, end, offset)`` in UTC seconds and seconds of the zone's periods between the years, to the second."""
    tz, epoch = ZoneInfo(zone), datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda s: int((epoch + timedelta(seconds=s)).astimezone(tz).utcoffset().total_seconds())
    begin, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (first, last + 1))
    periods, start, step, held = [], begin, 86_400 * 3, at(begin)
    for s in range(begin, end, step):
        after = at(s + step)
        if after != held:
            change = bisect_left(range(s, s + step), True, key=lambda x, o=held: at(x) != o) + s
            periods.append((start, change, held))
            start, held = change, after
    return [*periods, (start, end, held)]


#: Years of the interval table. Before the first no zone had changed its local mean time. From some year before 2100 on,
#: zones follow rules of month and weekday, which repeat with the calendar every 400 years; so later years
#: are looked up in the table's last 400.
FIRST_YEAR, LAST_YEAR, CYCLE = 1830, 2499, 400
CYCLE_US = 146_097 * DAY
LONG_AGO = -(1 << 62)


def zone_intervals(
    spark: SparkSession, zones: Iterable[str], first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> DataFrame:
    """Per zone and year of local time, the offset intervals that touch it or come before it.

    ``(zone, local_year, intervals)`` with intervals ``(lo, hi, offset_s)`` in wall microseconds. The first interval of a
    zone has no beginning. Unknown zones are left out. A narrower range than the default gives no instants outside it.
    """
    start = datetime(1970, 1, 1)
    new_year = [int((datetime(y, 1, 1) - start).total_seconds()) * 1_000_000 for y in range(first, last + 2)]
    rows = []
    for zone in sorted(set(zones)):
        try:
            periods = offset_periods(zone, first - 1, last + 1)
        except (KeyError, ValueError, OSError):
            continue
        local = [((s + o) * 1_000_000, (e + o) * 1_000_000, o) for s, e, o in periods]
        local[0] = (LONG_AGO, *local[0][1:])
        at = 0
        for year in range(first, last + 1):
            lo, hi = new_year[year - first], new_year[year - first + 1]
            while local[at][1] <= lo - 2 * DAY:
                at += 1
            near, k = [], at
            while k < len(local) and local[k][0] < hi + 2 * DAY:
                near.append(local[k])
                k += 1
            rows.append((zone, year, near))
    return spark.createDataFrame(
        rows, "zone string, local_year int, intervals array<struct<lo:long,hi:long,offset_s:int>>"
    )


def to_instants(
    df: DataFrame, zones: DataFrame, wall: str = "wall_us", offset: str = "offset_s", zone: str = "zone",
    utc: str = "utc_us", state: str = "zone_state"
) -> DataFrame:
    """``df`` with the UTC instant of each wall time, and how it was found.

    Every year has an instant: the zone's first offset holds for all time before it, and its last rule for all time after.
    States: ``stated`` (the offset was given), ``exact``, ``ambiguous`` (the earlier instant is taken),
    ``skipped`` (the offset in force before the change is used), ``unknown`` (no wall time, or neither an
    offset nor a known zone: the instant is null). No row is lost or doubled. The interval table is joined
    on zone and year, so each row meets the two or three intervals around it and nothing else.
    """
    year = F.year(F.timestamp_micros(F.col(wall)))
    turns = F.when(year > LAST_YEAR, F.ceil((year - LAST_YEAR) / CYCLE)).otherwise(0).cast("long")
    marked = df.withColumn("__turns", turns).withColumn(
        "__y", F.greatest(year - F.col("__turns") * CYCLE, F.lit(FIRST_YEAR)).cast("int")
    )
    renamed = zones.select(
        F.col("zone").alias("__zone"), F.col("local_year").alias("__ly"), F.col("intervals").alias("__iv")
    )
    joined = marked.join(
        renamed, (F.col(zone) == F.col("__zone")) & (F.col("__y") == F.col("__ly")) & F.col(offset).isNull(), "left"
    )
    t = F.col(wall)
    joined = joined.withColumn("__t", t - F.col("__turns") * CYCLE_US)
    hits = F.filter("__iv", lambda x: (x.lo <= F.col("__t")) & (F.col("__t") < x.hi))
    joined = joined.withColumn("__hits", hits)
    count = F.size("__hits")
    before = F.filter("__iv", lambda x: x.hi <= F.col("__t"))
    before = F.array_max(F.transform(before, lambda x: F.struct(x.hi.alias("hi"), x.offset_s.alias("offset_s"))))
    used = F.when(F.col(offset).isNotNull(), F.col(offset)).when(
        count >= 1, F.array_max(F.transform("__hits", lambda x: x.offset_s))
    ).when(count == 0, before.offset_s)
    name = F.when(t.isNull(), "unknown").when(
        F.col(offset).isNotNull(), "stated"
    ).when(
        F.col("__iv").isNull(), "unknown"
    ).when(count >= 2, "ambiguous").when(count == 1, "exact").otherwise("skipped")
    return joined.withColumn(utc, t - used.cast("long") * 1_000_000).withColumn(state, name).drop(
        "__y", "__turns", "__t", "__zone", "__ly", "__iv", "__hits"
    )
