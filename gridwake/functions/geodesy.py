"""Column builders for map projections and tile arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLATTENING, K0 = 6_378_137.0, 1 / 298.257223563, 0.9996
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)


def epsg_of_tile(tile: Column) -> Column:
    """From a grid tile's name; bands before N are south."""
    return F.when(F.substring(tile, 3, 1) < "N", 32700).otherwise(32600) + F.substring(tile, 1, 2).try_cast("int")


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres by the transverse Mercator series; southern northings have 10,000 km added."""
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    n = A / F.sqrt(1 - E2 * s * s)
    g = EP2 * c * c
    a = c * F.radians(lon - (zone * 6 - 183))
    arc = A * (
        (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (
            3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
        ) * F.sin(2 * phi)
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi)
    )
    east = K0 * n * (
        a + (1 - t + g) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * g - 58 * EP2) * F.pow(a, 5) / 120
    ) + 500_000
    north = K0 * (
        arc
        + n * F.tan(phi) * (
            a * a / 2 + (5 - t + 9 * g + 4 * g * g) * F.pow(a, 4) / 24
            + (61 - 58 * t + t * t + 600 * g - 330 * EP2) * F.pow(a, 6) / 720
        )
    )
    return east, F.when(lat < 0, north + 10_000_000).otherwise(north)


def _held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that come out of a generator of one row.

    A filter on a plain column is pushed below its projection and there written out as the column's whole expression, steps and all;
    it isn't pushed below a generator.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_utm(df: DataFrame, lon: Column, lat: Column, zone: Column, east: str, north: str) -> DataFrame:
    """``df`` with the projected place, by ``utm`` in steps: values used often are columns of their own, so that no tree grows."""
    df = df.withColumns({"_lon": lon, "_lat": lat, "_zone": zone, "_phi": F.radians(lat)})
    df = df.withColumns({"_s": F.sin("_phi"), "_c": F.cos("_phi"), "_tan": F.tan("_phi")})
    df = df.withColumns({"_t": F.col("_tan") * F.col("_tan"), "_g": EP2 * F.col("_c") * F.col("_c")})
    df = df.withColumns({
        "_n": A / F.sqrt(1 - E2 * F.col("_s") * F.col("_s")),
        "_a": F.col("_c") * F.radians(F.col("_lon") - (F.col("_zone") * 6 - 183)),
    })
    phi, tan, t, g, n, a = (F.col(c) for c in ("_phi", "_tan", "_t", "_g", "_n", "_a"))
    arc = A * (
        (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi
        - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi)
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi)
    )
    x = a + (1 - t + g) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * g - 58 * EP2) * F.pow(a, 5) / 120
    y = (
        a * a / 2 + (5 - t + 9 * g + 4 * g * g) * F.pow(a, 4) / 24
        + (61 - 58 * t + t * t + 600 * g - 330 * EP2) * F.pow(a, 6) / 720
    )
    shift = F.when(F.col("_lat") < 0, 10_000_000.0).otherwise(0.0)
    out = df.withColumns({east: K0 * n * x + 500_000, north: K0 * (arc + n * tan * y) + shift})
    return out.drop("_lon", "_lat", "_zone", "_phi", "_s", "_c", "_tan", "_t", "_g", "_n", "_a")


def with_degrees(df: DataFrame, x: Column, y: Column, zone: Column, south: Column, lon: str, lat: str) -> DataFrame:
    """``df`` with longitude and latitude of a projected place, by the series about the foot-point latitude, in steps."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = F.when(south, y - 10_000_000).otherwise(y) / (K0 * A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    df = df.withColumns({"_x": x, "_zone": zone, "_mu": mu})
    m = F.col("_mu")
    foot = (
        m + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * m) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * m)
        + 151 * e1**3 / 96 * F.sin(6 * m) + 1097 * e1**4 / 512 * F.sin(8 * m)
    )
    df = df.withColumn("_f", foot)
    df = df.withColumns({"_s": F.sin("_f"), "_c": F.cos("_f"), "_tan": F.tan("_f")})
    df = df.withColumns({
        "_t": F.col("_tan") * F.col("_tan"), "_g": EP2 * F.col("_c") * F.col("_c"),
        "_w": 1 - E2 * F.col("_s") * F.col("_s"),
    })
    df = df.withColumns({"_n": A / F.sqrt("_w"), "_r": A * (1 - E2) / F.pow("_w", 1.5)})
    df = df.withColumn("_d", (F.col("_x") - 500_000) / (F.col("_n") * K0))
    f, c, tan, t, g, n, r, d = (F.col(k) for k in ("_f", "_c", "_tan", "_t", "_g", "_n", "_r", "_d"))
    north = f - n * tan / r * (
        d * d / 2 - (5 + 3 * t + 10 * g - 4 * g * g - 9 * EP2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * g + 45 * t * t - 252 * EP2 - 3 * g * g) * F.pow(d, 6) / 720
    )
    east = (
        d - (1 + 2 * t + g) * F.pow(d, 3) / 6
        + (5 - 2 * g + 28 * t - 3 * g * g + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120
    ) / c
    out = df.withColumns({lon: F.degrees(east) + F.col("_zone") * 6 - 183, lat: F.degrees(north)})
    return out.drop("_x", "_zone", "_mu", "_f", "_s", "_c", "_tan", "_t", "_g", "_w", "_n", "_r", "_d")


def pixel_grid(boxes: DataFrame, resolution: float, zone: int | None = None) -> DataFrame:
    """Boxes ``(id, w, s, e, n)`` in degrees with their corners in metres, snapped down to the grid: x0, y0, x1, y1.

    The zone is that of the box's middle unless one is given.
    """
    at = F.lit(zone) if zone else utm_zone((F.col("w") + F.col("e")) / 2)
    df = boxes.withColumns({"zone": at, "south": (F.col("s") + F.col("n")) / 2 < 0})
    df = with_utm(df, F.col("w"), F.col("s"), F.col("zone"), "x0", "y0")
    df = with_utm(df, F.col("e"), F.col("n"), F.col("zone"), "x1", "y1")
    snap = lambda c: F.floor(c / resolution) * resolution
    df = _held(df, {c: F.col(c) for c in ("x0", "y0", "x1", "y1")})
    return df.withColumns({"xs": snap(F.col("x0")), "ys": snap(F.col("y0"))})


def chunk_grid(boxes: DataFrame, resolution: float, pixels: int, tile: float = 100_000.0) -> DataFrame:
    """The blocks of ``pixels`` x ``pixels`` that a box's pixels fall into, numbered from the tile's top left corner, row by row.

    ``boxes`` as for ``pixel_grid``; the tile is the square of ``tile`` metres that holds the box's corners. Adds chunk_row, chunk_col, x_left,
    y_lower (the block), tile_x, tile_y (the anchors), and the box of the block's pixels inside the bounds: px0, py0, px1, py1.
    """
    block = resolution * pixels
    g = pixel_grid(boxes, resolution).withColumns(
        {"tile_x": F.floor(F.col("x0") / tile) * tile, "tile_y": F.ceil(F.col("y1") / tile) * tile}
    )
    span = lambda lo, hi: F.explode(F.sequence(lo.cast("int"), hi.cast("int")))
    last = lambda lo, hi: lo + (F.ceil((hi - lo) / resolution) - 1) * resolution
    g = g.withColumns(
        {"lx": last(F.col("xs"), F.col("x1")), "ly": last(F.col("ys"), F.col("y1"))}
    ).where("lx >= xs AND ly >= ys")
    g = g.withColumn(
        "chunk_col",
        span(F.floor((F.col("xs") - F.col("tile_x")) / block), F.floor((F.col("lx") - F.col("tile_x")) / block))
    )
    g = g.withColumn(
        "chunk_row",
        span(F.ceil((F.col("tile_y") - F.col("ly")) / block) - 1, F.ceil((F.col("tile_y") - F.col("ys")) / block) - 1)
    )
    g = g.withColumns(
        {
            "x_left": F.col("tile_x") + F.col("chunk_col") * block,
            "y_lower": F.col("tile_y") - (F.col("chunk_row") + 1) * block
        }
    )
    return g.withColumns({
        "px0": F.greatest("x_left", "xs"), "py0": F.greatest("y_lower", "ys"),
        "px1": F.least(F.col("x_left") + block - resolution, F.col("lx")),
        "py1": F.least(F.col("y_lower") + block - resolution, F.col("ly")),
    }).where("px0 <= px1 AND py0 <= py1")


def with_degree_box(
    df: DataFrame, zone: Column, south: Column, x0: Column, y0: Column, x1: Column, y1: Column, names: Sequence[str]
) -> DataFrame:
    """``df`` with west, south, east and north, under the given names, of a projected box, from its four corners."""
    df = df.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1})
    corners = [(x, y) for x in ("_x0", "_x1") for y in ("_y0", "_y1")]
    for k, (x, y) in enumerate(corners):
        df = with_degrees(df, F.col(x), F.col(y), zone, south, f"_lon{k}", f"_lat{k}")
    lons, lats = [f"_lon{k}" for k in range(4)], [f"_lat{k}" for k in range(4)]
    edges = (F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats))
    held = _held(df, dict(zip(names, edges)))
    return held.drop("_x0", "_y0", "_x1", "_y1", *lons, *lats)


def utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """``utm`` as DuckDB expressions, written out on their own."""
    phi = f"radians({lat})"
    a = f"(cos({phi}) * radians({lon} - ({zone} * 6 - 183)))"
    n, t, c = f"(6378137.0 / sqrt(1 - {E2!r} * sin({phi}) ** 2))", f"(tan({phi}) ** 2)", f"({EP2!r} * cos({phi}) ** 2)"
    e = E2
    arc = f"(6378137.0 * ({1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256!r} * {phi} - {3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024!r} * sin(2 * {phi}) + {15 * e**2 / 256 + 45 * e**3 / 1024!r} * sin(4 * {phi}) - {35 * e**3 / 3072!r} * sin(6 * {phi})))"
    east = f"(0.9996 * {n} * ({a} + (1 - {t} + {c}) * {a} ** 3 / 6 + (5 - 18 * {t} + {t} ** 2 + 72 * {c} - 58 * {EP2!r}) * {a} ** 5 / 120) + 500000)"
    north = f"(0.9996 * ({arc} + {n} * tan({phi}) * ({a} ** 2 / 2 + (5 - {t} + 9 * {c} + 4 * {c} ** 2) * {a} ** 4 / 24 + (61 - 58 * {t} + {t} ** 2 + 600 * {c} - 330 * {EP2!r}) * {a} ** 6 / 720)) + CASE WHEN {lat} < 0 THEN 10000000 ELSE 0 END)"
    return east, north


def utm_inverse_sql(source: str, east: str, north: str, zone: str, lon: str = "lon", lat: str = "lat") -> str:
    """A DuckDB query: the rows of ``source`` with longitude and latitude of projected places in the south, step by step."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    scale = K0 * A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256)
    return (
        f"SELECT * EXCLUDE (_mu, _f, _t, _g, _n, _r, _d), degrees((_d - (1 + 2 * _t + _g) * _d ** 3 / 6 + (5 - 2 * "
        f"_g + 28 * _t - 3 * _g ** 2 + 8 * {EP2!r} + 24 * _t ** 2) * _d ** 5 / 120) / cos(_f)) + {zone} * 6 - 183 AS {lon}, "
        f"degrees(_f - _n * tan(_f) / _r * (_d ** 2 / 2 - (5 + 3 * _t + 10 * _g - 4 * _g ** 2 - 9 * {EP2!r}) * _d ** "
        f"4 / 24 + (61 + 90 * _t + 298 * _g + 45 * _t ** 2 - 252 * {EP2!r} - 3 * _g ** 2) * _d ** 6 / 720)) AS {lat} FROM ("
        f"SELECT *, ({east} - 500000) / (_n * {K0}) AS _d FROM (SELECT *, tan(_f) ** 2 AS _t, {EP2!r} * cos(_f) ** 2 "
        f"AS _g, {A} / sqrt(1 - {E2!r} * sin(_f) ** 2) AS _n, {A * (1 - E2)!r} / (1 - {E2!r} * sin(_f) ** 2) ** 1.5 "
        f"AS _r FROM ("
        f"SELECT *, _mu + {3 * e1 / 2 - 27 * e1**3 / 32!r} * sin(2 * _mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r} * "
        f"sin(4 * _mu) + {151 * e1**3 / 96!r} * sin(6 * _mu) + {1097 * e1**4 / 512!r} * sin(8 * _mu) AS _f FROM ("
        f"SELECT *, ({north} - 10000000) / {scale!r} AS _mu FROM {source}))))"
    )


def slippy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile."""
    n = float(2**zoom)
    phi = F.radians(lat)
    y = (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor(y).cast("int")


def slippy_bounds(x: Column, y: Column, zoom: int) -> dict[str, Column]:
    n = float(2**zoom)
    lat = lambda r: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * r / n))))
    return {"west": x / n * 360 - 180, "east": (x + 1) / n * 360 - 180, "north": lat(y), "south": lat(y + 1)}


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Along longitude and latitude."""
    return 111_320.0 * F.cos(F.radians(lat)), F.lit(111_320.0)


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (lon_min, lat_min, lon_max, lat_max) share a point."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])
