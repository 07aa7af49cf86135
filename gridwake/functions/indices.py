"""Column builders: spectral and radar indices, quality terms, angles and encodings.

Every builder returns an expression; a zero denominator, a null or a NaN gives null.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"]
INDICES = ["NDVI", "NDWI", "EVI", "MAVI", "NDRE", "CI_RE"]
SCALE = 10_000.0
CLEAR_SCENE_CLASSES = (4, 5, 6, 11)


def clean(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def reflectance(band: str, integral: bool = True) -> Column:
    """Stored whole numbers are scaled; stored fractions are taken as they are."""
    value = F.col(band).cast("double")
    return value / SCALE if integral else clean(value)


def to_storage(value: Column) -> Column:
    """Reflectance to the stored whole number: ties to even, limits 0 and 65535, NaN to null."""
    scaled = F.rint(clean(value) * SCALE)
    return F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(65535.0))).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def contrast(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def spectral_index(name: str, integral: bool = True) -> Column:
    """An index from reflectance, by name."""
    b = {x: reflectance(x, integral) for x in BANDS}
    builders = {
        "NDVI": lambda: contrast(b["B08"], b["B04"]),
        "NDWI": lambda: contrast(b["B03"], b["B08"]),
        "EVI": lambda: ratio(2.5 * (b["B08"] - b["B04"]), b["B08"] + 6.0 * b["B04"] - 7.5 * b["B02"] + 1.0),
        "MAVI": lambda: ratio(b["B08"] - b["B04"], b["B08"] + b["B04"] + b["B11"]),
        "NDRE": lambda: contrast(b["B8A"], b["B05"]),
        "CI_RE": lambda: ratio(b["B07"], b["B05"]) - 1.0,
        "NDSVI": lambda: contrast(b["B11"], b["B04"]),
        "B12_B11": lambda: ratio(b["B12"], b["B11"]),
    }
    return builders[name]()


def flowering_index(bands: Column, eps: float = 1e-9) -> Column:
    """From a map of bands; a missing band counts 0."""
    get = lambda k: F.coalesce(F.try_element_at(bands, F.lit(k)), F.lit(0.0))
    red_edge = (get("B07") - get("B05")) / (get("B07") + get("B05") + eps)
    moisture = (get("B08") - get("B11")) / (get("B08") + get("B11") + eps)
    return clamp((red_edge + moisture) / 2, -1.0, 1.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10.0 * F.log10(x))


def radar_vegetation(vh: Column, vv: Column) -> Column:
    return F.when(vh + vv > 0, 4.0 * vh / (vh + vv))


def quality(terms: dict[str, Column], mask: set[str] | None = None) -> Column:
    """Product of the chosen terms, each limited to 0 .. 1."""
    chosen = [clamp(v, 0.0, 1.0) for k, v in terms.items() if mask is None or k in mask]
    return functools.reduce(operator.mul, chosen, F.lit(1.0))


def aerosol_quality(aot: Column) -> Column:
    return 1.0 - F.least(aot * 0.001, F.lit(1.0))


def zenith_quality(degrees: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - degrees / 90.0)


def greenness(ndvi: Column, mean: Column, std: Column) -> Column:
    """1 at the archive's mean, falling with the distance in standard deviations."""
    return 1.0 / (1.0 + F.abs((clamp(ndvi, -1.0, 1.0) - mean) / std))


def doy_encoding(doy: Column, k: int = 1) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year; day 0 (padding) gives 0 and 0."""
    angle = F.lit(2 * math.pi * k / 365.0) * doy
    return F.when(doy == 0, 0.0).otherwise(F.sin(angle)), F.when(doy == 0, 0.0).otherwise(F.cos(angle))


def shift_doy(doy: Column, days: int | Column) -> Column:
    return F.least(F.greatest(F.pmod(doy - 1 + days, F.lit(365)) + 1, F.lit(1)), F.lit(365))


def decay(years: Column, rate: float) -> Column:
    return F.exp(-rate * years)


def min_max(x: Column, low: float, high: float) -> Column:
    return clamp((x - low) / (high - low), 0.0, 1.0)


def percent(score: Column) -> Column:
    """A score as a whole percentage, ties to even."""
    return F.bround(clamp(score, 0.0, 1.0) * 100, 0).cast("int")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


# BRDF model parameters per band (isotropic, geometric, volumetric), public literature.
BRDF = {
    "B02": (0.0774, 0.0079, 0.0372), "B03": (0.1306, 0.0178, 0.0580), "B04": (0.1690, 0.0227, 0.0574),
    "B05": (0.2085, 0.0256, 0.0845),
    "B06": (0.2316, 0.0273, 0.1003), "B07": (0.2599, 0.0294, 0.1197), "B08": (0.3093, 0.0330, 0.1535),
    "B8A": (0.3430, 0.0453, 0.1154),
    "B11": (0.3430, 0.0453, 0.1154), "B12": (0.2658, 0.0387, 0.0639),
}


def _limit(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ross_thick(sun: Column, view: Column, azimuth: Column) -> Column:
    """Volumetric kernel; angles in radians."""
    cosine = _limit(F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(azimuth), -1.0, 1.0)
    phase = F.acos(cosine)
    return ((math.pi / 2 - phase) * cosine + F.sin(phase)) / (F.cos(sun) + F.cos(view)) - math.pi / 4


def li_sparse(sun: Column, view: Column, azimuth: Column) -> Column:
    """Reciprocal geometric kernel; angles in radians."""
    secants = 1 / F.cos(sun) + 1 / F.cos(view)
    distance = F.pow(F.tan(sun), 2) + F.pow(F.tan(view), 2) - 2 * F.tan(sun) * F.tan(view) * F.cos(azimuth)
    crossing = F.pow(F.tan(sun) * F.tan(view) * F.sin(azimuth), 2)
    cosine = _limit(2 * F.sqrt(F.greatest(distance + crossing, F.lit(0.0))) / secants, -1.0, 1.0)
    angle = F.acos(cosine)
    overlap = F.greatest((angle - F.sin(angle) * cosine) * secants / math.pi, F.lit(0.0))
    scatter = _limit(F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(azimuth), -1.0, 1.0)
    return overlap - secants + 0.5 * (1 + scatter) * (secants - overlap)


def brdf_factor(band: str, sun: Column, view: Column, azimuth: Column) -> Column:
    """Reflectance under the standard geometry (sun 45 degrees, nadir) over that under the given one, 0.5 .. 2.

    Angles in degrees. A modelled reflectance under 1e-6 is replaced by 1; an unknown angle gives null.
    """
    iso, geo, vol = BRDF[band]
    sun, view, azimuth = F.radians(sun), F.radians(view), F.radians(azimuth)
    model = lambda s, v, a: iso + vol * ross_thick(s, v, a) + geo * li_sparse(s, v, a)
    target = model(F.lit(math.radians(45.0)), F.lit(0.0), F.lit(0.0))
    seen = model(sun, view, azimuth)
    return clamp(target / F.when(seen < 1e-6, 1.0).otherwise(seen), 0.5, 2.0)


def _standard_kernels() -> tuple[float, float]:
    """Both kernels under the standard geometry, sun at 45 degrees and nadir view."""
    sun = math.radians(45.0)
    cosine, secants = math.cos(sun), 1 / math.cos(sun) + 1
    ross = ((math.pi / 2 - sun) * cosine + math.sin(sun)) / (cosine + 1) - math.pi / 4
    at = min(2 * math.tan(sun) / secants, 1.0)
    overlap = max((math.acos(at) - math.sin(math.acos(at)) * at) * secants / math.pi, 0.0)
    return ross, overlap - secants + 0.5 * (1 + cosine) * (secants - overlap)


def with_brdf_kernels(df: DataFrame, sun: Column, view: Column, azimuth: Column) -> DataFrame:
    """``df`` with the kernels ``_ross`` and ``_li`` of angles in degrees, which all bands share, in steps."""
    df = df.withColumns({"_sun": F.radians(sun), "_view": F.radians(view), "_azimuth": F.radians(azimuth)})
    s, v, a = F.col("_sun"), F.col("_view"), F.col("_azimuth")
    cosine = F.cos(s) * F.cos(v) + F.sin(s) * F.sin(v) * F.cos(a)
    df = df.withColumns({"_cos": clamp(cosine, -1.0, 1.0), "_sec": 1 / F.cos(s) + 1 / F.cos(v)})
    spread = F.pow(F.tan(s), 2) + F.pow(F.tan(v), 2) - 2 * F.tan(s) * F.tan(v) * F.cos(a)
    crossing = F.pow(F.tan(s) * F.tan(v) * F.sin(a), 2)
    at = clamp(2 * F.sqrt(F.greatest(spread + crossing, F.lit(0.0))) / F.col("_sec"), -1.0, 1.0)
    df = df.withColumns({"_phase": F.acos("_cos"), "_at": F.acos(at)})
    overlap = F.greatest(
        (F.col("_at") - F.sin("_at") * F.cos("_at")) * F.col("_sec") / math.pi, F.lit(0.0)
    )
    df = df.withColumn("_over", F.when(F.col("_at").isNotNull(), overlap))
    ross = ((math.pi / 2 - F.col("_phase")) * F.col("_cos") + F.sin("_phase")) / (F.cos(s) + F.cos(v)) - math.pi / 4
    li = F.col("_over") - F.col("_sec") + 0.5 * (1 + F.col("_cos")) * (F.col("_sec") - F.col("_over"))
    return df.withColumns({"_ross": ross, "_li": li}).drop(
        "_sun", "_view", "_azimuth", "_cos", "_sec", "_phase", "_at", "_over"
    )


def brdf_from_kernels(band: str) -> Column:
    """As ``brdf_factor``, from the columns of ``with_brdf_kernels``."""
    iso, geo, vol = BRDF[band]
    ross, li = _standard_kernels()
    seen = iso + vol * F.col("_ross") + geo * F.col("_li")
    return clamp((iso + vol * ross + geo * li) / F.when(seen < 1e-6, 1.0).otherwise(seen), 0.5, 2.0)


def brdf_sql(band: str) -> str:
    """``brdf_factor`` as a DuckDB expression over columns s, v and a, the angles in radians; written out on its own."""
    iso, geo, vol = BRDF[band]

    def kernels(s: str, v: str, a: str) -> str:
        cos_xi = f"least(greatest(cos({s}) * cos({v}) + sin({s}) * sin({v}) * cos({a}), -1), 1)"
        ross = f"((pi() / 2 - acos({cos_xi})) * {cos_xi} + sin(acos({cos_xi}))) / (cos({s}) + cos({v})) - pi() / 4"
        sec = f"(1 / cos({s}) + 1 / cos({v}))"
        cos_t = f"least(greatest(2 * sqrt(greatest(tan({s}) ** 2 + tan({v}) ** 2 - 2 * tan({s}) * tan({v}) * cos({a}) + (tan({s}) * tan({v}) * sin({a})) ** 2, 0)) / {sec}, -1), 1)"
        over = f"greatest((acos({cos_t}) - sin(acos({cos_t})) * {cos_t}) * {sec} / pi(), 0)"
        return f"({iso} + {vol} * ({ross}) + {geo} * ({over} - {sec} + 0.5 * (1 + {cos_xi}) * ({sec} - {over})))"

    seen = kernels("s", "v", "a")
    target = kernels("radians(45.0::DOUBLE)", "0.0::DOUBLE", "0.0::DOUBLE")
    return f"CASE WHEN s IS NOT NULL AND v IS NOT NULL AND a IS NOT NULL THEN least(greatest({target} / CASE WHEN {seen} < 1e-6 THEN 1 ELSE {seen} END, 0.5), 2) END"


# The stops of the red-yellow-green score colours, from low to high.
COLOURS = [
    (165, 0, 38), (189, 24, 29), (213, 48, 39), (230, 82, 52), (245, 115, 68), (252, 152, 86), (253, 185, 110),
    (254, 212, 139), (255, 235, 171), (255, 251, 204),
    (235, 248, 188), (209, 238, 161), (169, 220, 136), (120, 198, 112), (75, 176, 90), (35, 152, 72), (0, 125, 62),
    (0, 104, 55), (0, 81, 46), (0, 68, 27),
]


def colour(score: Column) -> Column:
    """``struct<r, g, b, a>`` of a score 0 .. 100, linear between the stops; 0 and null are transparent."""
    place = score / 100.0 * (len(COLOURS) - 1)
    low = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(len(COLOURS) - 2)).cast("int")
    part = place - low
    stops = lambda k: F.array(*[F.lit(c[k]) for c in COLOURS])
    mixed = [F.rint(F.get(stops(k), low) * (1 - part) + F.get(stops(k), low + 1) * part).cast("int") for k in range(3)]
    return F.struct(
        *[F.when(score > 0, m).otherwise(0).alias(n) for n, m in zip("rgb", mixed)],
        F.when(score > 0, 255).otherwise(0).alias("a")
    )
