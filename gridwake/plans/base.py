"""The observation table as the queries see it, in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.functions import ids, indices
from gridwake.operators import observations as ob
from gridwake.sources import tables

#: Keys under which a row counts once, and the column that says which of its deliveries is the last.
KEYS = {
    "observations": ("obs_id", "loaded_at"),
    "sightings": ("sighting_id", "loaded_at"),
    "year_summaries": ("summary_id", None),
    "tam_samples": ("sample_id", None),
    "science_points": ("point_id", None),
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose repeated deliveries count once; tables without a key as they are."""
    df = tables.table(spark, d, name)
    return ob.latest_delivery(df, *KEYS[name]) if name in KEYS else df


def once(sql: str) -> str:
    """A DuckDB text whose keyed tables are read as ``table`` reads them."""

    def rows(match: re.Match) -> str:
        key, by = KEYS[match[2]]
        order = f"{by} DESC NULLS LAST" if by else key
        return f"{match[1]} (SELECT * FROM {match[2]} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"

    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(KEYS)})\b", rows, sql)


#: The box most queries look at.
BOX = (139.0, -20.0, 144.0, -16.0)
BANDS = indices.BANDS


def obs(spark: SparkSession, d: str, repeated: bool = False) -> DataFrame:
    """Observations with source filled in, NaN null, dates split, and indices and decibels beside them.

    Every obs_id counts once, as last delivered; ``repeated`` keeps all deliveries, for checks that look for them.
    """
    df = ob.prepare((tables.table if repeated else table)(spark, d, "observations"))
    df = df.withColumns({f"i_{n.lower()}": indices.spectral_index(n) for n in (*indices.INDICES, "NDSVI", "B12_B11")})
    vh, vv = F.col("vh"), F.col("vv")
    return df.withColumns(
        {
            "vh_db": indices.decibel(vh), "vv_db": indices.decibel(vv),
            "vh_vv": indices.decibel(vh) - indices.decibel(vv), "rvi": indices.radar_vegetation(vh, vv),
            "label": ids.presence_label(F.col("region_id"))
        }
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their place in the alphabet as ordinal."""
    return table(spark, d, "training_regions").withColumn("ordinal", F.col("id"))


_R = {b: f"({b} / 10000.0::DOUBLE)" for b in BANDS}
_INDEX_SQL = {
    "ndvi": f"({_R['B08']} - {_R['B04']}) / nullif({_R['B08']} + {_R['B04']}, 0)",
    "ndwi": f"({_R['B03']} - {_R['B08']}) / nullif({_R['B03']} + {_R['B08']}, 0)",
    "evi": f"2.5::DOUBLE * ({_R['B08']} - {_R['B04']}) / nullif({_R['B08']} + 6.0::DOUBLE * {_R['B04']} - 7.5::DOUBLE * {_R['B02']} + 1.0::DOUBLE, 0)",
    "mavi": f"({_R['B08']} - {_R['B04']}) / nullif({_R['B08']} + {_R['B04']} + {_R['B11']}, 0)",
    "ndre": f"({_R['B8A']} - {_R['B05']}) / nullif({_R['B8A']} + {_R['B05']}, 0)",
    "ci_re": f"{_R['B07']} / nullif({_R['B05']}, 0) - 1.0::DOUBLE",
    "ndsvi": f"({_R['B11']} - {_R['B04']}) / nullif({_R['B11']} + {_R['B04']}, 0)",
    "b12_b11": f"{_R['B12']} / nullif({_R['B11']}, 0)",
}
OBS = (
    "obs AS (SELECT *, CASE WHEN vh > 0 THEN 10 * log10(vh) END AS vh_db, CASE WHEN vv > 0 THEN 10 * log10(vv) END "
    "AS vv_db, "
    "CASE WHEN vh > 0 AND vv > 0 THEN 10 * log10(vh) - 10 * log10(vv) END AS vh_vv, CASE WHEN vh + vv > 0 THEN 4 * "
    "vh / (vh + vv) END AS rvi FROM ("
    "SELECT obs_id, region_id, point_id, lon::DOUBLE AS lon, lat::DOUBLE AS lat, date, item_id, tile_id, "
    + ", ".join(BANDS) + ", scl_purity, scl, aot, view_zenith, sun_zenith, coalesce(source, 'S2') AS source, "
    "CASE WHEN NOT isnan(vh) THEN vh::DOUBLE END AS vh, CASE WHEN NOT isnan(vv) THEN vv::DOUBLE END AS vv, orbit, "
    "CASE WHEN NOT isnan(NDVI) THEN NDVI::DOUBLE END AS NDVI, batch_no, loaded_at, "
    "year(date)::INT AS year, month(date)::INT AS month, dayofyear(date)::INT AS doy, "
    "CASE WHEN contains(region_id, 'presence') THEN 'presence' WHEN contains(region_id, 'absence') THEN 'absence' "
    "ELSE 'unknown' END AS label, "
    + ", ".join(f"{e} AS i_{n}" for n, e in _INDEX_SQL.items())
    + " FROM observations))"
)
GOOD = "source = 'S2' AND scl_purity >= 1"


def with_obs(*more: str) -> str:
    """The beginning of a DuckDB query: ``WITH obs AS (...), ...``."""
    return "WITH " + ", ".join((OBS, *more)) + "\n"
