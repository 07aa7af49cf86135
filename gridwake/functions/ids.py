"""Column builders that read the parts of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def northing(point: Column) -> Column:
    """The last part as a number; 0 where it isn't one."""
    return F.coalesce(F.element_at(F.split(point, "_"), -1).try_cast("int"), F.lit(0))


def easting(point: Column) -> Column:
    return F.element_at(F.split(point, "_"), -2).try_cast("int")


def region(point: Column) -> Column:
    return F.regexp_replace(point, r"_\d+_\d+$", "")


def site(region_id: Column, strip_val: bool = True) -> Column:
    head = F.regexp_extract(region_id, "^(.+?)_(presence|absence)", 1)
    head = F.regexp_replace(head, "_val$", "") if strip_val else head
    return F.coalesce(F.nullif(head, F.lit("")), region_id)


def site_class(region_id: Column) -> Column:
    return F.coalesce(_found(region_id, "^(.+?)_(presence|absence)", 2), F.lit("unknown"))


def tile_of_item(item: Column) -> Column:
    return F.split_part(item, F.lit("_"), F.lit(2))


def tile_or_item(tile: Column, item: Column) -> Column:
    """The stated tile, or where it is blank the one in the scene's name."""
    return F.coalesce(F.nullif(tile, F.lit("")), _found(item, r"^S2[ABC]_(\d{2}[A-Z]{3})_"))


def overpass(item: Column) -> Column:
    return F.regexp_replace(item, r"_\d+_L2A$", "")


def point_name(prefix: str, x: Column, y: Column) -> Column:
    return F.format_string(f"{prefix}_%04d_%04d", x, y)


COVER_WORDS = ("mangrove", "bare", "riparian", "water")


def cover_type(region_id: Column) -> Column:
    expr = F.lit("presence")
    for word in reversed(COVER_WORDS):
        expr = F.when(region_id.contains(f"_{word}"), word).otherwise(expr)
    return expr


def presence_label(region_id: Column) -> Column:
    return F.when(
        region_id.contains("presence"), "presence"
    ).when(region_id.contains("absence"), "absence").otherwise("unknown")
