"""Which of the overlapping tiles over a region are needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_AREA, _TILE = ("bw", "bs", "be", "bn"), ("w", "s", "e", "n")


def keep_needed(area: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    """Whether each of ``tiles`` (boxes, in their order) is needed for the box ``area``.

    One after another, a tile goes whose part of the area its overlaps with the tiles still kept cover; since each removal may make
    another tile necessary or not, this is repeated until nothing changes. Parts without extent are needed by none.
    """
    lo, hi = np.maximum(tiles[:, :2], area[:2]), np.minimum(tiles[:, 2:], area[2:])
    kept = np.ones(len(tiles), bool)
    if len(tiles) <= 1:
        return kept
    # The edges of all parts cut the area into cells, each wholly inside or outside of every tile.
    xs, ys = (np.unique(np.concatenate([lo[:, k], hi[:, k]])) for k in (0, 1))
    mx, my = (xs[1:] + xs[:-1]) / 2, (ys[1:] + ys[:-1]) / 2
    inside = (lo[:, 0, None] < mx) & (mx < hi[:, 0, None]), (lo[:, 1, None] < my) & (my < hi[:, 1, None])
    cover = inside[0][:, :, None] & inside[1][:, None, :]
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(kept):
            others = kept.copy()
            others[i] = False
            if not (cover[i] & ~cover[others].any(axis=0)).any():
                kept[i] = False
                changed = True
    return kept


def needed_tiles(met: DataFrame) -> DataFrame:
    """``(id, tile_id)`` from ``met (id, tile_id, bw, bs, be, bn, w, s, e, n)``: the tiles to read for each area.

    An area meets a few tiles only, so one task decides over an area at a time.
    """

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile_id")
        boxes = np.column_stack([table.column(c).to_numpy() for c in _TILE])
        area = np.array([table.column(c)[0].as_py() for c in _AREA], float)
        return table.select(["id", "tile_id"]).filter(pa.array(keep_needed(area, boxes)))

    return met.groupBy("id").applyInArrow(decide, "id string, tile_id string")
