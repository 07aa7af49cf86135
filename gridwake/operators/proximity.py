"""Points in regions and points near points, by trapezoidal decomposition.

The boundaries of the regions, boxes or polygons, cut the plane into slabs along x; within a slab, each region is one or more
trapezoids between two of its edges. A point finds its slab by binary search, and the slab's edges are found by binary
search among its points in the order of y. Regions and points are distributed over tiles, each of which builds the
slabs of its own regions; a crowded tile is salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridwake.operators.grouped import group_codes

EARTH_M = 6_371_008.8


def _place(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """2 i + 1 for the i-th bound itself, 2 i for what lies below it and above the one before."""
    i = np.searchsorted(bounds, values, "left")
    on = (i < len(bounds)) & (
        bounds[np.minimum(i, len(bounds) - 1)] == values
    ) if len(bounds) else np.zeros(len(values), bool)
    return 2 * i + on


class SlabIndex:
    """Closed trapezoids with upright sides, ready for the location of points.

    Each row is ``(x_lo, x_hi, bottom at x_lo, bottom at x_hi, top at x_lo, top at x_hi)``; a box has level edges. The sides
    cut the plane into slabs along x, and a slab's own trapezoids are gathered only when points fall into it, so
    memory is that of the trapezoids, however they overlap.
    """

    def __init__(self, traps: np.ndarray):
        self.traps = traps
        self.xs = np.unique(traps[:, :2])
        self.first, self.last = _place(self.xs, traps[:, 0]), _place(self.xs, traps[:, 1])
        self.low, self.high = traps[:, 2:4].min(axis=1), traps[:, 4:6].max(axis=1)
        self.level = bool(np.all(traps[:, 2] == traps[:, 3]) and np.all(traps[:, 4] == traps[:, 5]))

    def _inside(self, x: np.ndarray, y: np.ndarray, traps: np.ndarray) -> np.ndarray:
        """Whether each point lies between its trapezoid's sloping edges."""
        t = self.traps[traps]
        part = np.where(t[:, 1] > t[:, 0], (x - t[:, 0]) / np.where(t[:, 1] > t[:, 0], t[:, 1] - t[:, 0], 1.0), 0.0)
        return (y >= t[:, 2] + (t[:, 3] - t[:, 2]) * part) & (y <= t[:, 4] + (t[:, 5] - t[:, 4]) * part)

    def locate(self, x: np.ndarray, y: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (point number, trapezoid number), edges included; a block has about ``most`` pairs.

        The points of a slab stand in the order of y, and each edge of the slab is found among them by binary search: what lies
        between a trapezoid's two edges is one stretch.
        """
        slab = _place(self.xs, x)
        order = np.lexsort((y, slab))
        cuts = np.flatnonzero(np.diff(slab[order], prepend=-1, append=-2))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = slab[order[a]]
            active = np.flatnonzero((self.first <= here) & (here <= self.last))
            points = order[a:b]
            lo, hi = np.searchsorted(y[points], self.low[active], "left"), np.searchsorted(
                y[points], self.high[active], "right"
            )
            done = 0
            total = np.cumsum(hi - lo)
            while done < len(active):
                # As many trapezoids as make a block; one of very many points is cut itself.
                upto = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")), done + 1)
                n = (hi - lo)[done:upto]
                for start in range(0, max(int(n.sum()), 1), most):
                    flat = np.arange(start, min(start + most, int(n.sum())))
                    ends = np.cumsum(n)
                    which = np.searchsorted(ends, flat, "right")
                    found, traps = points[lo[done:upto][which] + flat - (ends - n)[which]], active[done:upto][which]
                    if not self.level:
                        good = self._inside(x[found], y[found], traps)
                        found, traps = found[good], traps[good]
                    held.append((found, traps))
                    size += len(found)
                    if size >= most:
                        yield tuple(np.concatenate(part) for part in zip(*held))
                        held, size = [], 0
                done = upto
        if held:
            yield tuple(np.concatenate(part) for part in zip(*held))


_BOX = ("x_lo", "y_lo", "x_hi", "y_hi")
_TRAP = ("x_lo", "x_hi", "b_lo", "b_hi", "t_lo", "t_hi")


def _sound(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n}) AND abs({n}) < 1e9" for n in names)


def locate_in_boxes(
    points: DataFrame, boxes: DataFrame, tile: float = 1.0, salt_rows: int = 200_000, slab_boxes: int = 5_000
) -> DataFrame:
    """Pairs ``(pid, bid)`` of points and closed boxes that hold them, each once.

    ``points``: pid, x, y; ``boxes``: bid, x_lo, y_lo, x_hi, y_hi. Null or NaN coordinates, and boxes whose lower
    bound exceeds the upper, match nothing. Repeated rows with the same ids must be removed by the caller. Points
    exactly on an edge belong to the box. Empty tables give an empty result.
    """
    b = boxes.where(_sound(*_BOX) + " AND x_lo <= x_hi AND y_lo <= y_hi")
    sides = {"x_lo": "x_lo", "x_hi": "x_hi", "b_lo": "y_lo", "b_hi": "y_lo", "t_lo": "y_hi", "t_hi": "y_hi"}
    return _locate(
        points, b.select("bid", *[F.col(c).cast("double").alias(n) for n, c in sides.items()]), tile, salt_rows,
        slab_boxes
    )


def trapezoids(polygons: DataFrame) -> DataFrame:
    """``(bid, x_lo, x_hi, b_lo, b_hi, t_lo, t_hi)``: polygons ``(bid, rings)`` cut at the x of every corner.

    ``rings`` is an array of rings, a ring an array of corners ``[x, y]``, closed or not; what an even number of rings surrounds is
    outside, so holes are rings like others. Rings of fewer than three corners, null ones and those with null or NaN corners
    are left out; edges of one polygon must not cross.
    """
    kind = dict(polygons.dtypes)["bid"]
    arrow = to_arrow_schema(T._parse_datatype_string(f"bid {kind}, " + ", ".join(f"{c} double" for c in _TRAP)))

    def cut_up(rings: list) -> np.ndarray:
        edges = []
        for ring in rings or []:
            if ring is None or any(p is None or len(p) < 2 or any(v is None or v != v for v in p[:2]) for p in ring):
                continue
            corners = np.array([p[:2] for p in ring], float)
            if len(corners) >= 3:
                edges.append(np.hstack([corners, np.roll(corners, -1, axis=0)]))
        if not edges:
            return np.zeros((0, 6))
        e = np.concatenate(edges)
        e = e[e[:, 0] != e[:, 2]]
        back = e[:, 0] > e[:, 2]
        e[back] = e[back][:, [2, 3, 0, 1]]
        xs = np.unique(e[:, [0, 2]])
        lo, hi = np.searchsorted(xs, e[:, 0]), np.searchsorted(xs, e[:, 2])
        n = hi - lo
        edge = np.repeat(np.arange(len(e)), n)
        slab = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = lambda x: e[edge, 1] + (e[edge, 3] - e[edge, 1]) * (x - e[edge, 0]) / (e[edge, 2] - e[edge, 0])
        left, right = xs[slab], xs[slab + 1]
        y_lo, y_hi = at(left), at(right)
        order = np.lexsort((y_lo + y_hi, slab))
        # Edges of a slab in their order: from the first to the second is inside, from the third to the fourth, and so on.
        low, high = order[::2], order[1::2]
        return np.column_stack([left[low], right[low], y_lo[low], y_hi[low], y_lo[high], y_hi[high]])

    def run(batches):
        for batch in batches:
            for i, rings in enumerate(batch.column("rings").to_pylist()):
                found = cut_up(rings)
                if len(found):
                    ids = batch.column("bid").take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.cast(arrow.field("bid").type),
                            *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(6))
                        ],
                        schema=arrow
                    )

    return polygons.select("bid", "rings").mapInArrow(run, f"bid {kind}, " + ", ".join(f"{c} double" for c in _TRAP))


def locate_in_polygons(
    points: DataFrame, polygons: DataFrame, tile: float = 1.0, salt_rows: int = 200_000, slab_boxes: int = 5_000
) -> DataFrame:
    """Pairs ``(pid, bid)`` of points and the polygons ``(bid, rings)`` that hold them, each once; edges belong to them."""
    return _locate(points, trapezoids(polygons), tile, salt_rows, slab_boxes).distinct()


def _locate(points: DataFrame, traps: DataFrame, tile: float, salt_rows: int, slab_boxes: int) -> DataFrame:
    """Pairs of points and trapezoids, by tiles.

    A trapezoid lies on tiles of at least its own size (a power of two times ``tile``), at most four of them, so a wide one costs no
    more than a small one; points look at each size that occurs, some forty at most. A tile with more than ``salt_rows``
    points is dealt to several tasks, each with a copy of the tile's trapezoids; of a tile with more than
    ``slab_boxes`` trapezoids, each task takes a share of them. One shuffle brings a share's trapezoids, and behind
    them its points, to a task, which holds the trapezoids and lets the points and the pairs stream by.
    """
    p = points.where(_sound("x", "y")).select("pid", F.col("x").cast("double"), F.col("y").cast("double"))
    bottom, top = F.least("b_lo", "b_hi"), F.greatest("t_lo", "t_hi")
    width = F.greatest(F.col("x_hi") - F.col("x_lo"), top - bottom)
    t = traps.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(width / tile))).cast("int") if tile else F.lit(0))
    t = t.withColumn("level", F.when(width > tile, F.col("level")).otherwise(0))
    side = F.lit(float(tile)) * F.pow(F.lit(2.0), F.col("level"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / side).cast("long"), F.floor(hi / side).cast("long")))
    t = t.select(
        "bid", *_TRAP, "level", cells(F.col("x_lo"), F.col("x_hi")).alias("tx"), bottom.alias("_b"), top.alias("_t")
    )
    t = t.withColumn("ty", cells(F.col("_b"), F.col("_t"))).drop("_b", "_t")
    n_t = t.groupBy("level", "tx", "ty").agg(F.ceil(F.count(F.lit(1)) / slab_boxes).cast("int").alias("nb"))
    levels = [r[0] for r in n_t.select("level").distinct().collect()]  # powers of two between a tile and 1e9: some forty
    p = p.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels] or [F.lit(None).cast("int")])))
    p = p.withColumn("tx", F.floor(F.col("x") / side).cast("long")).withColumn(
        "ty", F.floor(F.col("y") / side).cast("long")
    )
    n_p = p.groupBy("level", "tx", "ty").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("np"))
    shares = n_t.join(n_p, ["level", "tx", "ty"])
    place, keys = ["level", "tx", "ty"], ["level", "tx", "ty", "sp", "sb"]
    ps = p.join(shares, place).withColumn(
        "sp", F.pmod(F.xxhash64("pid", "x", "y"), F.col("np")).cast("int")
    ).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    ts = t.join(shares, place).withColumn(
        "sb", F.pmod(F.xxhash64("bid", *_TRAP), F.col("nb")).cast("int")
    ).withColumn("sp", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    both = ts.select(*keys, F.lit(0).alias("kind"), "bid", *_TRAP).unionByName(
        ps.select(*keys, F.lit(1).alias("kind"), "pid", F.col("x").alias("x_lo"), F.col("y").alias("b_lo")),
        allowMissingColumns=True
    )
    ptype, btype = dict(points.dtypes)["pid"], dict(traps.dtypes)["bid"]
    # The same types with every nested field nullable, which is what the schema text below stands for.
    wanted = to_arrow_schema(T._parse_datatype_string(f"pid {ptype}, bid {btype}"))

    def run(batches):
        at, held, index, names = None, [], None, None
        for batch in batches:
            marks = pa.Table.from_batches([batch])
            cuts = [*np.flatnonzero(np.diff(group_codes(marks, [*keys, "kind"]), prepend=-1)), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                here = tuple(part.column(k)[0].as_py() for k in keys)
                if here != at:
                    at, held, index = here, [], None
                if part.column("kind")[0].as_py() == 0:
                    held.append(part)
                    continue
                if index is None and held:
                    rows = pa.Table.from_batches(held)
                    names, held = rows.column("bid").combine_chunks(), []
                    index = SlabIndex(np.column_stack([rows.column(c).to_numpy() for c in _TRAP]))
                if index is None:
                    continue
                for found, traps_ in index.locate(part.column("x_lo").to_numpy(), part.column("b_lo").to_numpy()):
                    if len(found):
                        pair = pa.table(
                            {"pid": part.column("pid").take(pa.array(found)), "bid": names.take(pa.array(traps_))}
                        )
                        yield from pair.cast(wanted).to_batches()

    # Hash of the place and sort by it: a share's trapezoids come first, then its points.
    return both.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "kind").mapInArrow(
        run, f"pid {ptype}, bid {btype}"
    )


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near_points(points: DataFrame, others: DataFrame, metres: float, tile: float = 0.25) -> DataFrame:
    """Pairs ``(pid, bid)`` of points at most ``metres`` apart along the great circle.

    ``points``: pid, lon, lat; ``others``: bid, lon, lat. Each of the others becomes a box that surely holds the
    circle around it; the points are located in these boxes, and the distance is then checked exactly. Boxes
    across the date line are stated on both sides and those around a pole span all longitudes. Null or
    NaN coordinates and latitudes outside [-90, 90] match nothing; longitudes are taken modulo 360.
    """
    lon = F.pmod(F.col("lon").cast("double") + 180, F.lit(360.0)) - 180
    ok = "lat BETWEEN -90 AND 90 AND lon IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)"
    p = points.where(ok).select("pid", lon.alias("x"), F.col("lat").cast("double").alias("y"))
    reach = math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-9
    o = others.where(ok).select("bid", lon.alias("x"), F.col("lat").cast("double").alias("y"))
    widest = F.abs("y") + reach
    dx = F.when(widest >= 89.9, F.lit(360.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(reach))) / F.cos(F.radians("y"))))) * (1 + 1e-9)
        + 1e-9
    )
    spans = F.when(widest >= 89.9, F.array(F.struct(F.lit(-180.0).alias("lo"), F.lit(180.0).alias("hi")))).otherwise(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.greatest(F.lit(-180.0), F.col("x") - F.col("dx") + turn).alias("lo"),
                        F.least(F.lit(180.0), F.col("x") + F.col("dx") + turn).alias("hi")
                    )
                    for turn in (-360.0, 0.0, 360.0)
                ]
            ),
            lambda s: s.lo <= s.hi
        )
    )
    boxes = o.withColumn("dx", dx).withColumn("s", F.explode(spans))
    boxes = boxes.select(
        F.struct("bid", "x", "y").alias("bid"), F.col("s.lo").alias("x_lo"), (F.col("y") - reach).alias("y_lo"),
        F.col("s.hi").alias("x_hi"), (F.col("y") + reach).alias("y_hi")
    )
    held = locate_in_boxes(p.select(F.struct("pid", "x", "y").alias("pid"), "x", "y"), boxes, tile)
    far = great_circle(F.col("pid.x"), F.col("pid.y"), F.col("bid.x"), F.col("bid.y"))
    return held.where(far <= metres).select("pid.pid", "bid.bid")
