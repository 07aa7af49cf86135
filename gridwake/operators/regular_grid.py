"""Irregular readings of cumulative counters onto a regular grid of cells, with uncovered cells marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regularise(
    df: DataFrame, source: Sequence[str], at: str, reading: str, step: float, origin: float = 0.0,
    max_span: float | None = None, rec_id: str | None = None, delta: bool = False
) -> DataFrame:
    """A regular series per source from cumulative counter readings.

    ``at`` is a numeric position (for example a day of the year), ``reading`` the counter. Consecutive readings
    are differenced; where a reading is lower than the one before, the counter was reset and the reading
    itself is the increment. With ``delta`` the readings already are increments. Each increment is spread evenly
    over the span since the reading before, at most ``max_span`` long (what lies further back is uncovered), and
    goes to the cells ``(origin + k step, origin + (k+1) step]`` in proportion to the overlap. The first reading
    of a source only starts the count, unless ``max_span`` is given: then it is an increment over that span.

    Returns ``(source, cell, increment, covered, missing)`` for all cells from the source's first to its last
    covered one: ``covered`` is the covered length, ``missing`` marks cells with none. Null or NaN readings
    and positions are left out; repeated rows (same position and reading, or same ``rec_id``) count once; of
    ties in position the lower reading comes first, and a tie covers nothing. A null source is a source of its
    own; a source with nothing covered has no rows. Empty input gives empty output.

    Readings are ordered within (source, cell) only, and a summary per cell carries the last reading on to the
    next cell, so a source with a third of all rows is spread over its cells.
    """
    keys = [f"s{i}" for i in range(len(source))]
    t, v = F.col(at).cast("double"), F.col(reading).cast("double")
    slim = df.select(
        *[F.col(s).alias(k) for s, k in zip(source, keys)], t.alias("t"), v.alias("v"),
        *([F.col(rec_id).alias("rid")] if rec_id else [])
    )
    slim = slim.where("t IS NOT NULL AND v IS NOT NULL AND NOT isnan(t) AND NOT isnan(v)")
    cell = lambda x: (F.ceil((x - origin) / step) - 1).cast("long")
    slim = slim.withColumn("cell", cell(F.col("t")))
    within = Window.partitionBy(*keys, "cell").orderBy("t", "v", *(["rid"] if rec_id else []))
    back = lambda c: F.lag(c).over(within)
    same = (back("rid") == F.col("rid")) if rec_id else (back("t") == F.col("t")) & (back("v") == F.col("v"))
    stepped = slim.withColumn(
        "again", F.coalesce(same, F.lit(False))
    ).withColumn("pt", back("t")).withColumn("pv", back("v")).where("NOT again")

    def gain(v, pv):
        return v if delta else F.when(pv.isNull() | (v < pv), v).otherwise(v - pv)

    def start(t, pt):
        return pt if max_span is None else F.greatest(t - max_span, F.coalesce(pt, t - max_span))

    inside = F.col("pt").isNotNull()
    t, v, pt, pv = (F.col(c) for c in ("t", "v", "pt", "pv"))
    summary = stepped.groupBy(*keys, "cell").agg(
        F.min(F.struct("t", "v")).alias("first"),
        F.max(F.struct("t", "v")).alias("last"),
        F.sum(F.when(inside, gain(v, pv))).alias("gained"),
        F.sum(F.when(inside, t - start(t, pt))).alias("length"),
    )
    # One row per cell that has a reading: the grid bounds it, however many readings there are.
    order = Window.partitionBy(*keys).orderBy("cell")
    linked = summary.withColumn("p", F.lag("last").over(order))
    t, v, pt, pv = (F.col(c) for c in ("first.t", "first.v", "p.t", "p.v"))
    linked = linked.select(
        *keys, "cell", "gained", "length", t.alias("hi"), start(t, pt).alias("lo"), gain(v, pv).alias("gain")
    )
    low = F.floor((F.col("lo") - origin) / step).cast("long")
    zero = F.lit(None).cast("double")
    own = F.struct("cell", F.col("gained").alias("gain"), F.col("length").alias("covered"))

    def part(c):
        overlap = F.greatest(
            F.lit(0.0),
            F.least(
                F.col("hi"), (c + 1) * F.lit(float(step)) + origin
            ) - F.greatest(F.col("lo"), c * F.lit(float(step)) + origin)
        )
        return F.struct(
            c.alias("cell"), (F.col("gain") * overlap / (F.col("hi") - F.col("lo"))).alias("gain"),
            overlap.alias("covered")
        )

    crossing = F.when(
        F.col("lo") < F.col("hi"), F.transform(F.sequence(low, F.greatest(low, cell(F.col("hi")))), part)
    ).otherwise(F.array(F.struct("cell", zero.alias("gain"), zero.alias("covered"))))
    crossing = F.coalesce(crossing, F.array(F.struct("cell", zero.alias("gain"), zero.alias("covered"))))
    cells = linked.select(
        *keys, F.explode(F.concat(F.array(own), crossing)).alias("c")
    ).select(*keys, "c.*").where("covered IS NOT NULL")
    filled = cells.groupBy(*keys, "cell").agg(F.sum("gain").alias("increment"), F.sum("covered").alias("covered"))
    gaps = filled.withColumn("next", F.coalesce(F.lead("cell").over(order), F.col("cell") + 1))
    marks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("next") - F.col("cell") - 1),
        lambda i: F.struct(
            (F.col("cell") + i).alias("cell"), F.when(i == 0, F.col("increment")).alias("increment"),
            F.when(i == 0, F.col("covered")).otherwise(0.0).alias("covered"), (i > 0).alias("missing")
        )
    )
    return gaps.select(*keys, F.explode(marks).alias("m")).select(
        *[F.col(k).alias(s) for k, s in zip(keys, source)], "m.*"
    )
