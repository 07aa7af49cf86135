"""Implausible readings: impossible values, stuck values and spikes, judged per source.

Bounds find impossible readings and zero-difference runs find stuck ones. Spikes are found by phase-space
thresholding: readings are points (value, first difference, second difference), and those outside an
ellipsoid with robust axes (median absolute deviations times the universal threshold sqrt(2 ln n)) are
flagged, bridged over and the ellipsoid is fitted again, until nothing new is flagged. By default that is the verdict.
With ``confirm`` an exact check follows: a spike then also lies more than ``confirm`` usual deviations from the
source's median. The value axis of the first ellipsoid is never longer than ``confirm`` deviations, so the check loses none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from gridwake.operators.grouped import column, group_median, over_groups
from gridwake.operators.order_stats import numbered, percentiles, value_counts
from gridwake.session import Scratch

USUAL = 1.4826
OUT = StructType(
    [
        StructField("rec_id", LongType()), StructField("field", StringType()), StructField("fault", StringType()),
        StructField("deviations", DoubleType())
    ]
)


@dataclass(frozen=True)
class Channel:
    """One measured column: its name in the output, the judged value, and what is possible."""

    field: str
    value: str
    low: float
    high: float = float("inf")
    low_open: bool = False
    decibel: bool = False

    def impossible(self, v: np.ndarray) -> np.ndarray:
        return ((v <= self.low) if self.low_open else (v < self.low)) | (v > self.high)


def _shift(values: np.ndarray, codes: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places on within the group; the own value beyond the group's ends."""
    at = np.clip(np.arange(len(values)) + by, 0, max(len(values) - 1, 0))
    return np.where(codes[at] == codes, values[at], values)


def _stuck(values: np.ndarray, codes: np.ndarray, run: int) -> np.ndarray:
    if not len(values):
        return np.zeros(0, bool)
    change = np.ones(len(values), bool)
    change[1:] = (values[1:] != values[:-1]) | (codes[1:] != codes[:-1])
    runs = np.cumsum(change) - 1
    return np.bincount(runs)[runs] >= run


def _ratio(value: np.ndarray, axis: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(value == 0, 0.0, np.square(value / axis))


def _differences(u: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    du = (_shift(u, codes, 1) - _shift(u, codes, -1)) / 2
    return du, (_shift(du, codes, 1) - _shift(du, codes, -1)) / 2


def _threshold(n: np.ndarray, most: float | None) -> np.ndarray:
    limit = np.sqrt(2 * np.log(np.maximum(n, 2)))
    return limit if most is None else np.minimum(limit, most)


def _phase_space(u: np.ndarray, codes: np.ndarray, groups: int, most: float | None, rounds: int) -> np.ndarray:
    """Points of the centred series ``u`` outside the ellipsoid in any round."""
    flagged = np.zeros(len(u), bool)
    for _ in range(rounds):
        good = np.where(flagged, -1, np.arange(len(u)))
        back = np.maximum.accumulate(good)
        usable = (back >= 0) & (codes[np.maximum(back, 0)] == codes)
        bridged = np.where(flagged, np.where(usable, u[np.maximum(back, 0)], 0.0), u)
        du, d2 = _differences(bridged, codes)
        kept = ~flagged
        limit = _threshold(np.bincount(codes[kept], minlength=groups), most) * USUAL
        distance = np.zeros(len(u))
        for axis in (bridged, du, d2):
            size = limit * group_median(codes[kept], np.abs(axis[kept]), groups)
            distance += _ratio(axis, size[codes])
        new = (distance > 1) & kept
        if not new.any():
            break
        flagged |= new
    return flagged


def _judge(
    channel: Channel, ids: np.ndarray, values: np.ndarray, codes: np.ndarray, run: int, confirm: float | None,
    rounds: int
):
    """(ids, faults, deviations) of the implausible readings of one channel; groups are runs of ``codes``."""
    there = ~np.isnan(values)
    ids, values, codes = ids[there], values[there], codes[there]
    if not len(values):
        return ids, np.zeros(0, "U10"), values
    codes = np.cumsum(np.concatenate([[0], codes[1:] != codes[:-1]]))
    groups = int(codes[-1]) + 1
    wrong, stuck = channel.impossible(values), _stuck(values, codes, run)
    faults = np.where(wrong, "impossible", np.where(stuck, "stuck", ""))
    clean = faults == ""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = 10 * np.log10(values) if channel.decibel else values
    middle = group_median(codes[clean], x[clean], groups)
    u = x[clean] - middle[codes[clean]]
    usual = USUAL * group_median(codes[clean], np.abs(u), groups)[codes[clean]]
    outside = _phase_space(u, codes[clean], groups, confirm, rounds)
    deviations = np.full(len(values), np.nan)
    deviations[clean] = np.sqrt(_ratio(u, usual))
    spike = np.zeros(len(values), bool)
    spike[clean] = outside if confirm is None else outside & (np.abs(u) > confirm * usual)
    faults = np.where(spike, "spike", faults)
    hit = faults != ""
    return ids[hit], faults[hit], deviations[hit]


def _once(table: pa.Table, codes: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Repeated deliveries of a reading follow each other in (time, id) order; the first stays."""
    ids = column(table, "rec_id")
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1])
    return (table, codes) if keep.all() else (table.filter(pa.array(keep)), codes[keep])


def flag_implausible(
    df: DataFrame, source: Sequence[str], time: str, rec_id: str, channels: Sequence[Channel], run: int = 5,
    confirm: float | None = None, rounds: int = 10, hot: int = 500_000
) -> DataFrame:
    """Implausible readings of ``df`` as ``(rec_id, field, fault, deviations)``.

    ``df`` has one row per reading time of a source, with a whole-number ``rec_id`` and one value column per
    channel. Null and NaN values aren't judged. Rows with a null rec_id or time are left out. A null source is a source of
    its own. Repeated rows with the same rec_id count once; ties in time stand in the order of rec_id. A
    source whose clean readings all agree has usual deviation 0, and any other value is a spike. Other
    columns are ignored, whatever their names. Empty input gives empty output.

    One shuffle by source brings a source's readings together, and a vectorised kernel judges many
    sources at once. Sources of more than ``hot`` rows never meet in one task: they are cut into blocks
    of time, their medians come from a distributed sort, and the same rounds are run over the blocks.
    """
    source = list(source)
    names = [f"s{i}" for i in range(len(source))]
    values = [F.col(c.value).cast("double").alias(f"v{i}") for i, c in enumerate(channels)]
    slim = df.select(
        *[F.col(s).alias(n) for s, n in zip(source, names)], F.col(time).alias("at"),
        F.col(rec_id).cast("long").alias("rec_id"), *values
    )
    slim = slim.where("rec_id IS NOT NULL AND at IS NOT NULL")
    crowded = slim.groupBy(*names).count().where(F.col("count") > hot).select(*names)

    def kernel(table: pa.Table, codes: np.ndarray) -> pa.Table:
        table, codes = _once(table, codes)
        ids = column(table, "rec_id")
        parts = []
        for i, channel in enumerate(channels):
            values = np.array(table.column(f"v{i}").to_numpy(), dtype=float)
            found, faults, deviations = _judge(channel, ids, values, codes, run, confirm, rounds)
            parts.append(
                pa.table(
                    {
                        "rec_id": found, "field": pa.array([channel.field] * len(found), pa.string()),
                        "fault": pa.array(faults.tolist(), pa.string()),
                        "deviations": pa.array(deviations, from_pandas=True)
                    }
                )
            )
        return pa.concat_tables(parts)

    if crowded.isEmpty():
        return over_groups(slim, names, ["at", "rec_id"], kernel, OUT)
    # A written table has a known size: Catalyst broadcasts it only while it is small, and splits the hot sources otherwise.
    crowded = Scratch(df.sparkSession, "spikes").cut(crowded)
    small, large = _match(slim, crowded, names, "left_anti"), _match(slim, crowded, names, "left_semi")
    result = over_groups(small, names, ["at", "rec_id"], kernel, OUT)
    for i, channel in enumerate(channels):
        result = result.unionByName(
            _hot(
                large.select(*names, "at", "rec_id", F.col(f"v{i}").alias("v")), names, channel, run, confirm, rounds,
                hot
            )
        )
    return result


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal each other; the right side's keys are dropped."""
    match = F.lit(True)
    for k in keys:
        match &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.alias("l").join(right.alias("r"), match, how)
    return joined if how in ("left_semi", "left_anti") else joined.select(
        "l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys]
    )


def _blocks(block: int, rim: int):
    """The blocks whose kernels need the row at ``idx``: its own, and the neighbour whose edge is nearer than ``rim``."""
    home, pos = F.floor((F.col("idx") - 1) / block), (F.col("idx") - 1) % block
    near = F.array_compact(F.array(home, F.when(pos < rim, home - 1), F.when(pos >= block - rim, home + 1)))
    return home.alias("home"), F.explode(near).alias("block")


def _over_blocks(
    df: DataFrame, names: Sequence[str], values: Sequence[str], out: dict, block: int, rim: int, compute
) -> DataFrame:
    """``(names, idx, rec_id, *out)``: ``compute(table, codes)`` over blocks with overlaps, kept for each block's own rows."""
    spread = df.select(*names, "idx", "rec_id", *values, *_blocks(block, rim))
    schema = StructType(
        [
            *[f for f in spread.schema.fields if f.name in names], StructField("idx", LongType()),
            StructField("rec_id", LongType()), *[StructField(n, t) for n, t in out.items()]
        ]
    )

    def kernel(table: pa.Table, codes: np.ndarray) -> pa.Table:
        found = table.select([*names, "idx", "rec_id"])
        for name, values in compute(table, codes).items():
            found = found.append_column(name, values)
        return found.filter(pa.array(column(table, "home") == column(table, "block")))

    return over_groups(spread, [*names, "block"], ["idx"], kernel, schema)


def _hot(
    df: DataFrame, names: list[str], channel: Channel, run: int, confirm: float | None, rounds: int, block: int
) -> DataFrame:
    """As ``_judge`` for sources too large for a task, in blocks of ``block`` readings."""
    scratch = Scratch(df.sparkSession, "spikes")
    readings = df.where(F.col("v").isNotNull() & ~F.isnan("v")).dropDuplicates([*names, "rec_id"])
    placed = numbered(readings, names, ["at", "rec_id"], "idx")

    def first(table: pa.Table, codes: np.ndarray) -> dict:
        values = column(table, "v", float)
        wrong, stuck = channel.impossible(values), _stuck(values, codes, run)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = 10 * np.log10(values) if channel.decibel else values
        return {
            "fault": pa.array(np.where(wrong, "impossible", np.where(stuck, "stuck", "")).tolist(), pa.string()),
            "x": pa.array(x)
        }

    judged = scratch.cut(
        _over_blocks(placed, names, ["v"], {"fault": StringType(), "x": DoubleType()}, block, run + 2, first)
    )
    clean = judged.where("fault = ''")
    middle = percentiles(value_counts(clean, names, "x"), names, {"middle": 0.5}).drop("n_rows")
    centred = _match(clean, middle, names).select(*names, "rec_id", "idx", (F.col("x") - F.col("middle")).alias("u"))
    usual = percentiles(
        value_counts(centred.withColumn("a", F.abs("u")), names, "a"), names, {"usual": 0.5}
    ).drop("n_rows")
    centred = _match(centred, usual.withColumn("usual", F.col("usual") * USUAL), names)
    # Numbered anew, so that clean neighbours stand beside each other.
    state = numbered(centred.withColumnRenamed("idx", "at"), names, ["at"], "idx").drop("at")
    state = scratch.cut(state.withColumn("flagged", F.lit(False)))
    for _ in range(rounds):
        grown = scratch.cut(_round(state, names, confirm, block))
        if grown.where("new").isEmpty():
            break
        state = grown.select(*names, "idx", "rec_id", "u", "usual", (F.col("flagged") | F.col("new")).alias("flagged"))
    spikes = state.where("flagged") if confirm is None else state.where(
        F.col("flagged") & (F.abs("u") > confirm * F.col("usual"))
    )
    size = F.when(F.col("u") == 0, 0.0).when(F.col("usual") == 0, float("inf")).otherwise(F.abs("u") / F.col("usual"))
    spikes = spikes.select(
        "rec_id", F.lit(channel.field).alias("field"), F.lit("spike").alias("fault"), size.alias("deviations")
    )
    return judged.where("fault <> ''").select(
        "rec_id", F.lit(channel.field).alias("field"), "fault", F.lit(None).cast("double").alias("deviations")
    ).unionByName(spikes)


def _round(state: DataFrame, names: list[str], confirm: float | None, block: int) -> DataFrame:
    """One round of ``_phase_space`` over blocks: ``state`` with ``new``, the points outside this round's ellipsoid.

    Flagged points are bridged by the last good one before them. Within a block that is known; before a block's first good
    point it is the last good one of an earlier block, carried on over a table with one row per block.
    """
    home = F.floor((F.col("idx") - 1) / block).alias("home")
    ends = state.groupBy(*names, home).agg(
        F.max_by(F.when(~F.col("flagged"), F.col("u")), F.when(~F.col("flagged"), F.col("idx"))).alias("last")
    )
    order = Window.partitionBy(*names).orderBy("home")
    carry = ends.select(
        *names, "home",
        F.coalesce(
            F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        ).alias("carry")
    )
    based = _match(state.withColumn("home", home), carry, [*names, "home"])

    def bridge(table: pa.Table, codes: np.ndarray) -> dict:
        u, flagged, carried = column(table, "u", float), column(table, "flagged").astype(bool), column(
            table, "carry", float
        )
        back = np.maximum.accumulate(np.where(flagged, -1, np.arange(len(u))))
        known = (back >= 0) & (codes[np.maximum(back, 0)] == codes)
        return {"b": pa.array(np.where(flagged, np.where(known, u[np.maximum(back, 0)], carried), u))}

    bridged = _over_blocks(based, names, ["u", "usual", "flagged", "carry"], {"b": DoubleType()}, block, 0, bridge)

    def differences(table: pa.Table, codes: np.ndarray) -> dict:
        du, d2 = _differences(column(table, "b", float), codes)
        return {"bu": table.column("b"), "du": pa.array(du), "d2": pa.array(d2)}

    stepped = _over_blocks(
        bridged, names, ["b"], {"bu": DoubleType(), "du": DoubleType(), "d2": DoubleType()}, block, 3, differences
    )
    points = _match(state, stepped.drop("rec_id"), [*names, "idx"])
    axes = ("bu", "du", "d2")
    tall = points.where("NOT flagged").select(
        *names, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.abs(a).alias("size")) for a in axes])).alias("e")
    ).select(*names, "e.*")
    sizes = percentiles(value_counts(tall, [*names, "axis"], "size"), [*names, "axis"], {"half": 0.5})
    sizes = sizes.groupBy(*names).agg(
        F.max("n_rows").alias("n"),
        *[F.max(F.when(F.col("axis") == a, F.col("half") * USUAL)).alias(f"s_{a}") for a in axes]
    )
    limit = F.sqrt(2 * F.log(F.greatest(F.col("n"), F.lit(2)).cast("double")))
    limit = limit if confirm is None else F.least(limit, F.lit(float(confirm)))
    square = lambda a: F.when(F.col(a) == 0, 0.0).when(F.col(f"s_{a}") == 0, float("inf")).otherwise(
        F.pow(F.col(a) / (limit * F.col(f"s_{a}")), 2)
    )
    distance = square("bu") + square("du") + square("d2")
    return _match(points, sizes, names).select(
        *names, "idx", "rec_id", "u", "usual", "flagged", (~F.col("flagged") & (distance > 1)).alias("new")
    )
