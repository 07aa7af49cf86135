"""Splits, ranking measures, thresholds and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.operators.order_stats import numbered, percentiles, running_totals, value_counts


def southern_split(points: DataFrame, share: float) -> DataFrame:
    """``split``: the southernmost share of each label (at least one point) is validation."""
    placed = numbered(points, ["label"], ["lat", "point_id"], "_place")
    sizes = points.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_n"))  # a row per label
    joined = placed.join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("_label")))
    return joined.withColumn(
        "split",
        F.when(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), "validation").otherwise("train")
    ).drop("_label", "_n", "_place")


def hold_out(points: DataFrame, key: str, held: Sequence[str]) -> DataFrame:
    return points.withColumn("split", F.when(F.col(key).isin(*held), "validation").otherwise("train"))


def auroc(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group, by counting on distinct scores.

    Scores are aggregated to (score, positives, negatives) first, and the running sums come from a distributed sort of these. One
    class alone gives null.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n")
    )
    ranked = running_totals(counts, keys, [score], "n", "_upto").withColumn("below", F.col("_upto") - F.col("n"))
    return ranked.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"),
        F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc")
    )


def tail_mean(df: DataFrame, value: str, alpha: float) -> DataFrame:
    """Mean of the lowest ``ceil(alpha n)`` values (at least one) of a table with a row per site."""
    order = Window.orderBy(value, *[c for c in df.columns if c != value])
    n = F.count(F.lit(1)).over(Window.partitionBy())
    known = df.where(F.col(value).isNotNull())
    return known.withColumn("_r", F.row_number().over(order)).withColumn("_n", n).where(
        F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * alpha))
    ).agg(
        F.avg(value).alias("tail_mean"), F.count(F.lit(1)).alias("n_tail")
    )


def _cumulative(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: what is found and what is falsely found at this threshold, and the totals of its group."""
    keys = list(keys)
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n")
    )
    down = running_totals(counts.withColumn("_down", -F.col("threshold")), keys, ["_down"], ["p", "n"], ["tp", "fp"])
    if not keys:
        totals = counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()  # two numbers
        return down.select(
            "threshold", "tp", "fp", F.lit(totals["p"]).cast("long").alias("pos"),
            F.lit(totals["n"]).cast("long").alias("neg")
        )
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return down.join(totals, keys).select(*keys, "threshold", "tp", "fp", "pos", "neg")


def youden(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest sum of sensitivity and specificity per group; the lowest one wins a tie."""
    points = _cumulative(df, score, label, keys).withColumn(
        "j", F.round(F.try_divide("tp", "pos") + 1 - F.try_divide("fp", "neg"), 9)
    )
    return points.groupBy(*keys).agg(F.max(F.struct("j", -F.col("threshold"))).alias("b")).select(
        *keys, (-F.col("b.col2")).alias("threshold"), F.col("b.j").alias("j")
    )


def best_f1(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The threshold with the largest F1 (the highest wins a tie), with its confusion counts, precision and recall."""
    points = _cumulative(df, score, label).withColumn(
        "f1", F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")), 9)
    )
    best = points.agg(F.max(F.struct("f1", "threshold", "tp", "fp", "pos", "neg")).alias("b")).select("b.*")
    return best.select(
        "threshold", "f1", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"),
        (F.col("neg") - F.col("fp")).alias("tn"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"),
        F.try_divide("tp", "pos").alias("recall")
    )


def calibration_error(df: DataFrame, prob: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last closed."""
    binned = df.where(F.col(prob).isNotNull()).groupBy(
        F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).alias("bin")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("said"), F.avg(F.col(label).cast("double")).alias("seen")
    )
    return binned.agg(
        (F.sum(F.col("n") * F.abs(F.col("said") - F.col("seen"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """``df`` with the rank of a value per group, ties sharing their mean; rows without a value are left out.

    Ranks are found for distinct values, by a distributed running count, and joined to the rows.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_totals(counts, list(keys), [value], "_n", "_upto").withColumn(
        out, F.col("_upto") - (F.col("_n") - 1) / 2
    ).drop("_n", "_upto")
    return known.join(ranks, [*keys, value])


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group; the keys must not be null."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(both, a, keys, "_a"), b, keys, "_b")
    return ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def class_stats(
    df: DataFrame, keys: Sequence[str], value: str, label: str = "label", point: str = "point_id"
) -> DataFrame:
    """``(keys, label, n_pixel_years, n_pixels, mean, median, p25, p75, iqr)`` of each class.

    Rows without value, label or key are left out. Groups may hold most rows: percentiles come from the distributed sort of value
    counts, and points are counted after a first aggregation by point.
    """
    by = [*keys, label]
    known = df.where(F.col(value).isNotNull()).dropna(subset=by)
    per_point = known.groupBy(*by, point).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    facts = per_point.groupBy(*by).agg(
        F.sum("n").alias("n_pixel_years"), F.count(F.lit(1)).alias("n_pixels"), (F.sum("s") / F.sum("n")).alias("mean")
    )
    quartiles = percentiles(
        value_counts(known, by, value), by, {"median": 0.5, "p25": 0.25, "p75": 0.75}
    ).drop("n_rows")
    return facts.join(quartiles, by).withColumn("iqr", F.col("p75") - F.col("p25"))


def quartile_overlap(
    stats: DataFrame, keys: Sequence[str], label: str = "label", one: str = "presence", other: str = "absence"
) -> DataFrame:
    """Per group of ``class_stats``: shared length of the two classes' interquartile ranges over their united length.

    Under four values in a class, or a united length of 0, give null. Groups may be an empty list.
    """
    at = lambda name, c: F.max(F.when(F.col(label) == name, F.col(c)))
    row = stats.groupBy(*keys).agg(
        at(one, "p25").alias("a1"), at(one, "p75").alias("a3"), at(other, "p25").alias("b1"),
        at(other, "p75").alias("b3"), F.coalesce(at(one, "n_pixel_years"), F.lit(0)).alias("na"),
        F.coalesce(at(other, "n_pixel_years"), F.lit(0)).alias("nb")
    )
    shared = F.greatest(F.lit(0.0), F.least("a3", "b3") - F.greatest("a1", "b1"))
    united = F.greatest("a3", "b3") - F.least("a1", "b1")
    return row.select(
        *keys, F.when((F.col("na") >= 4) & (F.col("nb") >= 4) & (united > 0), shared / united).alias("overlap"), "na",
        "nb"
    )


def residual_auroc(
    df: DataFrame, keys: Sequence[str], optical: str, radar: str, label: str, thresholds: DataFrame,
    threshold_keys: Sequence[str], least: int = 8
) -> DataFrame:
    """AUROC of a radar score among the windows that the optical score gets wrong at its threshold, and their number.

    Under ``least`` failures, or failures of one class only, give null. ``thresholds`` comes from ``youden``.
    """
    said = F.col(optical) >= F.col("threshold")
    failed = df.join(
        thresholds.select(*threshold_keys, "threshold"), list(threshold_keys)
    ).where((F.col(label) == 1) != said)
    area = auroc(failed, keys, radar, label)
    n = F.col("n_pos") + F.col("n_neg")
    return area.select(*keys, n.alias("n_fail"), F.when(n >= least, F.col("auc")).alias("residual_auc"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The first value at which half of the weight is reached."""
    order = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return df.where(F.col(value).isNotNull()).withColumn(
        "_c", F.sum(weight).over(order)
    ).withColumn("_t", total).where(F.col("_c") * 2 >= F.col("_t")).groupBy(*keys).agg(
        F.min(value).alias("weighted_median")
    )
