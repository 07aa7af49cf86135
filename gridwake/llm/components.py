"""Splits that keep related records together: connected components by random-mate contraction."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.operators.order_stats import numbered, running_totals
from gridwake.session import Scratch


def _coin(vertex: str, round_: int):
    """The coin of a vertex in a round, the same wherever it is computed.

    The round is a string: as such it isn't written into the generated code, and all rounds share one compiled class.
    """
    return F.shiftrightunsigned(F.xxhash64(F.col(vertex), F.lit(f"round {round_}")), 17) % 2 == 0


def _mates(live: DataFrame, round_: int) -> DataFrame:
    """Vertices with tails and the smallest of their neighbours with heads."""
    ends = live.withColumn("hu", _coin("u", round_)).withColumn("hv", _coin("v", round_)).where("hu <> hv")
    return ends.select(
        F.when(F.col("hu"), F.col("v")).otherwise(F.col("u")).alias("from"),
        F.when(F.col("hu"), F.col("u")).otherwise(F.col("v")).alias("to")
    ).groupBy("from").agg(F.min("to").alias("to"))


def _leaves(live: DataFrame) -> DataFrame:
    """Vertices with one neighbour and that neighbour; of two that have only each other, the larger moves.

    Where a hub holds very many leaves, coins alone would halve them from round to round; this step takes them all at once.
    """
    ends = live.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("from"), F.col("v").alias("to")),
                F.struct(F.col("v").alias("from"), F.col("u").alias("to"))
            )
        ).alias("e")
    ).select("e.*")
    single = ends.groupBy("from").agg(
        F.count(F.lit(1)).alias("n"), F.min("to").alias("to")
    ).where("n = 1").select("from", "to")
    mutual = single.select(F.col("from").alias("to"), F.lit(True).alias("both"))
    return single.join(mutual, "to", "left").where(
        F.col("both").isNull() | (F.col("from") > F.col("to"))
    ).select("from", "to")


def _renamed(live: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges between the new names, each once as (smaller, larger), without loops."""
    for end in ("u", "v"):
        named = moves.select(F.col("from").alias(end), F.col("to").alias("new"))
        live = live.join(named, end, "left").select(
            *[F.coalesce("new", end).alias(end) if c == end else F.col(c) for c in ("u", "v")]
        )
    return live.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """``(vertex, component)`` from undirected ``edges (a, b)``; isolated ones come from ``vertices (vertex)``.

    Components are whole numbers, the same for all vertices of one. Vertices are numbered first, by a distributed sort, and all
    rounds work on the numbers. Vertices with a single neighbour collapse into it. Then, in each round, every vertex throws a
    coin; a vertex with tails and a neighbour with heads collapses into its smallest such neighbour. Edges are rewritten to the
    new names, loops and doubles vanish, and the rounds end when no edge is left (a quarter of the vertices collapse per
    round on average). Each round writes its edges once; its collapses follow from the round before's edges and the coins, so
    unwinding computes them again, from the last round to the first, and gives each vertex its component.

    Null ends make no edge; loops make a vertex; repeated edges count once; empty input gives an
    empty result. A vertex with a third of all edges (a hub) costs no more than the others: neighbours are chosen by a
    pre-aggregated minimum, renaming joins are split by adaptive execution, and doubles vanish each round.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    every = both.select(F.col("u").alias("vertex")).union(both.select(F.col("v").alias("vertex")))
    if vertices is not None:
        every = every.unionByName(vertices.select("vertex").where("vertex IS NOT NULL"))
    scratch = Scratch(edges.sparkSession, "components")
    named = scratch.cut(numbered(every.distinct(), [], ["vertex"], "id"))
    lettered = both.where("u <> v").distinct()
    for end in ("u", "v"):
        lettered = lettered.join(named.select(F.col("vertex").alias(end), F.col("id").alias(f"{end}_id")), end)
    live = scratch.cut(
        lettered.select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v")).distinct()
    )
    collapses: list[DataFrame] = []
    for round_ in range(-1, most_rounds):
        if live.isEmpty():
            break
        moves = _leaves(live) if round_ < 0 else _mates(live, round_)
        collapses.append(moves)
        live = scratch.cut(_renamed(live, moves))
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    # Vertices collapsed in a round take the name that their target has at the end of all later rounds.
    settled: DataFrame | None = None
    for moves in reversed(collapses):
        if settled is None:
            settled = scratch.cut(moves.select(F.col("from").alias("id"), F.col("to").alias("component")))
            continue
        later = settled.select(F.col("id").alias("to"), "component")
        now = moves.join(later, "to", "left").select(
            F.col("from").alias("id"), F.coalesce("component", "to").alias("component")
        )
        settled = scratch.cut(settled.unionByName(now))
    if settled is None:
        return named.select("vertex", F.col("id").alias("component"))
    result = scratch.cut(
        named.join(settled, "id", "left").select("vertex", F.coalesce("component", "id").alias("component"))
    )
    scratch.drop_all_but_last()
    return result


def split_groups(
    groups: DataFrame, group: str, weight: str, shares: dict[str, float], seed: int = 42, heavy: float = 0.05
) -> DataFrame:
    """``(group, weight, split)``: each group in one split, the splits' weights near the given shares.

    Groups are laid one after another, and the place where a group begins on this line decides its split. Groups heavier
    than ``heavy`` of everything come first, largest first, so that they fall into the first split named and
    cannot overrun a small one; the others follow in the order of a seeded hash. Null groups are left out; null weights
    count 0; repeated groups must be summed before. The running total comes from a distributed sort.
    """
    total = groups.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first()["t"]
    known = groups.where(F.col(group).isNotNull()).select(
        F.col(group), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("_w")
    )
    big = F.col("_w") > heavy * total
    ordered = known.withColumn(
        "_big", F.when(big, -F.col("_w")).otherwise(F.lit(0))
    ).withColumn("_hash", F.xxhash64(F.col(group), F.lit(seed)))
    placed = running_totals(ordered, [], ["_big", "_hash", group], "_w", "_upto_all")
    begin = (F.col("_upto_all") - F.col("_w")) / F.lit(float(max(total, 1)))
    bounds, names = [], list(shares)
    for name in names[:-1]:
        bounds.append((bounds[-1] if bounds else 0.0) + shares[name] / sum(shares.values()))
    split = functools.reduce(
        lambda rest, x: F.when(
            begin < x[0], F.lit(x[1])
        ).otherwise(rest), list(zip(bounds, names))[::-1], F.lit(names[-1])
    )
    return placed.select(group, F.col("_w").alias(weight), split.alias("split"))
