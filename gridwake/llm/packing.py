"""Documents into containers of fixed capacity, by large-item matching and best fit over the size histogram.

Sizes are whole tokens, so a corpus of any number of documents has at most ``capacity`` different sizes. The
packing is planned on the histogram: the plan says for each size which ranks go to which run of containers, and
its length depends on the capacity only. Documents then learn their rank among those of equal size from
per-partition counts, and look up their container in the plan.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are given to the tokenizer in parts cut before white space, which this kind of
#: tokenizer counts the same as the whole; a single run without white space stays whole.
PART = 200_000


def _parts(text: str):
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and not (
            text[end] == " " and text[end - 1] > " " and end + 1 < len(text) and text[end + 1] > " "
        ):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` in tokens of the ranks file ``tokenizer``; null texts have 0 tokens. Whole texts."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [
                sum(len(encoding.encode_ordinary(p)) for p in _parts(t)) if t else 0
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows ``(size, first rank, count, first container)`` and the number of containers.

    ``histogram`` counts pieces by size, 1 .. capacity. Large pieces (over a third) are taken from the largest
    on, and each is matched with the largest one that still fits beside it: at most two share a container.
    Smaller ones, largest first, each go to the container with the least room that holds them. All pieces
    of one size are moved at once, so the work depends on the capacity, not on the number of pieces.
    """
    left = dict(histogram)
    used: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int]] = []
    containers = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of containers (first, count)
    gaps: list[int] = []

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not room[gap]:
                insort(gaps, gap)
            room[gap].append((first, count))

    def put(size: int, count: int, first: int) -> None:
        plan.append((size, used[size], count, first))
        used[size] += count
        left[size] -= count

    large = sorted(s for s in left if s * 3 > capacity)
    open_ = list(large)  # ascending: large sizes of which some are left

    def partner_of(size: int) -> int | None:
        """The largest size that fits beside one of ``size``; sizes that are used up leave the list on the way."""
        at = bisect_right(open_, min(size, capacity - size)) - 1
        while at >= 0:
            other = open_[at]
            if not left[other]:
                open_.pop(at)
            elif other != size or left[other] > 1:
                return other
            at -= 1
        return None

    for size in reversed(large):
        while left[size]:
            partner = partner_of(size)
            if partner is None:
                count = left[size]
            else:
                count = left[size] // 2 if partner == size else min(left[size], left[partner])
            put(size, count, containers)
            if partner:
                put(partner, count, containers)
            free(capacity - size - (partner or 0), containers, count)
            containers += count
    for size in sorted((s for s in left if s * 3 <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                count = -(-left[size] // each)
                free(capacity, containers, count)
                containers += count
                continue
            gap = gaps[at]
            first, count = room[gap].pop()
            if not room[gap]:
                gaps.pop(at)
            take = min(count, left[size])
            # Best fit would put the next piece of this size into the same container as long as it fits there.
            deep = min(gap // size, left[size] // take)
            for _ in range(deep):
                put(size, take, first)
            free(gap - deep * size, first, take)
            free(gap, first + take, count - take)
    return plan, containers


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece, n_tokens, container)`` for ``sizes (doc_id, n_tokens)``.

    Every document comes out in one container; one longer than ``capacity`` is cut into full pieces, each a
    container of its own, and a rest that is packed like a document (pieces count from 0). Documents of
    no tokens are dealt over all containers. Null sizes count 0, negative ones are refused; repeated ids are packed each for
    itself. Empty input gives an empty result. Container numbers are dense from 0, first the packed
    ones, then those of full pieces.

    Only the histogram (at most ``capacity`` numbers) reaches the driver, and the plan that returns has a
    few rows per size and gap, whatever the number of documents.
    """
    sizes = sizes.select("doc_id", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    rest = sizes.withColumn(
        "rest",
        F.when(
            (F.col("n_tokens") % capacity == 0) & (F.col("n_tokens") > 0), F.lit(capacity)
        ).otherwise(F.col("n_tokens") % capacity)
    )
    fulls = ((F.col("n_tokens") - F.col("rest")) / capacity).cast("long")
    based = cut(_part_ranks(rest.withColumn("full", fulls)))
    histogram = {r["rest"]: r["n"] for r in based.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if any(s < 0 for s in histogram):
        raise ValueError("sizes must not be negative")
    plan, containers = plan_containers({s: n for s, n in histogram.items() if s}, capacity)
    containers = max(containers, 1)
    window = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = based.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0))).drop("n")
    # Full pieces get consecutive numbers; one row per partition decides where a partition's begin.
    full_before = based.groupBy("part").agg(F.sum("full").alias("f")).withColumn(
        "full_before", F.coalesce(F.sum("f").over(whole), F.lit(0))
    ).drop("f")
    ranked = based.join(before, ["rest", "part"]).join(full_before, "part").withColumn(
        "rank", F.col("local") + F.col("before")
    )
    key = np.array(sorted((s, r, c) for s, r, n, c in plan), dtype=np.int64).reshape(-1, 3)
    sizes_, ranks_, firsts_ = key[:, 0].copy(), key[:, 1].copy(), key[:, 2].copy()
    starts = np.searchsorted(sizes_, np.arange(capacity + 2))

    def look_up(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rest", "rank"))
            order = np.lexsort((rank, size))
            where = np.zeros(len(size), np.int64)
            s, r = size[order], rank[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                if s[a]:
                    lo, hi = starts[s[a]], starts[s[a] + 1]
                    at = lo + np.searchsorted(ranks_[lo:hi], r[a:b], "right") - 1
                    where[order[a:b]] = firsts_[at] + r[a:b] - ranks_[at]
                else:
                    where[order[a:b]] = r[a:b] % containers
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where)], names=[*batch.schema.names, "container"]
            )

    kind = dict(sizes.dtypes)["doc_id"]
    slim = ranked.select(
        "doc_id", "rest", "rank", "full", (F.col("full_upto") + F.col("full_before")).alias("full_first")
    )
    placed = slim.mapInArrow(
        look_up, f"doc_id {kind}, rest long, rank long, full long, full_first long, container long"
    )
    pieces = F.concat(
        F.when(
            F.col("full") > 0,
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("full") - 1),
                lambda i: F.struct(
                    i.alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"),
                    (F.lit(containers) + F.col("full_first") + i).alias("container")
                )
            )
        ).otherwise(F.array()),
        F.array(F.struct(F.col("full").alias("piece"), F.col("rest").alias("n_tokens"), F.col("container")))
    )
    return placed.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")


def _part_ranks(df: DataFrame) -> DataFrame:
    """Adds the partition, the rank within partition and size, and the full pieces before the row there."""
    kind = dict(df.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        part, seen, fulls = TaskContext.get().partitionId(), defaultdict(int), 0
        for batch in batches:
            rest = batch.column("rest").to_numpy(zero_copy_only=False)
            full = batch.column("full").to_numpy(zero_copy_only=False)
            order = np.argsort(rest, kind="stable")
            s = rest[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            local = np.empty(len(s), np.int64)
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                local[order[a:b]] = np.arange(b - a) + seen[int(s[a])]
                seen[int(s[a])] += b - a
            before = fulls + np.cumsum(full) - full
            fulls += int(full.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(local),
                    pa.array(before.astype(np.int64))
                ],
                names=[*batch.schema.names, "part", "local", "full_upto"]
            )

    return df.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, rest long, full long, part int, local long, full_upto long"
    )
