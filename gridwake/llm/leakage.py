"""Evaluation texts in a training corpus, by spaced-seed hashing.

A seed is a fixed mask over at most twelve consecutive words that ignores some of them. The hashes of all seeds of the
evaluation items are joined with those of the documents; each meeting fixes a diagonal on which item and document are
compared word by word, tolerant of substitutions. The corpus is read once: a sieve of the items' hashes lets a document's
hash pass only if it may be among them, and only what passes is written and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridwake.llm.words import blocks, document_of, mix, windows, word_hashes
from gridwake.session import Scratch

#: Masks: 1 is looked at, 0 is ignored. Seven words of ten or twelve: of passages of 16 to 24 words with a tenth to a fifth of the words
#: replaced, at least 0.95 meet one of them; twelve equal words meet all.
SEEDS = ("101100011011", "1111100101", "100011010111")
#: Bits of the sieve per seed, its smallest and its largest size in bits (2 and 128 MB): more seeds than the largest
#: holds let more hashes pass into the join, and change no result.
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 64, 1 << 24, 1 << 30
PROBES = 4


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _seeds(words: np.ndarray, owner: np.ndarray, masks: tuple[str, ...]):
    """For each mask the places whose window lies in one text, and the hashes there (different for each mask)."""
    for k, mask in enumerate(masks):
        places = _places(mask)
        span = windows(words, places)
        if len(span):
            inside = np.flatnonzero(owner[: len(span)] == owner[places[-1] : places[-1] + len(span)])
            yield inside, mix(span[inside] + np.uint64(k))


def _bits(hashes: np.ndarray, size: int):
    """The sieve's bits of each hash, one probe after the other."""
    h = hashes
    for _ in range(PROBES):
        yield h & np.uint64(size - 1)
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))


def _pass(sieve: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the hashes whose bits are all set; later probes look at what is left only."""
    left = np.arange(len(hashes))
    h = hashes
    for _ in range(PROBES):
        bit = h & np.uint64(size - 1)
        kept = (sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        left, h = left[kept], h[kept]
        if not len(left):
            break
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return left


def _sieve(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit array in which the bits of every seed are set, combined by the executors; at most ``MOST_BITS``."""
    size = LEAST_BITS
    while size < min(n * BITS_PER_SEED, MOST_BITS):
        size *= 2

    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            bits = np.concatenate([*_bits(hashes, size), np.zeros(0, np.uint64)])
            slots, at = np.unique(bits >> np.uint64(6), return_inverse=True)
            values = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(values, at, np.uint64(1) << (bits & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([_signed(slots), _signed(values)], names=["slot", "bits"])

    table = seeds.select("hash").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(
        F.expr("bit_or(bits)").alias("bits")
    ).toArrow()  # at most MOST_BITS / 64 rows
    sieve = np.zeros(size // 64, np.uint64)
    if table.num_rows:
        sieve[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return sieve, size


def _longest_run(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _overlap(equal: np.ndarray, patience: int) -> tuple[int, int]:
    """Length and equal words of the longest stretch with no more than ``patience`` unequal words in a row."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    wide = np.flatnonzero(np.diff(at) > patience + 1)
    first, last = np.concatenate([[0], wide + 1]), np.concatenate([wide, [len(at) - 1]])
    length, words = at[last] - at[first] + 1, last - first + 1
    best = np.lexsort((words, length))[-1]
    return int(length[best]), int(words[best])


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str,
    masks: tuple[str, ...] = SEEDS, patience: int = 2
) -> DataFrame:
    """``(doc_id, item_id, overlap_words, equal_words, longest_run)`` for each document that meets an item's seed.

    ``overlap_words`` is the length of the longest overlap, with at most ``patience`` substituted words in a row;
    ``equal_words`` the equal ones in it; ``longest_run`` the most consecutive equal words of any overlap. Every passage of
    at least twelve equal words is found, whatever its place. Items and texts of fewer words than a mask looks at, null and
    empty ones match nothing; a null id is kept as it is; repeated rows give repeated results. Texts are compared whole.
    Other columns are ignored.

    The corpus is read once, whatever the size of the items, and no document is shuffled that meets no seed. Those that do are written
    with their words; their hashes are joined with the items' by a shuffle (or by broadcast, where Catalyst finds the
    written table of seeds small), so a phrase of very many documents is spread by their numbers after the join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    dtype, itype = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]

    def to_words(batches):
        for batch in batches:
            for block in blocks(enumerate(batch.column(1).to_pylist()), 1):
                words, ends = word_hashes([t for _, t in block])
                parts = np.split(words, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block[0][0], len(block)),
                        pa.array([p.tobytes() for p in parts], pa.binary())
                    ],
                    names=["item_id", "words"]
                )

    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    worded = scratch.cut(
        known.mapInArrow(to_words, f"item_id {itype}, words binary").withColumn(
            "item_no", F.monotonically_increasing_id()
        )
    )

    def to_seeds(batches):
        for batch in batches:
            held = [np.frombuffer(b, np.uint64) for b in batch.column("words").to_pylist()]
            words = np.concatenate([*held, np.zeros(0, np.uint64)])
            ends = np.cumsum([len(h) for h in held]) if held else np.zeros(0, np.int64)
            owner, starts = document_of(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
            numbers = batch.column("item_no").to_numpy()
            for at, hashes in _seeds(words, owner, masks):
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(hashes), pa.array(numbers[owner[at]]),
                        pa.array((at - starts[owner[at]]).astype(np.int32))
                    ],
                    names=["hash", "item_no", "item_at"]
                )

    seeds = scratch.cut(worded.mapInArrow(to_seeds, "hash long, item_no long, item_at int"))
    sieve, size = _sieve(seeds, seeds.count())
    sent = spark.sparkContext.broadcast(sieve)

    def read(batches):
        sieve = sent.value
        for batch in batches:
            for block in blocks(enumerate(batch.column(1).to_pylist()), 1):
                words, ends = word_hashes([t for _, t in block])
                owner, starts = document_of(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
                found = [
                    (at[kept], hashes[kept]) for at,
                    hashes in _seeds(words, owner, masks) if len(kept := _pass(sieve, hashes, size))
                ]
                if not found:
                    continue
                at, hashes = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(owner[at], kind="stable")
                at, hashes = at[order], hashes[order]
                which, first = np.unique(owner[at], return_index=True)
                offsets = pa.array(np.append(first, len(at)).astype(np.int32))
                ids = batch.column(0).take(pa.array([block[i][0] for i in which]))
                texts = pa.array([words[starts[i] : ends[i]].tobytes() for i in which], pa.binary())
                local = pa.array((at - starts[owner[at]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, texts, pa.ListArray.from_arrays(offsets, _signed(hashes)),
                        pa.ListArray.from_arrays(offsets, local)
                    ],
                    names=["doc_id", "words", "hashes", "places"]
                )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    met = scratch.cut(
        slim.mapInArrow(
            read, f"doc_id {dtype}, words binary, hashes array<long>, places array<int>"
        ).withColumn("row", F.monotonically_increasing_id())
    )
    hits = met.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select(
        "row", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at")
    )
    diagonals = hits.join(seeds, "hash").groupBy(
        "row", "item_no", (F.col("at") - F.col("item_at")).alias("shift")
    ).agg(F.count(F.lit(1)).alias("n_seeds"))
    named = diagonals.join(
        worded.withColumnRenamed("words", "item_words"), "item_no"
    ).select("row", "item_no", "item_id", "item_words", "shift")
    both = met.select("row", F.lit(0).alias("kind"), "doc_id", "words").unionByName(
        named.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    item_arrow, doc_arrow = to_arrow_type(items.schema[item_id].dataType), to_arrow_type(docs.schema[doc_id].dataType)

    def compare(batches):
        row, words, name = None, None, None
        for batch in batches:
            marks = batch.column("row").to_numpy()
            kinds = batch.column("kind").to_numpy()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if kinds[i] == 0:
                    row, words, name = marks[i], np.frombuffer(
                        batch.column("words")[i].as_py(), np.uint64
                    ), batch.column("doc_id")[i].as_py()
                    continue
                item, shift = np.frombuffer(
                    batch.column("item_words")[i].as_py(), np.uint64
                ), batch.column("shift")[i].as_py()
                lo, hi = max(0, shift), min(len(words), len(item) + shift)
                equal = words[lo:hi] == item[lo - shift : hi - shift]
                length, n = _overlap(equal, patience)
                out.append(
                    (
                        row, name, batch.column("item_no")[i].as_py(), batch.column("item_id")[i].as_py(), length, n,
                        _longest_run(equal)
                    )
                )
            if out:
                columns = list(zip(*out))
                kinds_ = [pa.int64(), doc_arrow, pa.int64(), item_arrow, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds_)],
                    names=["row", "doc_id", "item_no", "item_id", "overlap_words", "equal_words", "longest_run"]
                )

    ordered = both.repartition("row").sortWithinPartitions("row", "kind")
    compared = ordered.mapInArrow(
        compare,
        f"row long, doc_id {dtype}, item_no long, item_id {itype}, overlap_words int, equal_words int, longest_run int"
    )
    # A seed's hash may clash; its diagonal then shows no run of words that would have met a mask.
    best = compared.groupBy("row", "doc_id", "item_no", "item_id").agg(
        F.max(F.struct("overlap_words", "equal_words")).alias("b"), F.max("longest_run").alias("longest_run")
    )
    return best.where(F.col("b.equal_words") >= min(m.count("1") for m in masks)).select(
        "doc_id", "item_id", "b.overlap_words", "b.equal_words", "longest_run"
    )
