"""Repetition inside a document, and perplexity under a Kneser-Ney model of the corpus.

``repetition`` measures the share of a document's words that lie in a run of words occurring more than once in it:
the document's n-gram hashes are sorted, and equal neighbours are its echoes. ``kneser_ney`` counts a modified
Kneser-Ney model per language with Spark; ``perplexity`` scores documents against sorted hash arrays of it, backing off where
the model has not seen a run of words, and ``bands`` rejects those outside the language's bands.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.llm.words import blocks, document_of, mix, windows, word_hashes
from gridwake.session import at_most, cut


def repeated_words(words: np.ndarray, ends: np.ndarray, run: int) -> np.ndarray:
    """Per text, how many of its words lie in a run of ``run`` words that occurs more than once in it."""
    owner = document_of(ends)
    keys = windows(words, tuple(range(run)))
    counted = np.zeros(len(ends), np.int64)
    if not len(keys):
        return counted
    inside = np.flatnonzero(owner[: len(keys)] == owner[run - 1 :])
    keys = keys[inside] + mix(owner[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = inside[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(ends))


def repetition(docs: DataFrame, doc_id: str, text: str, run: int = 8) -> DataFrame:
    """``(doc_id, n_words, n_repeated, share)`` of every document.

    Texts of fewer than ``run`` words, empty and null ones repeat nothing: share 0. Occurrences may overlap. Repeated rows
    are measured each for itself, other columns are ignored, and empty input gives an empty result. Texts are read
    whole, and no row is shuffled.
    """
    kind = dict(docs.dtypes)[doc_id]

    def score(batches):
        for batch in batches:
            for block in blocks(enumerate(batch.column(1).to_pylist()), 1):
                words, ends = word_hashes([t for _, t in block])
                n = np.diff(np.concatenate([[0], ends]))
                repeated = repeated_words(words, ends, run)
                ids = batch.column(0).slice(block[0][0], len(block))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(repeated), pa.array(repeated / np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_repeated", "share"]
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        score, f"doc_id {kind}, n_words long, n_repeated long, share double"
    )


# ---- modified Kneser-Ney ------------------------------------------------------------------------------


def language_key(lang: Column) -> Column:
    return F.coalesce(F.lower(F.trim(lang)), F.lit(""))


def _trigrams(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two words before each word (0 before a text's first), and the word."""
    starts = np.concatenate([[0], ends[:-1]])
    w1, w2 = np.concatenate(
        [[0, 0], words[:-2]]
    )[: len(words)].astype(np.uint64), np.concatenate([[0], words[:-1]])[: len(words)].astype(np.uint64)
    full = starts[starts < ends]
    w1[full] = 0
    w2[full] = 0
    second = (starts + 1)[starts + 1 < ends]
    w1[second] = 0
    return w1, w2, words


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, w1, w2, w3, n)``: counts of word triples, combined per batch before the shuffle."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for block in blocks(rows, 1, 4_000_000):
                by: dict[str, list] = {}
                for lang_, t in block:
                    by.setdefault(lang_, []).append(t)
                for lang_, texts in by.items():
                    words, ends = word_hashes(texts)
                    if not len(words):
                        continue
                    grams = np.column_stack(_trigrams(words, ends))
                    key = mix(grams[:, 0] * np.uint64(3) + mix(grams[:, 1] * np.uint64(5) + mix(grams[:, 2])))
                    _, at, n = np.unique(key, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang_] * len(at), pa.string()),
                            *(_signed(np.ascontiguousarray(grams[at, i])) for i in range(3)),
                            pa.array(n.astype(np.int64))
                        ],
                        names=["lang", "w1", "w2", "w3", "n"]
                    )

    counted = docs.select(
        language_key(F.col(lang)).alias("lang"), F.col(text).alias("text")
    ).mapInArrow(run, "lang string, w1 long, w2 long, w3 long, n long")
    return counted.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))


def _discounts(df: DataFrame, order: int) -> DataFrame:
    """Per language the three discounts of an order, from the numbers of n-grams seen once to four times."""
    counts = df.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))
    bound = lambda value, k: F.least(F.lit(float(k)), F.greatest(F.lit(0.1 * k), F.coalesce(value, F.lit(0.5 * k))))
    return counts.select(
        "lang",
        *[
            bound(k - (k + 1) * y * F.try_divide(F.col(f"c{k + 1}"), F.col(f"c{k}")), k).alias(f"d{k}_{order}")
            for k in (1, 2, 3)
        ]
    )


#: Kinds of model rows: the probability of a triple, a pair, a word and of any unknown word, and what is left for the lower
#: order after two words and after one.
TRIPLE, PAIR, WORD, UNKNOWN, REST_2, REST_1 = 3, 2, 1, 0, 5, 4


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(lang, kind, w1, w2, w3, value)``: a modified Kneser-Ney model of order three, as natural logarithms.

    Interpolated: raw counts at the top, continuation counts below, three discounts per order and language, and a uniform
    share over the language's vocabulary plus one unknown word at the bottom. Rows of kind TRIPLE, PAIR and WORD are the
    probabilities of what was counted, UNKNOWN that of a word never seen, REST_2 and REST_1 the weights by which an unseen
    triple or pair backs off to the next order; words that a kind doesn't use are 0. ``counts`` comes from
    ``count_trigrams``; empty counts give an empty model.
    """
    tri = cut(counts)
    bi = cut(tri.groupBy("lang", "w2", "w3").agg(F.count(F.lit(1)).alias("n")))
    uni = bi.groupBy("lang", "w3").agg(F.count(F.lit(1)).alias("n"))

    def contexts(df: DataFrame, keys: list[str], order: int) -> DataFrame:
        kinds = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") >= 3)]
        return df.groupBy("lang", *keys).agg(
            F.sum("n").alias(f"total_{order}"), *[k.alias(f"k{i + 1}_{order}") for i, k in enumerate(kinds)]
        )

    small = _discounts(tri, 3).join(_discounts(bi, 2), "lang").join(_discounts(uni, 1), "lang").join(
        uni.groupBy("lang").agg(F.count(F.lit(1)).alias("words")), "lang"
    ).join(contexts(uni, [], 1), "lang")

    def share(n: Column, order: int) -> Column:
        taken = F.when(n == 1, F.col(f"d1_{order}")).when(n == 2, F.col(f"d2_{order}")).otherwise(F.col(f"d3_{order}"))
        return F.greatest(F.lit(0.0), n - taken) / F.col(f"total_{order}")

    def rest(order: int) -> Column:
        return (
            F.col(f"d1_{order}") * F.col(f"k1_{order}") + F.col(f"d2_{order}") * F.col(f"k2_{order}")
            + F.col(f"d3_{order}") * F.col(f"k3_{order}")
        ) / F.col(f"total_{order}")

    discounts = lambda k: small.select("lang", *[f"d{i}_{k}" for i in (1, 2, 3)])
    unknown = rest(1) / (F.col("words") + 1)
    p1 = uni.join(small, "lang").select("lang", "w3", (share(F.col("n"), 1) + unknown).alias("p1"))
    left2 = contexts(bi, ["w2"], 2).join(discounts(2), "lang").withColumn("rest2", rest(2))
    p2 = bi.join(left2, ["lang", "w2"]).join(p1, ["lang", "w3"])
    p2 = p2.select("lang", "w2", "w3", (share(F.col("n"), 2) + F.col("rest2") * F.col("p1")).alias("p2"))
    left3 = contexts(tri, ["w1", "w2"], 3).join(discounts(3), "lang").withColumn("rest3", rest(3))
    p3 = tri.join(left3, ["lang", "w1", "w2"]).join(p2, ["lang", "w2", "w3"])
    none = F.lit(0).cast("long")

    def rows(df: DataFrame, kind: int, value: Column, w1=none, w2=none, w3=none) -> DataFrame:
        return df.select(
            "lang", F.lit(kind).alias("kind"), w1.alias("w1"), w2.alias("w2"), w3.alias("w3"),
            F.log(value).alias("value")
        )

    w1, w2, w3 = (F.col(c) for c in ("w1", "w2", "w3"))
    parts = [
        rows(p3, TRIPLE, share(F.col("n"), 3) + F.col("rest3") * F.col("p2"), w1, w2, w3),
        rows(p2, PAIR, F.col("p2"), w2=w2, w3=w3),
        rows(p1, WORD, F.col("p1"), w3=w3),
        rows(small, UNKNOWN, unknown),
        rows(left3, REST_2, F.col("rest3"), w1, w2),
        rows(left2, REST_1, F.col("rest2"), w2=w2),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _keys(lang: np.ndarray, kind: int, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    return mix(w1 * np.uint64(3) + mix(w2 * np.uint64(5) + mix(w3 + lang) + np.uint64(kind + 1)))


def _lang_number(lang: str) -> np.uint64:
    return word_hashes([lang])[0][:1].sum(dtype=np.uint64) if lang else np.uint64(0)


def _looked_up(lang: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> dict[int, np.ndarray]:
    """The keys under which the model is asked for a triple and for what it may back off to."""
    no = np.zeros(len(w3), np.uint64)
    parts = {
        TRIPLE: (w1, w2, w3), PAIR: (no, w2, w3), WORD: (no, no, w3), UNKNOWN: (no, no, no), REST_2: (w1, w2, no),
        REST_1: (no, w2, no)
    }
    return {kind: _keys(lang, kind, *words) for kind, words in parts.items()}


def _model_rows(model: DataFrame) -> DataFrame:
    """The model as ``(key, value)``, language, kind and words hashed to one number."""

    def run(batches):
        for batch in batches:
            langs = pa.compute.dictionary_encode(batch.column("lang"))
            numbers = np.array(
                [_lang_number(x) for x in langs.dictionary.to_pylist()], np.uint64
            )[langs.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
            kinds = batch.column("kind").to_numpy()
            grams = [batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2", "w3")]
            keys = np.zeros(batch.num_rows, np.uint64)
            for kind in np.unique(kinds):
                here = kinds == kind
                keys[here] = _keys(numbers[here], int(kind), *(g[here] for g in grams))
            yield pa.RecordBatch.from_arrays([_signed(keys), batch.column("value")], names=["key", "value"])

    return model.mapInArrow(run, "key long, value double")


def perplexity(
    docs: DataFrame, doc_id: str, text: str, lang: str, model: DataFrame, broadcast_rows: int = 6_000_000
) -> DataFrame:
    """``(doc_id, lang, n_words, perplexity)``; texts without words, or of a language the model hasn't seen, have null perplexity.

    ``model`` comes from ``kneser_ney`` over any corpus: triples, pairs and words it doesn't hold back off to the next order. A model
    of at most ``broadcast_rows`` rows (checked) is sent to all tasks as sorted hash arrays; a larger one is joined with
    the documents' distinct triples by a shuffle, with the same result. Every row of ``docs`` is scored for itself, whatever its
    doc_id.
    """
    kind = dict(docs.dtypes)[doc_id]
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), language_key(F.col(lang)).alias("lang"), F.col(text).alias("text")
    )
    rows = cut(_model_rows(model))

    def grams(batch):
        for block in blocks(zip(range(batch.num_rows), batch.column(1).to_pylist(), batch.column(2).to_pylist()), 2):
            words, ends = word_hashes([t for _, _, t in block])
            names = {x: _lang_number(x) for x in {x for _, x, _ in block}}
            numbers = np.array([names[x] for _, x, _ in block], np.uint64)
            owner = document_of(ends)
            yield block[0][0], len(block), owner, ends, _looked_up(
                numbers[owner], *(_trigrams(words, ends) if len(words) else [np.zeros(0, np.uint64)] * 3)
            )

    if at_most(rows, broadcast_rows):
        table = rows.toArrow()
        keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        order = np.argsort(keys)
        sent = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))

        def score(batches):
            keys, values = sent.value

            def find(wanted: np.ndarray) -> np.ndarray:
                """The model's values, NaN where it has none."""
                if not len(keys):
                    return np.full(len(wanted), np.nan)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                return np.where(keys[at] == wanted, values[at], np.nan)

            either = lambda a, b: np.where(np.isnan(a), b, a)
            for batch in batches:
                for first, count, owner, ends, asked in grams(batch):
                    log_p = find(asked[TRIPLE])
                    rare = np.flatnonzero(np.isnan(log_p))  # what was never counted backs off
                    if len(rare):
                        got = {k: find(v[rare]) for k, v in asked.items() if k != TRIPLE}
                        word = either(got[WORD], got[UNKNOWN])
                        pair = either(got[PAIR], either(got[REST_1], 0.0) + word)
                        log_p[rare] = either(got[REST_2], 0.0) + pair
                    sums = np.bincount(owner, weights=log_p, minlength=count)[:count]
                    n = np.diff(np.concatenate([[0], ends]))
                    value = np.exp(-sums / np.maximum(n, 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, count), batch.column(1).slice(first, count), pa.array(n),
                            pa.array(value, mask=(n == 0) | np.isnan(value))
                        ],
                        names=["doc_id", "lang", "n_words", "perplexity"]
                    )

        return slim.mapInArrow(score, f"doc_id {kind}, lang string, n_words long, perplexity double")

    asked_kinds = (TRIPLE, PAIR, WORD, UNKNOWN, REST_2, REST_1)

    def spread(batches):
        for batch in batches:
            for first, count, owner, _, asked in grams(batch):
                # A text without words leaves one row without keys, so that no row of the table is lost.
                bare = np.setdiff1d(np.arange(count), owner)
                at = pa.array(np.concatenate([owner, bare]).astype(np.int64) + first)
                keys = [pa.concat_arrays([_signed(asked[k]), pa.nulls(len(bare), pa.int64())]) for k in asked_kinds]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).take(at), batch.column(0).take(at), batch.column(1).take(at), *keys],
                    names=["_row", "doc_id", "lang", *[f"k{k}" for k in asked_kinds]]
                )

    own = ["_row", "doc_id", "lang"]
    all_keys = [f"k{k}" for k in asked_kinds]
    spread_out = slim.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        spread, f"_row long, doc_id {kind}, lang string, " + ", ".join(f"{k} long" for k in all_keys)
    )
    tokens = cut(spread_out.groupBy(*own, *all_keys).agg(F.count(F.lit(1)).alias("n")))
    # Each distinct triple is looked up once, under all its keys in one join.
    distinct = tokens.where(f"k{TRIPLE} IS NOT NULL").groupBy(f"k{TRIPLE}").agg(
        *[F.min(k).alias(k) for k in all_keys[1:]]
    )
    asked = distinct.select(
        F.col(f"k{TRIPLE}").alias("gram"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("key")) for k in asked_kinds])
        ).alias("a")
    ).select("gram", "a.*")
    got = asked.join(rows, "key").groupBy("gram").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"v{k}") for k in asked_kinds]
    )
    word = F.coalesce(f"v{WORD}", f"v{UNKNOWN}")
    pair = F.coalesce(F.col(f"v{PAIR}"), F.coalesce(f"v{REST_1}", F.lit(0.0)) + word)
    log_p = F.coalesce(F.col(f"v{TRIPLE}"), F.coalesce(f"v{REST_2}", F.lit(0.0)) + pair)
    scored = tokens.join(got.select(F.col("gram").alias(f"k{TRIPLE}"), log_p.alias("log_p")), f"k{TRIPLE}", "left")
    n = F.coalesce(F.sum(F.when(F.col(f"k{TRIPLE}").isNotNull(), F.col("n"))), F.lit(0))
    unheard = F.count_if(F.col(f"k{TRIPLE}").isNotNull() & F.col("log_p").isNull())
    sums = scored.groupBy(*own).agg(
        n.alias("n_words"), F.sum(F.col("n") * F.col("log_p")).alias("s"), unheard.alias("unheard")
    )
    value = F.when(F.col("unheard") == 0, F.exp(-F.col("s") / F.nullif(F.col("n_words"), F.lit(0))))
    return sums.select("doc_id", "lang", "n_words", value.alias("perplexity"))


def bands(scored: DataFrame, low: float, high: float) -> DataFrame:
    """Adds ``verdict``: ``low`` or ``high`` for documents outside their language's band, else ``kept``.

    The band reaches from the ``low`` to the ``high`` percentile of the language's perplexities, found by
    Greenwald-Khanna sketches that combine over partitions (rank error 1/10,000).
    """
    limits = scored.where("perplexity IS NOT NULL").groupBy("lang").agg(
        F.percentile_approx("perplexity", [low, high], 10_000).alias("b")
    )
    joined = scored.join(limits, "lang", "left")
    verdict = F.when(F.col("perplexity") < F.get("b", F.lit(0)), "low").when(
        F.col("perplexity") > F.get("b", F.lit(1)), "high"
    ).otherwise("kept")
    return joined.withColumn("verdict", verdict).drop("b")
