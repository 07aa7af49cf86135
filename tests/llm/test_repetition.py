import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridwake.llm.repetition import bands, count_trigrams, kneser_ney, perplexity, repetition

SCHEMA = "doc_id long, text string, lang string, share string, n string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in data], SCHEMA)


def plain_share(w, run=8):
    grams = [tuple(w[k : k + run]) for k in range(len(w) - run + 1)]
    n, covered = Counter(grams), [False] * len(w)
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered[k : k + run] = [True] * run
    return sum(covered)


def test_shares_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for i in range(60):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(4)):
            if len(w) > 20:
                a, b = rng.randrange(len(w) - 9), rng.randrange(len(w))
                w = w[:b] + w[a : a + rng.randrange(6, 12)] + w[b:]
        texts.append(w)
    got = {
        r.doc_id: (r.n_words, r.n_repeated)
        for r in repetition(
            frame(spark, [(i, " ".join(w), None) for i, w in enumerate(texts)]), "doc_id", "text"
        ).collect()
    }
    assert got == {i: (len(w), plain_share(w)) for i, w in enumerate(texts)}


def test_edge_cases(spark):
    data = [
        (1, None, None), (2, "", None), (3, "a b c", None), (4, "spam " * 50_000, None),
        (5, "A a, A-a a; a A a A!", None), (None, "x", None)
    ]
    got = {r.doc_id: (r.n_words, r.share) for r in repetition(frame(spark, data), "doc_id", "text").collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0), 3: (3, 0.0), 4: (50_000, 1.0), 5: (9, 1.0), None: (1, 0.0)}
    assert repetition(frame(spark, []), "doc_id", "text").count() == 0


def corpus(n=40, seed=5):
    rng = random.Random(seed)
    return [[f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randrange(1, 40))] for _ in range(n)]


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order three by the textbook; ln p of (w1, w2, w3)."""
    tri = Counter()
    for w in texts:
        padded = ["", "", *w]
        tri.update(zip(padded, padded[1:], padded[2:]))
    bi, uni = Counter((b, c) for _, b, c in tri), Counter(c for _, c in Counter((b, c) for _, b, c in tri))

    def discounts(counts):
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2])
        raw = {k: k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.5 * k for k in (1, 2, 3)}
        return {k: min(k, max(0.1 * k, v)) for k, v in raw.items()}

    def level(counts):
        d, total, kinds = discounts(counts), defaultdict(int), defaultdict(Counter)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]][min(n, 3)] += 1
        share = lambda g: max(0, counts[g] - d[min(counts[g], 3)]) / total[g[:-1]]
        rest = lambda h: sum(d[k] * kinds[h][k] for k in (1, 2, 3)) / total[h]
        return share, rest

    s1, r1 = level({(c,): n for c, n in uni.items()})
    s2, r2 = level(bi)
    s3, r3 = level(tri)
    bases = {g[:-1] for g in bi}, {g[:-1] for g in tri}

    def log_p(a, b, c):
        p = (s1((c,)) if c in uni else 0) + r1(()) / (len(uni) + 1)
        if (b,) in bases[0]:
            p = (s2((b, c)) if (b, c) in bi else 0) + r2((b,)) * p
        if (a, b) in bases[1]:
            p = (s3((a, b, c)) if (a, b, c) in tri else 0) + r3((a, b)) * p
        return math.log(p)

    return log_p


def perplexity_of(w, log_p):
    padded = ["", "", *w]
    return math.exp(-sum(log_p(*g) for g in zip(padded, padded[1:], padded[2:])) / len(w))


@pytest.mark.parametrize("limit", [10**6, 1])
def test_perplexity_against_the_textbook(spark, limit):
    texts = corpus()
    data = [(i, " ".join(w), "en" if i % 2 else "EN ") for i, w in enumerate(texts)]
    # Of these the model has seen nothing, some words, some pairs, and all but the order.
    foreign = [
        "six words no one ever wrote".split(), [*texts[0][:5], "never", *texts[1][:4]], texts[2][::-1],
        ["w1", "never", "w2"], ["solo"]
    ]
    extra = [(800 + i, " ".join(w), "en") for i, w in enumerate(foreign)] + [
        (900, None, "en"), (901, "", "en"), (902, "of another language", "xx")
    ]
    model = kneser_ney(count_trigrams(frame(spark, data).repartition(3), "text", "lang"))
    got = {
        r.doc_id: r
        for r in perplexity(frame(spark, data + extra), "doc_id", "text", "lang", model, broadcast_rows=limit).collect()
    }
    log_p = plain_model(texts)
    for i, w in [*enumerate(texts), *((800 + i, w) for i, w in enumerate(foreign))]:
        assert got[i].perplexity == pytest.approx(perplexity_of(w, log_p), rel=1e-9) and got[i].n_words == len(w)
    assert [(got[i].n_words, got[i].perplexity) for i in (900, 901, 902)] == [(0, None), (0, None), (3, None)]


def test_both_ways_of_scoring_take_every_row_for_itself(spark):
    texts = ["one two three four", "one two three five six", "six six six", "", None, "two three four one two"]
    docs = spark.createDataFrame(
        [(i, t, "en") for i, t in zip((1, 1, None, None, 2, 3), texts)], "doc_id long, text string, lang string"
    ).coalesce(1)
    model = kneser_ney(count_trigrams(docs, "text", "lang"))
    sent, joined = (
        [tuple(r) for r in perplexity(docs, "doc_id", "text", "lang", model, n).collect()] for n in (6_000_000, 0)
    )
    key = lambda r: (r[2], r[3] or 0, r[0] or 0)
    assert sorted(r[2] for r in sent) == [0, 0, 3, 4, 5, 5]
    for a, b in zip(sorted(sent, key=key), sorted(joined, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == (b[3] if b[3] is None else pytest.approx(b[3], rel=1e-12))


def test_probabilities_sum_to_one(spark):
    texts = corpus()
    log_p = plain_model(texts)
    words = {x for w in texts for x in w} | {"never"}
    for a, b in [
        ("", ""), ("", texts[0][0]), (texts[0][0], "never"), ("never", texts[0][0]),
        tuple(texts[3][:2]) if len(texts[3]) > 1 else ("", "")
    ]:
        assert sum(math.exp(log_p(a, b, c)) for c in words) == pytest.approx(1)


def test_bands(spark):
    df = spark.createDataFrame(
        [(i, "en", float(i)) for i in range(1, 101)] + [(500, "de", 3.0), (501, "en", None)],
        "doc_id long, lang string, perplexity double"
    )
    got = {r.doc_id: r.verdict for r in bands(df, 0.05, 0.95).collect()}
    assert [i for i, v in got.items() if v == "low"] == [1, 2, 3, 4] and sorted(
        i for i, v in got.items() if v == "high"
    ) == [96, 97, 98, 99, 100]
    assert got[500] == "kept" and got[501] == "kept"


def test_empty_model(spark):
    df = frame(spark, [])
    assert perplexity(df, "doc_id", "text", "lang", kneser_ney(count_trigrams(df, "text", "lang"))).count() == 0
