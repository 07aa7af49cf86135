import random

import pytest

from gridwake.llm.leakage import leaks

DOCS = "doc_id long, text string, lang string, item_id string"
ITEMS = "item_id long, text string, doc_id string, block string"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", "clash") for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], ITEMS)
    return {
        (r.doc_id, r.item_id): (r.overlap_words, r.equal_words, r.longest_run)
        for r in leaks(d, e, "doc_id", "text", "item_id", "text", **kw).collect()
    }


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_every_run_of_twelve_is_found(spark):
    rng = random.Random(4)
    items = [(i, words(rng.choice([8, 11, 12, 30, 90]), i)) for i in range(25)]
    docs = []
    for i in range(80):
        text = words(rng.randrange(5, 120), 1000 + i)
        for _ in range(rng.randrange(3)):
            _, item = items[rng.randrange(25)]
            k = min(len(item), rng.choice([5, 11, 12, 13, 40]))
            at, start = rng.randrange(len(text) + 1), rng.randrange(len(item) - k + 1)
            text = text[:at] + item[start : start + k] + text[at:]
        docs.append((i, text))
    joined = lambda rows: [(i, " ".join(t)) for i, t in rows]
    want = {(d, i) for d, text in docs for i, item in items if longest_common(text, item) >= 12}
    got = run(spark, joined(docs), joined(items))
    assert want and {k for k, v in got.items() if v[2] >= 12} == want
    for (d, i), (_, _, n) in got.items():
        assert n == longest_common(docs[d][1], items[i][1]) or n < 12


def test_substitutions(spark):
    item = words(40, 1)
    text = words(10, 2) + item[:18] + ["other"] + item[19:35] + words(10, 3)
    assert run(spark, [(1, " ".join(text))], [(7, " ".join(item))]) == {(1, 7): (35, 34, 18)}


def test_form_does_not_matter(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega"
    text = "> ALPHA, béta: “gamma” del-\n> ta epsilon ze­ta (eta) theta; io​ta ｋａｐｐａ lambda -- omega!"
    assert run(spark, [(1, text.replace("béta", "beta"))], [(1, item)])[1, 1][2] == 12
    assert run(spark, [(1, text)], [(1, item)]) == {} or run(spark, [(1, text)], [(1, item)])[1, 1][2] < 12


def test_nulls_short_empty_long_and_repeated(spark):
    long = " ".join(words(12, 5))
    docs = [(1, None), (2, ""), (3, "a b"), (4, "x " * 200_000 + long), (None, long), (5, long), (5, long)]
    items = [(1, None), (2, ""), (3, "a b"), (4, long), (5, "pre " + long + " post")]
    got = run(spark, docs, items)
    assert set(got) == {(d, i) for d in (4, 5, None) for i in (4, 5)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


@pytest.mark.parametrize("n", [30_000])
def test_one_passage_in_very_many_documents(spark, n):
    from pyspark.sql import functions as F

    text = " ".join(words(20, 8))
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    e = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert leaks(d, e, "doc_id", "text", "item_id", "text").where("longest_run = 20").count() == n


@pytest.mark.parametrize("n,share", [(16, 0.1), (24, 0.15), (24, 0.2)])
def test_recall_under_substitutions(spark, n, share):
    """At least 0.9 of passages with a tenth to a fifth of their words replaced are found, inside unrelated text."""
    rng = random.Random(n)
    items, docs = [], []
    for i in range(150):
        item = words(n, 10_000 + i)
        text = list(item)
        for k in rng.sample(range(n), round(n * share)):
            text[k] = f"other{rng.randrange(10**6)}"
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(words(60, 20_000 + i) + text + words(60, 30_000 + i))))
    got = set(run(spark, docs, items))
    assert sum((i, i) in got for i in range(150)) >= 0.9 * 150
    assert all(d == i for d, i in got)


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    from gridwake.llm import leakage

    rng = random.Random(11)
    items = [(i, words(30, i)) for i in range(40)]
    docs = [(i, words(20, 500 + i) + items[rng.randrange(40)][1][5:25]) for i in range(60)]
    joined = lambda rows: [(i, " ".join(t)) for i, t in rows]
    want = run(spark, joined(docs), joined(items))
    monkeypatch.setattr(leakage, "LEAST_BITS", 1 << 10)
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 10)
    assert len(want) >= 60 and run(spark, joined(docs), joined(items)) == want
