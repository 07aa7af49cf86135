import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwake.llm.packing import pack, plan_containers, token_counts


def fill(plan):
    by = defaultdict(int)
    for size, _, count, first in plan:
        for c in range(first, first + count):
            by[c] += size
    return by


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_is_sound(histogram):
    plan, n = plan_containers(histogram, 40)
    ranks = defaultdict(list)
    for size, rank, count, _ in plan:
        ranks[size] += range(rank, rank + count)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in histogram.items()}
    used = fill(plan)
    assert all(v <= 40 for v in used.values()) and sorted(used) == list(range(n))
    large = [c for s, _, k, f in plan if s * 3 > 40 for c in range(f, f + k)]
    assert all(large.count(c) <= 2 for c in set(large))


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    small = {s: rng.randint(1, 9) for s in range(1, 500)}
    assert len(plan_containers({s: n * 10_000 for s, n in small.items()}, 512)[0]) < 20_000


SCHEMA = "doc_id long, n_tokens long, rest long, container long, part int"


def packed(spark, sizes, capacity=100):
    df = spark.createDataFrame([(i, s, 7, 7, 7) for i, s in enumerate(sizes)], SCHEMA).repartition(5)
    return pack(df, capacity).collect()


def test_every_document_once(spark):
    rng = random.Random(3)
    sizes = [int(rng.paretovariate(1.1) * 8) for _ in range(1500)] + [0] * 40 + [100] * 5 + [200, 201, 1000, None]
    out = packed(spark, sizes)
    total, pieces, used = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in out:
        total[r.doc_id] += r.n_tokens
        pieces[r.doc_id].append(r.piece)
        used[r.container] += r.n_tokens
    assert total == {i: s or 0 for i, s in enumerate(sizes)}
    for i, s in enumerate(sizes):
        assert sorted(pieces[i]) == list(range(max(1, -(-(s or 0) // 100))))
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert sum(used.values()) / len(used) > 97


def test_empty_and_refused(spark):
    assert packed(spark, []) == []
    assert [(r.piece, r.n_tokens) for r in packed(spark, [0])] == [(0, 0)]
    with pytest.raises(ValueError):
        packed(spark, [-1])


def test_token_counts(spark):
    long = "word " * 60_000 + "x" * 1000 + " end"
    texts = ["Hello world", "", None, long, "tab\tand\n\nline  ", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "id", "text").collect()}
    import base64

    import tiktoken

    from gridwake.llm.packing import PATTERN, TOKENIZER

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
