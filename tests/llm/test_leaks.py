import random

import numpy as np
import pytest

from quirework.llm import leaks


def brute(docs, items, k):
    grams = lambda t: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    return {(d, i) for d, x in docs.items() for i, y in items.items() if grams(x) & grams(y)}


def longest(x, y):
    return max((n for i in range(len(x)) for j in range(len(y)) for n in [next((m for m in range(min(len(x) - i, len(y) - j)) if x[i + m] != y[j + m]), min(len(x) - i, len(y) - j))]), default=0)


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 400)
    order = leaks.suffix_array(tokens, 400)
    assert sorted(order) == list(range(400))
    assert all(tuple(tokens[a:]) <= tuple(tokens[b:]) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50, "block_words": 40, "extend_rows": 3}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(6)]
    docs = {k: [rng.choice(vocab) for _ in range(rng.randrange(0, 60))] for k in range(60)}
    items = {k: [rng.choice(vocab) for _ in range(rng.randrange(0, 25))] for k in range(12)}
    docs[60] = docs[59] + items[3] + docs[58]
    docs[61] = items[4] * 40
    frame = lambda d, c: spark.createDataFrame([(k, " ".join(w).upper() + "!") for k, w in d.items()], f"{c} long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(frame(docs, "doc_id").coalesce(1), frame(items, "item_id"), min_words=5, **sizes).collect()}
    assert set(got) == brute(docs, items, 5)
    for (d, i), r in got.items():
        assert r.match_words == longest(docs[d], items[i])
        assert docs[d][r.doc_word : r.doc_word + r.match_words] == items[i][r.item_word : r.item_word + r.match_words]


def test_small_shards_and_blocks_lose_nothing():
    rng = random.Random(4)
    docs = [np.array([rng.randrange(1, 5) for _ in range(300)], np.int64) for _ in range(5)]
    items = leaks.Items([7, 8], [docs[1][40:60].copy(), docs[3][:12].copy()], 10)
    found = leaks._best(leaks.search_shard(leaks.Shard(docs, items.depth), items, 10, 2))
    best = {(d, i): n for d, i, n in zip(*(c.tolist() for c in found[:3]))}
    assert best[1, 0] == 20 and best[3, 1] == 12


def test_defined_cases(spark):
    long = " ".join(f"t{k}" for k in range(12))
    corpus = spark.createDataFrame([(1, None), (2, ""), (3, "few words"), (4, long), (5, long), (None, long)], "doc_id long, text string").selectExpr("*", "1 AS item_id")
    items = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "few words")], "item_id long, text string")
    got = leaks.find_leaks(corpus, items)
    assert sorted(((r.doc_id, r.item_id, r.match_words) for r in got.collect()), key=str) == [(4, 1, 12), (5, 1, 12), (None, 1, 12)]
    assert leaks.find_leaks(corpus.limit(0), items).count() == 0
    assert leaks.find_leaks(corpus, items.limit(0)).count() == 0
