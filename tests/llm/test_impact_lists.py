"""Ranked search against scores of all documents, in plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest

from faultline.llm import impact_lists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for *_, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = collections.Counter(terms(text)), []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, *_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n):
    """Few frequent words and many rare ones, in odd writing."""
    pool = ["the", "The", "ÉTÉ", "été", "of", "x1", "日本", "_", "a-b", "İ"]
    return " ".join(rng.choice(pool) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n))


@pytest.mark.parametrize("shard", [7, 1 << 14])
def test_equals_plain_scores(spark, shard):
    rng = random.Random(shard)
    docs = [(i, words(rng, rng.choice([0, 1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies: ties beyond k
    docs += [(None, docs[3][1]), (3, docs[3][1]), (5000, None), (5001, " ,.!"), (5002, "the " * 100_000)]
    items = [(i, words(rng, rng.choice([1, 4, 30]))) for i in range(25)]
    items += [(100, docs[3][1]), (100, "the"), (101, None), (102, "...") , (None, "nosuchword w1"), (103, "w1 w1 w1 w2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS key", "2 AS rank").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS row")
    got = impact_lists.search(frame, asked, k=10, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 10)
    # Queries in several blocks.
    got = impact_lists.search(frame, asked, k=3, shard=shard, most_terms=60)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 3)


def test_reading_stops_early():
    """Lists are not read to their ends where the bounds decide before."""
    many = 50_000
    impact = np.arange(many, 0, -1) ** 2
    lists = impact_lists.lists_of(np.arange(many), np.zeros(many, np.int64), impact, many, 1)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                read.append(at.stop)
            return super().__getitem__(at)

    lists = lists._replace(impact=lists.impact.view(Watched))
    found, scores = impact_lists.best(lists, np.array([0]), np.array([1]), 5, 1)
    assert found.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == impact[:5].tolist()
    assert max(read) < 1000


def test_large_numbers_and_empty_tables(spark):
    tf, n = np.array([1, 5]), np.array([10**10, 3])
    got = impact_lists.impacts(tf, n, 10**10, 10**13)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 10**10 // 10**13)) for t, m in zip(tf.tolist(), n.tolist(), strict=True)]
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact_lists.search(docs.limit(0), items).count() == 0
    assert impact_lists.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in impact_lists.search(docs, items).collect()] == plain([(1, "a b")], [(1, "a")], 10)
