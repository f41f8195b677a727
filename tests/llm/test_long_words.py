"""A word counts as the same word whatever stands beside it, words beyond 64 bytes included."""

import collections
import math
import random
import re

import numpy as np
import pytest

from faultline.llm import impact_lists, loglinear
from faultline.llm.textbatch import hash_words, words
from tests.llm import test_impact_lists as plain_search

LONG = ["x" * 65, "x" * 129, "ab" * 40, "http://" + "path/" * 60, "é" * 33, "Q" * 64]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    pool = ["the", "The", "of", "w1", "\x00", "\x0b", "a\x85b", "\xa0", *LONG]
    texts = [" ".join(rng.choice(pool[:6] if i % 3 else pool) for _ in range(rng.choice([1, 5, 60]))) for i in range(80)]
    texts += ["w1 " * 150_000 + LONG[0], "w1 of " * 150_000, None, "", "w1"]
    return [*enumerate(texts), (None, "w1 the"), (3, "The of")]


def test_hashes_do_not_depend_on_neighbours():
    def hashes(*some):
        data = np.frombuffer(" ".join(some).encode(), np.uint8)
        return hash_words(data, *words(data, np.array([0, len(data)]))).tolist()

    alone = [hashes(x)[0] for x in ["a", "of", *LONG]]
    assert hashes("a", "of", *LONG) == alone
    assert len(set(alone)) == len(alone)


def test_ranked_search_with_long_words(spark, docs):
    items = [(1, "the w1"), (2, LONG[0]), (3, f"of {LONG[3]} {LONG[4]}"), (4, f"w1 {'ab' * 40}"), (5, "q" * 64)]
    got = impact_lists.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search.plain(docs, items, 10)


def test_language_model_counts_long_words(spark, docs):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]

    train = [d for d in docs if d[0] is None or d[0] % 4]
    counts = collections.Counter(x for _, t in train for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = loglinear.score(frame, frame.filter("doc_id IS NULL OR doc_id % 4 <> 0"), vocabulary=4, frequent=6).collect()
    wanted = [(len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))) for _, t in docs]
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted((*w[:3], round(w[3], 4)) for w in wanted)
