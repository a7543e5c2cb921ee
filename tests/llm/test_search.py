"""Block-Max MaxScore search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import pytest

from litscore.llm import search
from litscore.llm.search import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    tokens = [(d, words(t)) for d, t in docs]
    n_docs = sum(1 for _, w in tokens if w)
    n_terms = sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = []
    for item, text in items:
        if item is None:
            continue
        asked = set(words(text))
        scored = []
        for d, w in tokens:
            if d is None or not w:
                continue
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if s > 0:
                scored.append((-s, d))
        for rank, (s, d) in enumerate(sorted(scored)[:10], 1):
            out.append((item, rank, d, -s))
    return sorted(out)


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    vocab = ["the", "The", "THE", "cat", "dog", "é", "日本", "x1", "a_b", "Zebra", "it's", "9lives"] + [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 10, 40, 200])
        docs.append((rng.choice([i, i, i, 7]) if i % 50 else None, " ".join(rng.choice(vocab) for _ in range(k)) if k else rng.choice([None, "", "...!!"])))
    docs += [(1000, "the " * 500), (1001, "the cat"), (1002, "the cat")]  # a common term, ties
    items = [(0, "the cat"), (1, "dog Zebra x1"), (2, "nothing here"), (3, None), (4, "THE the w1 w2 w3 w4 w5 w6 w7"), (None, "cat"), (5, "é 日本 9lives it's")]
    return docs, items


@pytest.mark.parametrize("window,block,parts", [(4096, 128, 1), (8, 2, 7), (3, 1, 3)])
def test_equals_exhaustive_scoring(spark, monkeypatch, window, block, parts):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "BLOCK", block)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts).selectExpr("*", "'x' AS score", "1 AS rank")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in rank_documents(d, b).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 3)
    docs, items = corpus(6, 120)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(tuple(r) for r in rank_documents(d, b).collect()) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert rank_documents(d, b).count() == 0
    assert rank_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), b.where("false")).count() == 0
