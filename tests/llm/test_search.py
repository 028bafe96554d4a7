"""Ranked search by plain Python: ties, windows, blocks of queries, awkward rows."""

import math
import random
import re
from collections import Counter

import pytest

from gristmill.llm import search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    out = []
    for item, text in items:
        scored = []
        for i, c in tf:
            total = 0
            for t in terms(text):
                if c[t]:
                    df = sum(t in x for _, x in tf)
                    m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if total > 0:
                scored.append((-total, i is None, i))
        out += [(item, n + 1, i, -x) for n, (x, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ask(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, query string, score int").repartition(3)
    q = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, query string, rank int")
    out = s.search_documents(d, q, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("window, query_bytes", [(1 << 13, 4 << 20), (7, 60)])
def test_against_plain_python(spark, monkeypatch, window, query_bytes):
    monkeypatch.setattr(s, "WINDOW", window)
    r = random.Random(2)
    words = [f"w{int(r.expovariate(0.15))}" for _ in range(400)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)] + [(-5, docs[3][1])]  # ties beyond k
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(20)]
    assert ask(spark, docs, items, query_bytes=query_bytes) == plain(docs, items)
    assert ask(spark, docs, items, k=3, query_bytes=query_bytes) == plain(docs, items, 3)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (4, "One-two Äb"), (4, "one two"), (4, "one two"), (None, "one two"), (None, "two"), (5, "x " * 50_000 + "one")]
    items = [(1, "ONE one"), (1, "two"), (None, "two"), (2, None), (3, ""), (4, "nowhere"), (5, "Äb äb")]
    assert ask(spark, docs, items) == plain(docs, items)
    assert ask(spark, docs, []) == [] and ask(spark, [], items) == [] and ask(spark, [], []) == []
    # a term that all documents have
    every = [(i, "a") for i in range(5)]
    assert ask(spark, every, [(1, "a")]) == plain(every, [(1, "a")])
