"""The language model against one with exact tables, both ways of asking, and awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gristmill.llm import lm_score as m
from gristmill.llm import queries as q

SF = "/root/testdata/sf0.001"


class Plain:
    """The same model over dictionaries; counts of two words and more are rounded to their level's value."""

    def __init__(self, texts):
        self.c = {n: Counter() for n in (1, 2, 3)}
        self.texts = 0
        for t in texts:
            w = self.tokens(t)
            self.texts += 1
            for n in (1, 2, 3):
                self.c[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(2 if n == 1 else n - 1, len(w)))
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])

    @staticmethod
    def tokens(text):
        return [1, 1, *(text or "").encode().lower().split(), 2]

    def value(self, gram):
        c = self.c[len(gram)][gram]
        return c if len(gram) == 1 else m.VALUES[np.searchsorted(m.LEVELS, c, "right")]

    def score(self, text, order):
        w, base, total, known = self.tokens(text), 0.0, 0.0, 0
        for i in range(2, len(w)):
            c = shorter = self.value((w[i],))
            known += c > 0
            p = (c + 0.1) / (self.n + 0.1 * (self.v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                context = tuple(w[i - n + 1 : i])
                h = self.texts if context == (1,) else self.value(context)
                c = min(self.value(tuple(w[i - n + 1 : i + 1])), shorter, h)
                p = (c + m.WEIGHT * p) / (h + m.WEIGHT)
                shorter = self.value(tuple(w[i - n + 1 : i + 1]))
            total += math.log10(p)
        return len(w) - 2, known, base, total


def out_of(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_query_equals_exact_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = Plain(t for i, t in texts.items() if not out_of(i))
    rows = q.op12_lm_scoring(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    off = []
    for r in rows:
        n, known, base, total = plain.score(texts[r["doc_id"]], 2)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of(r["doc_id"]), n, known, plain.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        off.append(abs(r["score"] - total) / abs(total))
    # what is left is the filters' false positives
    assert np.mean(off) < 0.002 and max(off) < 0.05
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_shards_answer_as_the_broadcast_does(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ways = [sorted(map(tuple, m.score_documents(docs, order, broadcast_bytes=b, shard_bytes=s).collect())) for b, s in ((1 << 30, 50_000), (0, 50_000))]
    assert ways[0] == ways[1]
    if order == 1:
        assert all(r[-1] == pytest.approx(r[-2]) for r in ways[0])


def test_filters_never_miss(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) & ~np.uint64(0xFFFFFF))
    counts = r.integers(1, 1000, len(keys))
    row = m.shard_row(pd.DataFrame({"shard": [0], "n": [2], "keys": [m.packed(keys)], "counts": [m.packed(counts)]}))
    s = m.Shards.of([row], 1)
    want = np.searchsorted(m.LEVELS, counts, "right")
    got = s.level(keys, np.zeros(len(keys), np.int64))
    assert (got >= want).all() and (got > want).mean() < 0.02
    others = s.level(keys ^ np.uint64(1 << 50), np.zeros(len(keys), np.int64))
    assert (others > 0).mean() < 0.02


def test_levels_of_a_sum_are_at_most_the_sum_of_levels():
    level = lambda c: np.searchsorted(m.LEVELS, c, "right")
    a = np.arange(1, 400)
    assert (level(a[:, None] + a) <= level(a)[:, None] + level(a)).all()
    assert (m.VALUES[1:4] == [1, 2, 3]).all() and (np.diff(m.VALUES) > 0).all()


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_awkward_rows(spark, broadcast_bytes):
    kind = "doc_id long, text string, kept string, score string, held_out string"
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "A b\x0bA"), (3, "a b a"), (None, "a"), (4, long), (5, "Ä ä")]
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], kind)
    got = m.score_documents(docs, broadcast_bytes=broadcast_bytes).collect()
    plain = Plain(t for i, t in rows if not out_of(i))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in got) == sorted((str(i), *plain.score(t, 2)[:2]) for i, t in rows)
    assert all(r["train_tokens"] == plain.n and r["score"] <= 0 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert m.score_documents(docs.limit(0), broadcast_bytes=broadcast_bytes).count() == 0
    # nothing to learn from
    alone = m.score_documents(docs.where("doc_id is null"), broadcast_bytes=broadcast_bytes).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(2, 0, 0, 0.0, 0.0)]
