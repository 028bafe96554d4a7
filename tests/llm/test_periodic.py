"""Periodic runs against a plain search over all lags, and on awkward rows."""

import hashlib
import random
import time
import zlib

from gristmill.llm import periodic
from gristmill.llm import queries as q
from gristmill.llm.periodic import kept_words, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    out = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            start, length = i, j - i + p
            smaller = any(all(w[k] == w[k + r] for k in range(start, start + length - r)) for r in range(1, p)) if length >= max(6, 4 * p) else True
            if not smaller:
                out.add((start, length, p))
            i = max(j, i + 1)
    return sorted(out)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_small_alphabets():
    r = random.Random(3)
    for _ in range(1500):
        n = r.randint(0, 70)
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 6])]) for _ in range(n)]
        w = planted(r.choice([5, 13, 26, 27, 40]), w)
        for _ in range(r.randint(0, 2)):
            at, p = r.randrange(n + 1), r.randint(1, 6)
            w[at:at] = (w[at : at + p] or ["z"]) * r.randint(2, 6)
        assert runs_of(w) == plain_runs(w), w


def test_query_equals_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r.asDict() for r in q.op13_periodic_runs(spark, SF).collect()}
    assert rows.keys() == texts.keys() and sum(r["n_runs"] for r in rows.values()) > 5
    for i, text in texts.items():
        w = planted(i, (text or "").encode().split())
        runs = plain_runs(w) if len(w) < 600 else runs_of(w)
        s, k, p = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        gone = {j for a, n, b in runs for j in range(a + b, a + n)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want = {"doc_id": i, "n_runs": len(runs), "start": s, "length": k, "period": p, "exponent_milli": runs and 1000 * k // p or None}
        want |= {"runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest()}
        assert rows[i] == want


def test_long_texts_take_little_more_than_in_proportion():
    began = time.time()
    assert runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    assert runs_of([str(i % 7) for i in range(300_000)]) == [(0, 300_000, 7)]
    assert runs_of([str(i % 60_000) for i in range(300_000)]) == [(0, 300_000, 60_000)]
    assert time.time() - began < 30


def test_pairs_are_cut(monkeypatch):
    words = list("ababababab") + [str(i) for i in range(50)] + ["x"] * 9
    want = runs_of(words)
    monkeypatch.setattr(periodic, "PAIRS", 3)
    assert runs_of(words) == want == [(0, 10, 2), (60, 9, 1)]
    assert kept_words(69, want).sum() == 69 - 8 - 8


def test_awkward_rows(spark):
    kind = "doc_id long, text string, runs string, collapsed int, n_words int, extra string"
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a a a a a a b"), (4, "a a a a a a b"), (4, "a a a a a a b"), (5, "A a A a a a"), (6, "ä x " * 8)]
    docs = spark.createDataFrame([(*r, "old", 1, 1, "e") for r in rows], kind)
    out = periodic.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"], r["extra"]) for r in out.collect())
    assert got == sorted([("1", 0, 0, "", "e"), ("2", 0, 0, "", "e"), ("3", 0, 0, "", "e"), ("None", 7, 1, "a b", "e"), ("4", 7, 1, "a b", "e"), ("4", 7, 1, "a b", "e"), ("5", 6, 0, "A a A a a a", "e"), ("6", 8, 1, "ä x", "e")])
    assert periodic.collapse_runs(spark.createDataFrame([], kind)).count() == 0
    assert periodic.planted(docs).count() == len(rows) and periodic.planted(spark.createDataFrame([], kind)).count() == 0
