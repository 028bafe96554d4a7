"""Decontamination where words repeat: against brute force, and in time."""

import random
import time

import pytest

from gristmill.llm import decontam

WAYS = [decontam.BROADCAST_BYTES, 0]


def brute(doc, items):
    """(n_hit, ids) of words of a document and of items."""
    hit, ids = set(), set()
    for i, w in items:
        k = min(len(w), 10)
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for j in range(len(doc) - k + 1):
            if tuple(doc[j : j + k]) in own:
                hit |= set(range(j, j + k))
                ids.add(i)
    return len(hit), tuple(sorted(ids))


def stretch(r):
    """Words of a small alphabet with repeated words and patterns of all lengths between."""
    out = []
    for _ in range(r.randint(1, 6)):
        pattern = [r.choice("abc") for _ in range(r.choice([1, 1, 1, 2, 3, 7]))]
        out += (pattern * 60)[: r.choice([3, 9, 10, 11, 12, 15, 16, 17, 22, 40])]
        out += [r.choice("abxyz") for _ in range(r.randint(0, 4))]
    return out


@pytest.mark.parametrize("way", WAYS)
def test_by_brute_force(spark, way):
    r = random.Random(11)
    docs, items = [(i, stretch(r)) for i in range(250)], [(f"i{i:02d}", stretch(r)) for i in range(25)] + [("j1", ["a"] * 10), ("j2", ["x", *"aaaaaaaaa"]), ("j3", list("aaaaaaaaay")), ("j4", list("aaab"))]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    got = {x["doc_id"]: (x["n_hit"], tuple(x["items"])) for x in decontam.decontaminate(d, b, way).collect()}
    for i, w in docs:
        assert got[i] == brute(w, items), w


@pytest.mark.parametrize("way", WAYS)
def test_a_page_of_one_word(spark, way):
    item = spark.createDataFrame([(1, "a " * 10_000)], "item_id long, text string")
    decontam.decontaminate(spark.createDataFrame([(1, "b " * 20)], "doc_id long, text string"), item, way).collect()
    began = time.time()
    got = decontam.decontaminate(spark.createDataFrame([(1, "a " * 100_000), (2, "a " * 9)], "doc_id long, text string"), item, way).collect()
    assert sorted((x["doc_id"], x["n_hit"], x["n_words"]) for x in got) == [(1, 100_000, 100_000), (2, 0, 9)]
    assert time.time() - began < 30
