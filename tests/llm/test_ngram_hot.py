"""Long lists cut into parts, and sets whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import ngram_join as nj


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdefgh')}{rng.randint(0, 9)}" for _ in range(60)] for _ in range(3)]
    common = [f"common{i}" for i in range(12)]
    texts = []
    for i in range(n):
        t = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"z{rng.randint(0, 99)}" for w in rng.choice(base)]
        texts.append(common + t if rng.random() < 0.7 else common + [f"own{i}x{j}" for j in range(rng.randint(0, 20))])
    return [" ".join(t) for t in texts]


def plain(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("hot", [nj.HOT_ENTRIES, 20, 1])
def test_long_lists_in_parts(spark, hot):
    texts = near_copies(1, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in nj.jaccard_components(df, hot_entries=hot).collect()}
    assert got == plain(texts)


def test_sets_with_one_name(spark):
    docs = spark.createDataFrame([(1, 5, 7, 70), (2, 5, 7, 71), (3, 6, 8, 70), (4, 5, 7, 71), (5, 0, None, None)], "doc_id long, n long, sig long, sig2 long").withColumn("bits", F.lit(b"x"))
    apart, renamed = nj.told_apart(docs)
    sig = {r["doc_id"]: r["sig"] for r in apart.collect()}
    assert sig[1] == 7 and sig[3] == 8 and sig[2] == sig[4] == renamed[7][71] and sig[2] != 7 and sig[5] is None
    apart, renamed = nj.told_apart(docs.where("doc_id in (1, 3, 5)"))
    assert not renamed and apart.count() == 3 and apart.columns == ["doc_id", "n", "sig", "bits"]
